"""Command line: ownership, ownership-timeseries, duplicates, changes, changes-timeseries over a git repository."""

from __future__ import annotations

import argparse
import cProfile
import sys
from contextlib import nullcontext
from datetime import UTC, datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from lineloom.functions import reldate
from lineloom.operators import changes as change_ops
from lineloom.operators import commits as commit_ops
from lineloom.operators.filters import file_matches
from lineloom.options import ChangesOptions, OptionError, OwnershipOptions
from lineloom.plans import changes as changes_plan
from lineloom.plans import ownership as ownership_plan
from lineloom.report import chart, text
from lineloom.session import session, with_checkpoints
from lineloom.sources import gitrepo
from lineloom.sources.cache import ResultCache, cache_key

COMMANDS = ("ownership", "ownership-timeseries", "duplicates", "changes", "changes-timeseries")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lineloom")
    p.add_argument("command", choices=COMMANDS)
    for name, default in (("repo", "."), ("branch", "main"), ("files", ".*"), ("files-not", ""), ("authors", ".*"), ("authors-not", ""), ("cache-file", ""), ("when", "now"), ("until", "now"), ("commit-id", ""), ("since-commit", ""), ("until-commit", ""), ("profile-file", ""), ("html", "")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--since", default=None)
    p.add_argument("--period", default=None)
    p.add_argument("--verbose", action="store_true", help="show the progress of Spark's stages")
    p.add_argument("--cache-ttl", type=int, default=5_184_000)
    p.add_argument("--min-dup-lines", type=int, default=4)
    p.add_argument("--format", choices=("full", "short", "csv"), default="full")
    return p


def log_of(spark, repo: str, branch: str) -> list:
    """(commit id, commit time in UTC, author time) of a branch, newest first."""
    rows = gitrepo.commits(spark, repo, branch).select("commit_id", "commit_ts", "author_ts").collect()
    return [(r["commit_id"], r["commit_ts"].astimezone(UTC), r["author_ts"]) for r in rows]


def snapshots(spark, repo: str, commits: list[tuple[str, datetime]], options: OwnershipOptions):
    """Ownership of some commits (id, author time) in one job, by commit_id."""
    ids = [c for c, _ in commits]
    tree = gitrepo.tree_files(spark, repo, ids).where(file_matches(F.col("file_path"), options.files, options.files_not))
    with_checkpoints(spark)
    blame = gitrepo.blame(tree.where((F.col("size") <= options.max_file_bytes) & ~F.col("is_binary")), repo).checkpoint()
    # one row for each snapshot
    times = spark.createDataFrame(commits, "commit_id string, snapshot_ts timestamp")
    return ownership_plan.analyse(blame.join(F.broadcast(times), "commit_id"), F.col("snapshot_ts"), options, keys=("commit_id",))


def snapshot(spark, repo: str, branch: str, when: str, options: OwnershipOptions):
    """Ownership at a commit, or at the last one at `when`; None if there is none."""
    if options.commit_id:
        commit = gitrepo.git(repo, "rev-parse", "--verify", f"{options.commit_id}^{{commit}}").decode().strip()
        at = datetime.fromisoformat(gitrepo.git(repo, "show", "-s", "--format=%aI", commit).decode().strip())
    else:
        moment = reldate.resolve(when)
        found = next((x for x in log_of(spark, repo, branch) if x[1] <= moment), None)
        if found is None:
            return None
        commit, _, at = found
    tree = gitrepo.tree_files(spark, repo, [commit]).where(file_matches(F.col("file_path"), options.files, options.files_not))
    with_checkpoints(spark)
    blame = gitrepo.blame(tree.where((F.col("size") <= options.max_file_bytes) & ~F.col("is_binary")), repo).checkpoint()
    return ownership_plan.analyse(blame, F.lit(at), options)


def touches_of(spark, a, ids: list[str], options: ChangesOptions):
    return gitrepo.line_touches(spark, a.repo, a.branch, ids, options.max_file_bytes, file_matches(F.col("file_path"), options.files, options.files_not)).persist()


def change_range(spark, a, since: datetime | None, until: datetime | None, options: ChangesOptions):
    """Changes of a range of dates or of commits; None if it is empty."""
    if a.since_commit or a.until_commit:
        ids = gitrepo.commit_range(a.repo, a.branch, a.since_commit, a.until_commit)
    else:
        ids = [r["commit_id"] for r in commit_ops.in_range(gitrepo.commits(spark, a.repo, a.branch), since, until).collect()]
    return changes_plan.analyse(touches_of(spark, a, ids, options), options) if ids else None


def run(args: list[str], out=sys.stdout) -> int:
    """0: done; 1: bad usage or branch; 2: the analysis failed; 3: nothing to report."""
    try:
        a = parser().parse_args(args)
        base = {"repo": a.repo, "branch": a.branch, "files": a.files, "files_not": a.files_not, "authors": a.authors, "authors_not": a.authors_not}
        own = OwnershipOptions(**base, when=a.when, commit_id=a.commit_id, min_duplicate_lines=a.min_dup_lines)
        by_commit = bool(a.since_commit or a.until_commit)
        since = a.since or {"ownership-timeseries": "3 months ago", "changes-timeseries": "90 days ago"}.get(a.command, "30 days ago")
        period = a.period or {"changes-timeseries": "30 days"}.get(a.command, "2 weeks")
        ranged = ChangesOptions(**base, since="" if by_commit and not a.since else since, until="" if by_commit else a.until, since_commit=a.since_commit, until_commit=a.until_commit)
        head = gitrepo.git(a.repo, "rev-parse", "--verify", "--quiet", f"{a.branch}^{{commit}}").decode().strip()
    except SystemExit as e:
        return 1 if e.code else 0
    except (OptionError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    cache = ResultCache(a.cache_file, a.cache_ttl) if a.cache_file else None
    key = cache_key(f"{a.command}/{a.format}/{period}", ranged if a.command.startswith("changes") else own, head, since, a.until)
    try:
        # the cache keeps texts; a page needs the results
        if cache and not a.html and (known := cache.get(key)) is not None:
            out.write(known)
            return 0
        spark = session(**({"spark_ui_showConsoleProgress": "true"} if a.verbose else {}))
        with cProfile.Profile() if a.profile_file else nullcontext() as profile:
            charts: list[tuple[str, str]] = []
            report = _report(spark, a, own, ranged, since, period, charts)
        if profile:
            profile.dump_stats(a.profile_file)
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    if report is None:
        print("No changes found" if a.command.startswith("changes") else "No commit found", file=sys.stderr)
        return 3
    if cache:
        cache.put(key, report)
        cache.close()
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(chart.page(a.command, charts, report))
    out.write(report)
    return 0


def _report(spark, a, own: OwnershipOptions, ranged: ChangesOptions, since: str, period: str, charts: list[tuple[str, str]]) -> str | None:
    """The report's text; adds what a page shows to `charts`, if one is wanted."""
    full = a.format == "full"
    if a.command in ("ownership", "duplicates"):
        found = snapshot(spark, a.repo, a.branch, a.when, own)
        if found is None:
            return None
        if a.command == "duplicates":
            return text.duplicates_text(found, full)
        if a.html:
            charts.append(("Lines by author", chart.pie([(r["author_name"], r["lines"]) for r in found.authors.orderBy(F.col("lines").desc(), "author_name").collect()])))
        return text.ownership_csv(found) if a.format == "csv" else text.ownership_text(found, full)
    if a.command == "ownership-timeseries":
        log = log_of(spark, a.repo, a.branch)
        authored = {c: at for c, _, at in log}
        ids = commit_ops.sample_ids([x[:2] for x in log], reldate.ticks(since, a.until, period))
        if not ids:
            return None
        found = snapshots(spark, a.repo, [(c, authored[c]) for c in ids], own)
        totals, by_commit = {r["commit_id"]: r.asDict() for r in found.totals.collect()}, {}
        for r in found.authors.collect():
            by_commit.setdefault(r["commit_id"], []).append(r.asDict())
        dates = {c: authored[c].date().isoformat() for c in ids}
        rows = [{"date": dates[c], **totals.get(c, EMPTY.asDict())} for c in ids]
        people = [{"date": dates[c], **r} for c in ids for r in by_commit.get(c, [])]
        if not rows:
            return None
        shown = {"lines": "Lines", "duplicated": "Duplicates", "files": "Files"}
        out = _clusters(spark, people, lambda r: r["lines"], "owns") + "\n" + text.series_text(rows[::-1], "date", shown, "Inc/period")
        if a.html:
            charts += _series_charts(people[::-1], "date", {"lines": "Lines", "duplicated": "Duplicates"})
        by_author = {"lines": "Lines", "duplicated": "Duplicates (total)", "original": "Duplicates (original)"}
        return out + (text.author_series_text(people, "date", by_author, "Inc/period") if full else "")
    if a.command == "changes":
        by_commit = bool(a.since_commit or a.until_commit)
        found = change_range(spark, a, None if by_commit else reldate.resolve(since), None if by_commit else reldate.resolve(a.until), ranged)
        if found is None:
            return None
        if a.html:
            flows = change_ops.flows(found.totals).collect()
            charts.append(("Lines touched", chart.sankey([(r["source"], r["target"], r["lines"]) for r in flows])))
        return text.changes_text(found) if full else text.changes_short_text(found)
    log = [x[:2] for x in log_of(spark, a.repo, a.branch)]
    times = dict(log)
    ranges = commit_ops.period_ranges(log, reldate.resolve(since), reldate.resolve(a.until), lambda at: reldate.less(at, period), lambda lo, hi: gitrepo.commit_range(a.repo, a.branch, lo, hi))
    if not ranges:
        return None
    names = [f"{min(times[c] for c in ids).date()} - {max(times[c] for c in ids).date()}" for ids in ranges if ids]
    ranges = [ids for ids in ranges if ids]
    # a row for each commit of the periods
    of_commit = spark.createDataFrame([(c, i) for i, ids in enumerate(ranges) for c in ids], "commit_id string, period int")
    touches = touches_of(spark, a, [c for ids in ranges for c in ids], ranged).join(of_commit, "commit_id")
    found = changes_plan.analyse(touches, ranged, keys=("period",))
    rows = [{**r.asDict(), "period": names[r["period"]]} for r in found.totals.orderBy("period").collect()]
    people = [{**r.asDict(), "period": names[r["period"]]} for r in found.authors.orderBy("period").collect()]
    if not rows:
        return None
    for r in [*rows, *people]:
        r["touched"] = r["new_lines"] + r["changes"]
    measures = {"touched": "Lines touched", "new_lines": "New lines", "changes": "Changed lines"}
    if a.html:
        charts += _series_charts(people, "period", measures)
    out = text.series_text(rows[::-1], "period", {"commits": "Commits", "files": "Files touched", **measures}, "Total")
    out += "\n" + _clusters(spark, people, lambda r: r["touched"], "touched")
    return out + (text.author_series_text(people, "period", measures, "Total") if full else "")


#: Totals of a snapshot in which no line counts.
EMPTY = Row(files=0, lines=0, authors=0, age_days_sum=0.0, duplicated=0)


def _series_charts(people: list[dict], label: str, measures: dict[str, str]) -> list[tuple[str, str]]:
    """A river and lines of each measure by author; people: oldest period first."""
    drawn = {title: chart.dense(people, "author_name", label, m) for m, title in measures.items()}
    return [(title, draw(*rows)) for title, rows in drawn.items() for draw in (chart.river, chart.lines)]


def _clusters(spark, people: list[dict], total, verb: str) -> str:
    """Clusters of the authors' totals over all periods."""
    sums: dict[str, int] = {}
    for r in people:
        sums[r["author_name"]] = sums.get(r["author_name"], 0) + total(r)
    if not sums:
        return ""
    return text.clusters_text(spark.createDataFrame(list(sums.items()), "author_name string, total bigint"), verb, "Author clusters\n")


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
