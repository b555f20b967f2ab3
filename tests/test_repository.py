import html
import io
from datetime import UTC, datetime, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lineloom import cli, schema
from lineloom.functions import reldate
from lineloom.operators import commits as commit_ops
from lineloom.options import ChangesOptions, OwnershipOptions
from lineloom.plans import changes as changes_plan
from lineloom.plans import ownership as ownership_plan
from lineloom.report import chart, text
from lineloom.sources import gitrepo
from tests import repos


@pytest.fixture(scope="module")
def owned(tmp_path_factory):
    return str(repos.owned(tmp_path_factory.mktemp("r") / "owned"))


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    return str(repos.copied(tmp_path_factory.mktemp("r") / "copied"))


def ids(spark, repo):
    return [r.commit_id for r in gitrepo.commits(spark, repo).collect()][::-1]


KNOWN: dict = {}


def analysed(spark, repo, **options):
    """Ownership at the head; a repository is blamed once."""
    if repo not in KNOWN:
        log = gitrepo.commits(spark, repo).collect()
        tree = gitrepo.tree_files(spark, repo, [log[0].commit_id])
        rows = gitrepo.blame(tree, repo).collect()
        KNOWN[repo] = log[0].author_ts, spark.createDataFrame(rows, schema.BLAME_LINES).coalesce(1).cache()
    at, blame = KNOWN[repo]
    return ownership_plan.analyse(blame, F.lit(at), OwnershipOptions(**options))


def counts(t):
    return t.lines, t.files, t.duplicated, t.authors


def test_scans(spark, owned):
    log = ids(spark, owned)
    assert len(log) == 5
    head = log[-1]
    assert {(r.file_path, r["size"]) for r in gitrepo.tree_files(spark, owned, [head]).collect()} == {("file1", 3), ("dir1/dir1.1/file2", 9)}
    assert gitrepo.tree_files(spark, owned, [log[0]]).first()["size"] == 1
    files = gitrepo.commit_files(spark, owned)
    assert files.where(F.col("commit_id") == head).count() == 1
    assert [x[1] for x in gitrepo.blame_file(owned, head, "file1")] == ["author2", "author1"]
    places = spark.createDataFrame([(c, i) for i, c in enumerate(log)], "commit_id string, place int")
    prev = {r.commit_id: r.prev_commit_id for r in commit_ops.previous_versions(files.where("file_path = 'file1'").join(places, "commit_id"), "place").collect()}
    assert [prev[c] for c in log[:4]] == [None, *log[:3]]
    assert gitrepo.hunks_of(owned, log[3], log[0], "file1") == [("Change", 1, 2, 1, 1)]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, (7, 2, 0, 3)), ({"authors": "author1"}, (1, 1, 0, 1)), ({"authors_not": "author2|author3"}, (1, 1, 0, 1)), ({"authors_not": "@mail.com"}, (0, 0, 0, 0)),
        ({"files": "/dir1.1/"}, (5, 1, 0, 1)), ({"files": "/dir1.1/", "files_not": "/dir1.1/"}, (0, 0, 0, 0)),
    ],
)
def test_ownership(spark, owned, options, want):
    result = analysed(spark, owned, **options)
    t = result.totals.collect()
    assert (counts(t[0]) if t else (0, 0, 0, 0)) == want
    assert sum(a.lines for a in result.authors.collect()) == want[0]


def test_ownership_csv(spark, owned):
    rows = text.ownership_csv(analysed(spark, owned)).splitlines()
    assert rows[0].startswith("AuthorName;AuthorMail;") and rows[1].startswith("author3;<author3@mail.com>;5;") and rows[1].endswith(";0;0;0")
    assert {r.split(";")[0]: r.split(";")[2] for r in rows[1:]} == {"author3": "5", "author1": "1", "author2": "1"}


def test_copies(spark, copied):
    result = analysed(spark, copied, min_duplicate_lines=2)
    t, authors = result.totals.first(), result.authors.collect()
    assert t.duplicated == 2
    assert sum(a.lines for a in authors) == t.lines
    assert sum(a.duplicated for a in authors) == t.duplicated == sum(a.original + a.original_others for a in authors)
    (g,) = result.groups.collect()
    assert (g.file_path, g.line_count, g.related_count) == ("file1", 2, 2) and [r.related_path for r in result.related.collect()] == ["file2"]
    shown = text.duplicates_text(result)
    assert "file1:1 - 3\n  file2:1 - 3\n" in shown


def touched(spark, repo, only=None, **options):
    """Changes of all commits, or of some; a repository's touches are read once."""
    if (repo, "touches") not in KNOWN:
        read = gitrepo.line_touches(spark, repo, "main")
        rows, order = read.collect(), ", ".join(f"{n} {t}" for n, t in read.dtypes)
        KNOWN[repo, "touches"] = spark.createDataFrame(rows, order).coalesce(1).cache()
    touches = KNOWN[repo, "touches"]
    if only is not None:
        touches = touches.where(F.col("commit_id").isin(only))
    return changes_plan.analyse(touches, ChangesOptions(**options))


@pytest.mark.parametrize(
    ("at", "want"),
    [(0, (1, 0, 0, 0)), (1, (1, 1, 1, 0)), (2, (1, 1, 1, 0)), (3, (0, 1, 0, 1))],
)
def test_each_commit_of_a_file(spark, owned, at, want):
    t = touched(spark, owned, [ids(spark, owned)[at]], files="file1").totals.first()
    assert (t.new_lines, t.changes, t.churn_other, t.churn_own) == want


@pytest.mark.parametrize(
    ("options", "want", "lines"),
    [
        ({}, (5, 2, 8, 3), {"author3": 5, "author1": 4, "author2": 2}), ({"files": "file1"}, (4, 1, 3, 3), {"author1": 4, "author2": 2}),
        ({"files": "file2"}, (1, 1, 5, 0), {"author3": 5}), ({"files": "file1", "authors": "author1"}, (3, 1, 2, 2), {"author1": 4}),
        ({"authors_not": "author1"}, (2, 2, 6, 1), {"author3": 5, "author2": 2}),
    ],
)
def test_changes(spark, owned, options, want, lines):
    result = touched(spark, owned, **options)
    t = result.totals.first()
    assert (t.commits, t.files, t.new_lines, t.changes) == want
    assert t.changes == t.churn_own + t.churn_other + t.refactor_own + t.refactor_other
    assert {a.author_name: a.new_lines + a.changes for a in result.authors.collect() if a.new_lines + a.changes} == lines


def test_changes_reports(spark, owned):
    result = touched(spark, owned)
    full = text.changes_text(result)
    assert "Total authors active: 3" in full and "Total files touched: 2" in full and "- Total lines touched: 11" in full
    assert "New lines: 8 (72%)" in full and "Changed lines: 3 (27%)" in full
    short = text.changes_short_text(result)
    assert "author3 <author3@mail.com>: 5" in short and all(t in short for t in text.TITLES.values())


def test_old_lines_refactor_and_odd_files(spark, tmp_path):
    repo = str(repos.aged(tmp_path / "aged"))
    result = touched(spark, repo)
    by = {a.author_name: a for a in result.authors.collect()}
    # a binary and a large file count for nothing; a name with a space and an accent does
    assert by["ann"].new_lines == 6 and by["bob"].new_lines == 2
    assert (by["bob"].refactor_other, by["bob"].churn_own) == (1, 1)
    assert by["ann"].refactor_own == 1 and by["ann"].refactor_received == 2 and by["ann"].churn_received == 1
    assert (by["cid"].churn_other, by["cid"].refactor_other) == (1, 1)


def test_command_line(spark, owned, tmp_path):
    def call(*args):
        out = io.StringIO()
        return cli.run([*args, "--repo", owned], out), out.getvalue()

    code, shown = call("ownership", "--when", "2024-01-01")
    assert code == 0 and "Total lines: 7" in shown and "author3 <author3@mail.com>: 5 (71.4%)" in shown
    cache = str(tmp_path / "cache.db")
    first = call("changes", "--since", "2023-01-01", "--until", "2024-01-01", "--format", "short", "--cache-file", cache)
    assert first[0] == 0 and "Top Coders" in first[1]
    assert call("changes", "--since", "2023-01-01", "--until", "2024-01-01", "--format", "short", "--cache-file", cache) == first
    assert call("changes", "--since", "2001-01-01", "--until", "2002-01-01")[0] == 3
    assert call("ownership", "--branch", "nope")[0] == 1
    assert call("ownership", "--min-dup-lines", "0")[0] == 1
    first = ids(spark, owned)[0]
    code, shown = call("ownership", "--commit-id", first, "--verbose", "--profile-file", str(tmp_path / "profile"))
    assert code == 0 and "Total lines: 1" in shown and (tmp_path / "profile").stat().st_size > 0
    assert call("changes", "--since-commit", ids(spark, owned)[3], "--until-commit", first)[0] == 2
    code, shown = call("ownership-timeseries", "--since", "2023-11-14", "--until", "2023-11-20", "--period", "2 days")
    assert code == 0 and "Inc/period" in shown and "\nauthor3\n" in shown and "Authors that owns ~5 lines: author3" in shown
    code, shown = call("changes-timeseries", "--since", "2023-11-10", "--until", "2023-11-20", "--period", "5 days")
    # all commits are of one moment: the newest at or before 2023-11-15 begins and ends the only period
    assert code == 0 and ["Total", "1", "1", "5", "5", "0"] in [x.split() for x in shown.splitlines()] and "\nauthor3\n" in shown


def test_pages(spark, owned, tmp_path):
    """Each report as a page: its charts, then the text that is also written out."""
    marks = {"ownership": ["<path d="], "ownership-timeseries": ["<polygon ", "<polyline "], "changes": ["refactor own: "], "changes-timeseries": ["<polygon ", "<polyline "]}
    for command, parts in marks.items():
        out, file = io.StringIO(), tmp_path / f"{command}.html"
        since = ["--since", "2023-11-10", "--until", "2023-11-20", "--period", "5 days"] if command != "ownership" else []
        assert cli.run([command, *since, "--repo", owned, "--html", str(file)], out) == 0
        page = file.read_text(encoding="utf-8")
        ElementTree.fromstring(page.replace("<!doctype html>", "").replace('<meta charset="utf-8">', ""))
        assert html.escape(out.getvalue()) in page and all(x in page for x in parts)


def test_charts():
    assert chart.dense([{"a": "y", "d": 1, "n": 2}, {"a": "x", "d": 2, "n": 3}, {"a": "y", "d": 2, "n": 4}, {"a": "y", "d": 2, "n": 1}], "a", "d", "n") == ([1, 2], {"x": [0, 3], "y": [2, 5]})
    assert "<circle" in chart.pie([("only <one>", 3), ("none", 0)]) and "only &lt;one&gt;: 3 (100.0%)" in chart.pie([("only <one>", 3)])
    assert chart.pie([("a", 1), ("b", 1), ("c", 2)]).count("<path") == 3
    flow = chart.sankey([("all", "new", 3), ("all", "changed", 2), ("changed", "churn", 2)])
    assert flow.count("<path") == 3 and flow.count("<rect") == 4 and "all: 5" in flow
    for empty in (chart.pie([]), chart.lines([], {}), chart.river([], {}), chart.sankey([])):
        ElementTree.fromstring(empty)


def test_previous_versions_follow_branches(spark, tmp_path):
    repo = str(repos.merged(tmp_path / "merged"))
    at = {r.commit_ts: r.commit_id for r in gitrepo.commits(spark, repo).collect()}
    root, side1, main1, side2, merge, last = [at[k] for k in sorted(at)]
    assert [gitrepo.previous_version(repo, c, "f") for c in (root, side1, main1, side2, last)] == [None, root, root, side1, merge]
    assert gitrepo.previous_version(repo, last, "g") == root and gitrepo.previous_version(repo, last, "nope") is None
    result = touched(spark, repo)
    by = {a.author_name: a for a in result.authors.collect()}
    # each change is compared with its own branch's version: cid does not undo bob's line
    assert (by["cid"].changes, by["cid"].churn_other) == (1, 1)
    assert (by["bob"].changes, by["bob"].churn_other, by["bob"].churn_own) == (2, 1, 1)
    assert by["ann"].changes == 1 and by["cid"].churn_received == 1 and by["ann"].churn_received == 2


def test_commit_ranges(spark, owned, tmp_path):
    log = ids(spark, owned)
    ranged = lambda *ends: gitrepo.commit_range(owned, "main", *ends)
    assert ranged() == log[::-1] and ranged(log[2], log[2]) == [log[2]]
    assert ranged(log[1], log[3]) == [log[3], log[2], log[1]] and ranged(log[1]) == log[:0:-1]
    with pytest.raises(ValueError, match="since commit"):
        ranged(log[3], log[1])
    with pytest.raises(ValueError, match="until commit"):
        ranged("", log[1])
    with pytest.raises(RuntimeError):
        ranged("0" * 40, log[1])
    merged = str(repos.merged(tmp_path / "merged"))
    at = {r.commit_ts: r.commit_id for r in gitrepo.commits(spark, merged).collect()}
    root, side1, main1, side2, merge, last = [at[k] for k in sorted(at)]
    assert set(gitrepo.commit_range(merged, "main", root, last)) == {root, side1, main1, side2, merge, last}


def test_samples_are_those_of_the_fixture(spark, tmp_path):
    """Three commits within a second, then two more: a period of a second gives two samples."""
    repo = str(repos.owned(tmp_path / "owned", (0, 0, 0, 2, 2)))
    out = io.StringIO()
    assert cli.run(["ownership-timeseries", "--repo", repo, "--since", "2023-11-14T22:13:20Z", "--until", "2023-11-14T22:13:22Z", "--period", "1 second", "--min-dup-lines", "2"], out) == 0
    table = next(x for x in out.getvalue().split("\n\n") if "Lines " in x)
    assert [x.split()[1] for x in table.splitlines() if x.startswith("2023-")] == ["3", "7"]


def test_periods_hold_each_commit_once():
    day = lambda d, h=0: datetime(2024, 1, 1, h, tzinfo=UTC) + timedelta(days=d)
    log = [(f"c{i}", day(d, h)) for i, (d, h) in enumerate([(0, 5), (0, 9), (3, 1), (11, 0), (12, 0), (29, 0)])][::-1]
    order = [c for c, _ in log]
    span = lambda lo, hi: order[order.index(hi) : order.index(lo) + 1]
    week = lambda at: at - timedelta(days=7)
    got = commit_ops.period_ranges(log, day(-5), day(30), week, span)
    assert got == [["c5", "c4"], ["c3", "c2"]]
    assert commit_ops.period_ranges(log, day(-5), day(30), lambda at: at - timedelta(days=3), span) == [["c5", "c4"], ["c3", "c2"]]
    assert commit_ops.period_ranges(log, day(-5), day(30), lambda at: at - timedelta(hours=12), span)[-2:] == [["c2"], ["c1"]]
    # nothing in the last week: the period before is looked at
    assert commit_ops.period_ranges(log[1:], day(-5), day(30), week, span) == [["c4"], ["c3", "c2"]]
    assert commit_ops.period_ranges([], day(0), day(9), week, span) == []


def test_unreadable_files_are_left_out(spark, owned, monkeypatch):
    files = spark.createDataFrame([(ids(spark, owned)[-1], "file1"), ("0" * 40, "file1")], "commit_id string, file_path string")
    rows = gitrepo.blame(files, owned, keep_failures=True).collect()
    assert sorted(r.line_number for r in rows) == [0, 1, 2]
    versions = files.selectExpr("*", f"'{'1' * 40}' as prev_commit_id")
    assert gitrepo.hunks(versions, owned).count() == 0


def test_latest_commit_before_the_first(spark, owned):
    assert commit_ops.latest(gitrepo.commits(spark, owned), reldate.resolve("2001-01-01")).count() == 0


def test_snapshots_in_one_job(spark, copied):
    log = ids(spark, copied)
    trees = gitrepo.tree_files(spark, copied, log[1:])
    blame = gitrepo.blame(trees, copied)
    result = ownership_plan.analyse(blame, F.current_timestamp(), OwnershipOptions(min_duplicate_lines=2), keys=("commit_id",))
    assert {r.commit_id: (r.lines, r.duplicated) for r in result.totals.collect()} == {log[1]: (4, 2), log[2]: (7, 2), log[3]: (10, 2)}
