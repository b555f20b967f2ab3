"""Commits: ranges, the latest at a time, previous versions of files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.session import with_checkpoints


def in_range(commits: DataFrame, since: datetime | Column, until: datetime | Column, boundary: bool = True) -> DataFrame:
    """Commits of [since, until]; with `boundary` also the parents that lie before the range.

    Without parent_ids the history is linear, and the boundary is the last commit before `since`.
    """
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (since, until))
    inside = commits.where((F.col("commit_ts") >= lo) & (F.col("commit_ts") <= hi))
    if not boundary:
        return inside
    if "parent_ids" in commits.columns:
        parents = inside.select(F.explode("parent_ids").alias("commit_id")).distinct()
        edge = commits.where(F.col("commit_ts") < lo).join(parents, "commit_id", "left_semi")
    else:
        edge = commits.where(F.col("commit_ts") < lo).orderBy(F.col("commit_ts").desc(), F.col("commit_id").desc()).limit(1)
    return inside.unionByName(edge)


def latest(commits: DataFrame, until: datetime | Column) -> DataFrame:
    """The last commit at or before `until`; no row if there is none."""
    hi = until if isinstance(until, Column) else F.lit(until)
    return commits.where(F.col("commit_ts") <= hi).orderBy(F.col("commit_ts").desc(), F.col("commit_id").desc()).limit(1)


def sample_ids(log: list[tuple[str, datetime]], ticks: list[datetime]) -> list[str]:
    """Of log (id, commit time; newest first) the last commit at or before each tick, newest first, each once."""
    out: list[str] = []
    for tick in ticks:
        found = next((c for c, at in log if at <= tick), None)
        if found is None:
            break
        if found not in out:
            out.append(found)
    return out


def period_ranges(log: list[tuple[str, datetime]], since: datetime, until: datetime, back: Callable[[datetime], datetime], range_of: Callable[[str, str], list[str]]) -> list[list[str]]:
    """Commit ids of successive periods, newest period first; no commit is in two.

    log: (id, commit time), newest first. A period reaches from the newest unseen commit at or before
    its `until` back to the newest unseen one at or before `until` less a period, ends included; one
    commit before `since` may begin it, as in a range of dates. The next period ends on the day that
    this one began; a period without unseen commits is skipped.
    """
    seen: set[str] = set()
    out = []
    low = back(until)

    def newest(first: datetime, last: datetime) -> str | None:
        inside = [c for c, at in log if first <= at <= last]
        edge = next((c for c, at in log if at < first), None) if inside else None
        return next((c for c in [*inside, edge] if c is not None and c not in seen), None)

    times = dict(log)
    while (begin := newest(since, low)) is not None:
        end = newest(times[begin], until)
        if end is None:
            low, until = back(low), back(until)
            continue
        ids = [c for c in range_of(begin, end) if c not in seen]
        seen.update([begin, *ids])
        out.append(ids)
        until = times[begin].replace(hour=23, minute=59, second=59, microsecond=999_999)
        low = back(times[begin].replace(hour=0, minute=0, second=0, microsecond=0))
    return out


def previous_versions(file_commits: DataFrame, order: str = "commit_ts") -> DataFrame:
    """file_commits (file_path, commit_id, ...) with prev_commit_id, the one before that touched the file.

    For tables of linear history; a repository's branches are followed by gitrepo.previous_version().
    """
    w = Window.partitionBy("file_path").orderBy(order, "commit_id")
    return file_commits.withColumn("prev_commit_id", F.lag("commit_id").over(w))


def symmetric_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of exactly one of two sets of commits."""
    return one.exceptAll(one.intersect(other)).unionByName(other.exceptAll(other.intersect(one))).distinct()


def by_id(commits: DataFrame, ids: DataFrame) -> DataFrame:
    """The commits whose id is among the rows of ids (commit_id)."""
    return commits.join(ids, "commit_id", "left_semi")


def tips(parents: DataFrame) -> DataFrame:
    """commit_id of the commits that are no other's parent. parents: commit_id, parent_id."""
    taken = parents.where("parent_id is not null").select(F.col("parent_id").alias("commit_id"))
    return parents.select("commit_id").distinct().join(taken, "commit_id", "left_anti")


def ancestors(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """commit_id of the tips (commit_id) that are known and of all their ancestors. parents: commit_id, parent_id.

    Rounds of one join each, as many as the longest path from a tip; every round joins only the
    commits that are new.
    """
    links = parents.where("parent_id is not null").select(F.col("commit_id").alias("child"), F.col("parent_id").alias("commit_id")).distinct()
    with_checkpoints(parents.sparkSession)
    reached = new = parents.select("commit_id").distinct().join(tips, "commit_id", "left_semi").checkpoint()
    while True:
        found = links.join(new.select(F.col("commit_id").alias("child")), "child", "left_semi").select("commit_id").distinct()
        new = found.join(reached, "commit_id", "left_anti").checkpoint()
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new).checkpoint()
