"""A live feed of commits, summed by time windows; an extension, the batch queries don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_commits(commits: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """window_start, author_name, commits of a stream that may repeat commits; rows later than `late`
    are dropped, and so is the state of windows and commits that no row can reach any more."""
    once = commits.withWatermark("commit_ts", late).dropDuplicatesWithinWatermark(["commit_id"])
    counted = once.groupBy(F.window("commit_ts", window).alias("w"), "author_name").agg(F.count("*").alias("commits"))
    return counted.select(F.col("w.start").alias("window_start"), "author_name", "commits")
