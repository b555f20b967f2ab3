"""Who owns the lines of a snapshot, how old they are, and how many are copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.numbers import age_days
from lineloom.operators import duplicates
from lineloom.operators.filters import not_blank


def owned_lines(lines: DataFrame, snapshot_ts: Column, counted: Column) -> DataFrame:
    """Lines that are not blank and whose author counts, with their age in days."""
    return lines.where(not_blank(F.col("contents")) & counted).withColumn("age_days", age_days(snapshot_ts, F.col("author_ts")))


def copied_lines(found: DataFrame, k: int, name_counts: Column, first_counts: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """author_name, duplicated, original, original_others: what each later copy of a window adds.

    A copy adds k lines to its author, if that author counts; to the author's own originals if
    the first occurrence is theirs too, else to the first author's originals that others copied,
    if that author counts.
    """
    copies = found.where(~F.col("is_first"))
    own = F.col("author_name") == F.col("first.author_name")
    zero = F.lit(0)
    mine = F.struct(F.col("author_name").alias("who"), F.lit(k).alias("duplicated"), F.when(own, k).otherwise(0).alias("original"), zero.alias("original_others"))
    theirs = F.struct(F.col("first.author_name").alias("who"), zero.alias("duplicated"), zero.alias("original"), F.lit(k).alias("original_others"))
    parts = F.array(F.when(name_counts, mine), F.when(name_counts & ~own & first_counts, theirs))
    return copies.select(*keys, F.inline(F.filter(parts, lambda p: p.isNotNull()))).withColumnRenamed("who", "author_name")


def by_author(owned: DataFrame, copied: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per author: lines, age_days_sum, duplicated, original, original_others, author_mail."""
    lines = owned.groupBy(*keys, "author_name").agg(
        F.count("*").alias("lines"), F.sum("age_days").alias("age_days_sum"),
        F.max(F.struct("author_ts", "file_path", "line_number", "author_mail"))["author_mail"].alias("author_mail"),
    )
    copies = copied.groupBy(*keys, "author_name").agg(*[F.sum(c).alias(c) for c in ("duplicated", "original", "original_others")])
    both = lines.join(copies, [*keys, "author_name"], "full")
    fill = {"lines": 0, "age_days_sum": 0.0, "duplicated": 0, "original": 0, "original_others": 0}
    return both.select(*keys, "author_name", "author_mail", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])


def ranked(authors: DataFrame) -> DataFrame:
    """authors with `place` by owned lines, then name, and `age_days`, the average age of their lines (null without lines)."""
    place = F.row_number().over(Window.orderBy(F.col("lines").desc(), "author_name"))
    return authors.withColumns({"place": place, "age_days": F.try_divide("age_days_sum", "lines")})


def totals(owned: DataFrame, copied: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """files, lines, authors, age_days_sum, duplicated of the snapshot (of each, with keys)."""
    per_file = owned.groupBy(*keys, "file_path").agg(F.count("*").alias("n"), F.sum("age_days").alias("age"))
    per_author = owned.groupBy(*keys, "author_name").agg(F.lit(1).alias("one"))
    a = per_file.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("n").alias("lines"), F.sum("age").alias("age_days_sum"))
    b = per_author.groupBy(*keys).agg(F.count("*").alias("authors"))
    c = copied.groupBy(*keys).agg(F.sum("duplicated").alias("duplicated"))
    if keys:
        joined = a.join(b, list(keys), "left").join(c, list(keys), "left")
    else:  # three single rows
        joined = a.join(b).join(c)
    return joined.select(*keys, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("files", "lines", "authors", "age_days_sum", "duplicated")])


def copies_of(lines: DataFrame, k: int, counted: Column, first_counted: Column, min_bytes: int = duplicates.MIN_LINE_BYTES, keys: tuple[str, ...] = ()) -> DataFrame:
    found = duplicates.occurrences(lines, k, min_bytes, keys or ("commit_id",))
    return copied_lines(found, k, counted, first_counted, keys)
