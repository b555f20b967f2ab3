"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_matches(path: Column, files: str = ".*", files_not: str = "") -> Column:
    """Paths that are not blank, match `files` anywhere, and do not match `files_not`."""
    keep = F.trim(path) != ""
    if files not in ("", ".*"):
        keep = keep & path.rlike(files)
    return keep & ~path.rlike(files_not) if files_not else keep


def author_matches(name: Column, mail: Column, authors: str = ".*", authors_not: str = "") -> Column:
    """Name or mail matches `authors`, and neither matches `authors_not`."""
    keep = F.lit(True) if authors in ("", ".*") else name.rlike(authors) | mail.rlike(authors)
    return keep & ~name.rlike(authors_not) & ~mail.rlike(authors_not) if authors_not else keep


def author_filter(name: Column, mail: Column, authors: str = ".*", authors_not: str = "") -> Column | None:
    """author_matches(), or None if every author does."""
    return author_matches(name, mail, authors, authors_not) if authors not in ("", ".*") or authors_not else None


def text_files(tree: DataFrame, max_bytes: int = 80_000) -> DataFrame:
    """Files of a snapshot that are text and not above `max_bytes`."""
    return tree.where((F.col("size") <= max_bytes) & ~F.col("is_binary"))


def not_blank(contents: Column) -> Column:
    """Lines that hold more than spaces; a tab counts as more."""
    return F.trim(contents) != ""


def fresh(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Cache entries used within the last `ttl_seconds`."""
    return entries.where(F.col("last_access") > now - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
