"""ownership and duplicates over canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.operators import duplicates, ownership
from lineloom.operators.filters import author_matches, file_matches, text_files
from lineloom.options import OwnershipOptions


@dataclass(frozen=True)
class Ownership:
    """Lazy results of one snapshot."""

    totals: DataFrame
    authors: DataFrame
    found: DataFrame
    k: int

    @property
    def groups(self) -> DataFrame:
        return duplicates.duplicate_groups(self.found, self.k)

    @property
    def related(self) -> DataFrame:
        return duplicates.related_runs(self.found, self.k)


def analyse(blame: DataFrame, snapshot_ts: Column, options: OwnershipOptions = OwnershipOptions(), tree: DataFrame | None = None, keys: tuple[str, ...] = ()) -> Ownership:
    """Ownership of the lines of `blame` at `snapshot_ts`.

    File filters come before the windows; author filters only flag lines, since windows are
    compared across all authors. keys: further columns that set snapshots apart.
    """
    lines = blame.where(file_matches(F.col("file_path"), options.files, options.files_not))
    if tree is not None:
        lines = lines.join(text_files(tree, options.max_file_bytes).select("commit_id", "file_path"), ["commit_id", "file_path"], "left_semi")
    counted = author_matches(F.col("author_name"), F.col("author_mail"), options.authors, options.authors_not)
    first_counted = author_matches(F.col("first.author_name"), F.col("first.author_mail"), options.authors, options.authors_not)
    owned = ownership.owned_lines(lines, snapshot_ts, counted)
    found = duplicates.occurrences(lines, options.min_duplicate_lines, options.min_line_bytes, keys or ("commit_id",), least=2)
    copied = ownership.copied_lines(found, options.min_duplicate_lines, counted, first_counted, keys)
    return Ownership(ownership.totals(owned, copied, keys), ownership.by_author(owned, copied, keys), found, options.min_duplicate_lines)
