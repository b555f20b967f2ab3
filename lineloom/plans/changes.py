"""changes over canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators import changes
from lineloom.operators.filters import author_filter, file_matches
from lineloom.options import ChangesOptions


@dataclass(frozen=True)
class Changes:
    """Lazy results of one range (of each, with keys)."""

    parts: DataFrame
    touched: DataFrame
    keys: tuple[str, ...] = ()

    @property
    def totals(self) -> DataFrame:
        return changes.totals(self.parts, self.touched, self.keys)

    @property
    def authors(self) -> DataFrame:
        return changes.by_author(self.parts, self.keys)

    @property
    def files(self) -> DataFrame:
        return changes.by_author_file(self.parts, self.keys)


def analyse(touches: DataFrame, options: ChangesOptions = ChangesOptions(), keys: tuple[str, ...] = ()) -> Changes:
    """Sums of the line touches of a range of commits.

    keys: columns of the touches that set ranges apart, such as the period of a commit; all ranges
    are one job. A commit belongs to one range.
    """
    rows = touches.where(file_matches(F.col("file_path"), options.files, options.files_not))
    parts = changes.contributions(changes.classified(rows, options.refactor_after_hours), keys)
    counts = author_filter(F.col("author_name"), F.col("author_mail"), options.authors, options.authors_not)
    parts = changes.counted(parts, counts)
    # without a filter every touch counts, so what was touched needs no classification
    touched = (rows if counts is None else parts.where("touch")).select(*keys, "commit_id", "file_path")
    return Changes(parts, touched, keys)
