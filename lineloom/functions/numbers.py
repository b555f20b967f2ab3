"""Percentages and differences as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(value: Column, total: Column) -> Column:
    """Whole percent, cut towards zero; null where the total is 0."""
    return F.try_divide(100 * value.cast("double"), total.cast("double")).cast("bigint")


def percent_text(value: Column, total: Column) -> Column:
    """" (n%)", or nothing where the total is 0."""
    return F.coalesce(F.concat(F.lit(" ("), percent(value, total).cast("string"), F.lit("%)")), F.lit(""))


def difference(now: Column, before: Column) -> Column:
    """now - before; null where there was nothing before."""
    return F.when(before != 0, now - before)


def difference_text(now: Column, before: Column) -> Column:
    """" (+n)" or " (-n)"; seven spaces where there was nothing before."""
    d = difference(now, before)
    return F.coalesce(F.concat(F.when(d > 0, " (+").otherwise(" ("), d.cast("string"), F.lit(")")), F.lit(" " * 7))


def difference_percent_text(now: Column, before: Column) -> Column:
    d = difference(now, before)
    p = F.when(before != 0, percent(now - before, before))
    return F.coalesce(F.concat(F.when(d > 0, " (+").otherwise(" ("), p.cast("string"), F.lit("%)")), F.lit(" " * 7))


def coder_score(new: Column, refactor_other: Column, refactor_own: Column, churn_own: Column, churn_received: Column) -> Column:
    """What ranks top coders: new lines and refactoring count for, churn against."""
    return new + 3 * refactor_other + 2 * refactor_own - 2 * churn_own - 4 * churn_received


def age_days(at: Column, line_ts: Column) -> Column:
    """Days from a line's time to `at`, with fraction; negative if the line is younger."""
    return (F.unix_micros(at) - F.unix_micros(line_ts)) / F.lit(86_400e6)
