"""Time series: samples, periods, deltas, totals, pivots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.numbers import difference, percent


def samples(commits: DataFrame, ticks: list[datetime]) -> DataFrame:
    """tick, commit_id, commit_ts: the last commit at or before each tick, each commit once, at its latest tick.

    A commit is matched with the first tick that it does not lie after, the last commit of each such
    gap is kept, and a running maximum over the ticks carries it on; the plan is as large for any number of ticks.
    """
    axis = sorted(set(ticks))
    if not axis:
        return commits.select(F.col("commit_ts").alias("tick"), "commit_id", "commit_ts").limit(0)
    marks = F.array(*[F.lit(t) for t in axis])
    # how many ticks lie before the commit: its gap's place
    gap = F.size(F.filter(marks, lambda t: t < F.col("commit_ts")))
    last = commits.select(gap.alias("gap"), F.struct("commit_ts", "commit_id").alias("c")).where(F.col("gap") < len(axis)).groupBy("gap").agg(F.max("c").alias("c"))
    ticked = commits.sparkSession.createDataFrame(list(enumerate(axis)), "gap int, tick timestamp")
    # a row for each tick, on one axis
    upto = F.max("c").over(Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    rows = ticked.join(last, "gap", "left").withColumn("c", upto).where("c is not null")
    return rows.groupBy("c").agg(F.max("tick").alias("tick")).select("tick", F.col("c.commit_id").alias("commit_id"), F.col("c.commit_ts").alias("commit_ts"))


def period_of(ts: Column, until: datetime, days: int) -> Column:
    """0 for the period of so many days that ends at `until`, 1 for the one before it, and so on."""
    seconds = days * 86_400
    return F.floor((F.unix_micros(F.lit(until)) - F.unix_micros(ts)) / (seconds * 1_000_000)).cast("int")


def deltas(series: DataFrame, order: str, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """The series with <measure>_delta: the change from the row before; null after nothing."""
    w = Window.partitionBy(*keys).orderBy(order)
    return series.select("*", *[difference(F.col(m), F.lag(m).over(w)).alias(f"{m}_delta") for m in measures])


def growth(series: DataFrame, order: str, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, <measure>_growth (last less first) and <measure>_percent of it."""
    ends = series.groupBy(*keys).agg(*[x for m in measures for x in (F.min_by(m, order).alias(f"{m}_first"), F.max_by(m, order).alias(f"{m}_last"))])
    first, last = (lambda m: F.col(f"{m}_first")), (lambda m: F.col(f"{m}_last"))
    return ends.select(*keys, *[x for m in measures for x in ((last(m) - first(m)).alias(f"{m}_growth"), percent(last(m) - first(m), first(m)).alias(f"{m}_percent"))])


def with_total(series: DataFrame, label: str, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """label (as text) and measures of the series, and a row "Total" that sums the rows."""
    total = series.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]).withColumn(label, F.lit("Total"))
    return series.select(*keys, F.col(label).cast("string").alias(label), *measures).unionByName(total.select(*keys, label, *measures))


def last_of_day(rows: DataFrame, keys: list[str], date: str, order: list[str]) -> DataFrame:
    """Of rows of one key and date the last by `order`."""
    w = Window.partitionBy(*keys, date).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def dense(rows: DataFrame, key: str, date: str, measures: list[str]) -> DataFrame:
    """rows filled up with zeros, so that every key has every date.

    `rows` are the sums that a chart shows, one for each key and date; they are kept, since they give
    the axes too. Dates are the chart's axis, a value for each sample or period: a row of them is
    joined to the keys, so the result has keys times dates rows by definition. How it is joined
    follows from its measured size.
    """
    rows = rows.persist()
    dates = rows.select(F.lit(1).alias("__one"), date).distinct().groupBy("__one").agg(F.collect_set(date).alias("__dates"))
    axes = rows.select(key).distinct().withColumn("__one", F.lit(1)).join(dates, "__one").select(key, F.explode("__dates").alias(date))
    return axes.join(rows, [key, date], "left").select(key, date, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])
