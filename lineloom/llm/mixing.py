"""Mixing sources to target weights by entropy balancing.

Among all document rates, those nearest to 1 in relative entropy that meet every source's token
target are exponentially tilted: rate = exp(lambda[source] * size / mean size), stopped at the
limit of repeats. The multipliers solve a convex dual, whose gradient and curvature are sums over
documents; guarded Newton steps take them from a (source, size) histogram until every source's
tokens meet its target. Rates are then rounded to whole copies: all rows of a source are ranked
by a hash less the fraction of their rate, and the rank up to which they get one copy more is
chosen so that the source's tokens come as near its target as a whole document allows.

Defined results: null text has size 0; a document of size 0 is taken once; the null source comes last; sources without tokens have
target 0; rows that repeat an id are rounded alike; an empty table gives an empty result. Sums
are exact decimals, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.common import SPACED_WORD, drop_spool, spool

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Copies of a document, and multiple of a source's tokens, at most.
LIMIT = 3
TOLERANCE, MOST_STEPS = 1e-9, 80
#: Bins of a level, and levels, within which the rank of the cut is sought; FANOUT is a power of 2.
FANOUT, LEVELS = 256, 3
EXACT = "decimal(38,6)"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A key that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """sizes (key, source_size) with target: all tokens shared by weight, sources stopped at
    `limit` times their own and the excess shared among the rest until none is above."""
    # a row for each source: one task holds them
    place = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * limit).withColumn("ratio", F.col("most") / F.col("weight"))
    upward = Window.orderBy("ratio", "key")
    before = F.coalesce(F.sum("most").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everyone = Window.partitionBy()
    # sources from this one on share what the stopped ones before it leave
    rows = rows.withColumn("level", (F.sum("source_size").over(everyone) - before) / rest)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everyone)
    level = F.max(F.when((F.col("level") <= F.col("ratio")) & (F.col("ratio") == free), F.col("level"))).over(everyone)
    return rows.select("key", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def rate(lam: Column, size: Column, mean: Column, limit: float = LIMIT) -> Column:
    return F.when(mean > 0, F.exp(F.least(lam * size / mean, F.lit(math.log(limit) + 1)))).otherwise(F.lit(1.0))


def multipliers(histogram: DataFrame, goals: DataFrame, limit: float = LIMIT) -> DataFrame:
    """goals (key, source_size, target) with mean and lam. histogram: key, size, n."""
    shape = histogram.where("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    x = F.col("least") / F.col("mean")
    share = F.try_divide("target", "source_size")  # null of a source without tokens, which has nothing to solve
    now = goals.join(shape, "key", "left").select(
        "key", "source_size", "target", F.coalesce("mean", F.lit(0.0)).alias("mean"),
        # every rate is at the limit at `high`, and no tokens above the target are left at `low`
        F.when(share < 1, F.log(share) / x).otherwise(0.0).alias("low"), F.when(share > 1, math.log(limit) / x).otherwise(0.0).alias("high"),
        F.when(share >= limit, math.log(limit) / x).otherwise(0.0).alias("lam"), (F.col("source_size") == 0).alias("done"),
    )
    now = spool(now, "multipliers")
    for _ in range(MOST_STEPS):
        w = rate(F.col("lam"), F.col("size"), F.col("mean"), limit)
        tokens = F.col("size") * F.col("n") * F.least(w, F.lit(float(limit)))
        slope = F.when(w < limit, F.col("size") * F.col("n") * w * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = histogram.where("size > 0").join(now.where("not done").select("key", "lam", "mean"), "key").groupBy("key").agg(F.sum(tokens.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        step = now.join(sums, "key", "left")
        above = F.col("got") > F.col("target")
        low = F.when(above, F.col("low")).otherwise(F.col("lam"))
        high = F.when(above, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.log("got") - F.log("target")) * F.col("got") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= F.col("target") * TOLERANCE) | (high - low <= 1e-12 * F.abs(high))
        step = step.select(
            "key", "source_size", "target", "mean",
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            F.when(done, F.col("lam")).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("lam"), done.alias("done"),
        )
        last, now = now, spool(step, "multipliers")
        drop_spool(last)
        if now.where("not done").isEmpty():
            break
    return now.select("key", "source_size", "target", "mean", "lam")


def copy_parts(size: Column, place: Column, limit: float = LIMIT) -> tuple[Column, Column]:
    """Of columns lam and mean: sure copies, and the row's rank; the least ranks get one more."""
    w = F.least(rate(F.col("lam"), size, F.col("mean"), limit), F.lit(float(limit)))
    sure = F.floor(w).cast("long")
    uniform = F.shiftrightunsigned(place, 12) / F.lit(float(1 << 52))
    return sure, F.when(w < limit, uniform - (w - sure))


def bin_of(rank: Column, level: int = LEVELS) -> Column:
    """The bin of a rank, between -1 and 1, among the FANOUT ** level bins of a level."""
    return F.shiftright(F.floor((rank + 1) * (FANOUT**LEVELS // 2)).cast("long"), (LEVELS - level) * (FANOUT.bit_length() - 1))


def cuts(rows: DataFrame, params: DataFrame, limit: float = LIMIT) -> DataFrame:
    """params with cut_bin and cut: ranks of lower bins, and those up to `cut` of this bin, get one copy more.

    rows: key, size, place. The bin is narrowed down level by level: a source brings FANOUT sums to
    a task at most, however many rows it has.
    """
    sure, rank = copy_parts(F.col("size"), F.col("place"), limit)
    ranked = rows.where("size > 0").join(params, "key").select("key", "size", sure.alias("sure"), rank.alias("rank"))
    surely = ranked.groupBy("key").agg(F.sum(F.col("sure") * F.col("size")).alias("sure"))
    # written, so that its size is known: a row for each source is broadcast, and rows need not meet by source
    now = spool(params.join(surely, "key").select("key", (F.col("target") - F.col("sure")).alias("need"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bin")), "mix-bins")
    ranked = ranked.where("rank is not null").drop("sure")
    for level in range(1, LEVELS + 1):
        inside = ranked.join(now.withColumnRenamed("bin", "above"), "key").where(bin_of(F.col("rank"), level - 1) == F.col("above"))
        sums = inside.groupBy("key", "need", "before", bin_of(F.col("rank"), level).alias("bin")).agg(F.sum("size").alias("tokens"))
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("key").orderBy("bin"))
        edge = sums.withColumn("upto", upto).where("upto >= need").groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"), "need")).alias("b"))
        now = spool(edge.select("key", "b.*"), "mix-bins")
    # within that bin, rank by rank; equal ranks are one
    edge = ranked.withColumn("bin", bin_of(F.col("rank"))).join(now, ["key", "bin"]).groupBy("key", "rank", "before", "need").agg(F.sum("size").alias("tokens"))
    off = F.abs(F.col("before") + F.sum("tokens").over(Window.partitionBy("key").orderBy("rank")) - F.col("need"))
    best = edge.withColumn("off", off).groupBy("key").agg(F.min(F.struct("off", "rank")).alias("best"))
    # none of the bin's, if that comes nearer
    best = now.join(best, "key").select("key", F.col("bin").alias("cut_bin"), F.when(F.abs(F.col("before") - F.col("need")) <= F.col("best.off"), -2.0).otherwise(F.col("best.rank")).alias("cut"))
    # a source whose bins all lie below the need takes every one
    return params.join(best, "key", "left").withColumns({"cut_bin": F.coalesce("cut_bin", F.lit(FANOUT**LEVELS)), "cut": F.coalesce("cut", F.lit(2.0))})


def place_of(doc_id: Column, size: Column) -> Column:
    return F.xxhash64(doc_id, size)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, params): rows (id, key, size, place) of docs; params (key, source_size, target, mean, lam, cut_bin, cut)."""
    size = size_of(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), size.alias("size"))
    rows = spool(rows.withColumn("place", place_of(F.col("id"), F.col("size"))), "sizes")
    histogram = spool(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "histogram")
    goals = spool(targets(histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, limit), "targets")
    return rows, spool(cuts(rows, multipliers(histogram, goals, limit), limit), "mix")


def copies_of(rows: DataFrame, limit: float = LIMIT) -> Column:
    """Whole copies of each of rows (size, place, lam, mean, cut_bin, cut)."""
    sure, rank = copy_parts(F.col("size"), F.col("place"), limit)
    more = (bin_of(rank) < F.col("cut_bin")) | ((bin_of(rank) == F.col("cut_bin")) & (rank <= F.col("cut")))
    return F.when(F.col("size") == 0, F.lit(1)).otherwise(sure + F.coalesce(more.cast("long"), F.lit(0)))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    rows, params = plan(docs, **options)
    mixed = rows.join(params, "key")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies_of(mixed)).alias("taken"), copies_of(mixed).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the columns of `docs`."""
    _, params = plan(docs, id_col, text_col, source_col, **options)
    size = size_of(F.col(text_col))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), source_key(F.col(source_col)).alias("key"), size.alias("size"), F.col(id_col).alias("id"))
    whole = whole.withColumn("place", place_of(F.col("id"), F.col("size"))).join(params, "key")
    return whole.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.nullif(copies_of(whole).cast("long"), F.lit(0).cast("long"))))).select("whole.*")
