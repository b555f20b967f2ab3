"""Sharding by vector bin packing.

Items carry (bytes, tokens, rows) as shares of all. Texts are grouped by digest; a group that
holds a sizeable share is an item of its own, split into pieces where one shard could not take
it, and all other groups share a fixed number of buckets by digest, so equal texts stay
together. Items are few however large the table is: they are placed one by one, largest first,
in the shard where the dot product with the residual capacity is highest (of equal items and of
equal shards the first; items are in order of their names).

Slots are dealt in units of bounded rows: a unit's offset within its shard plus its row number.

Law `bytes`: the shards' sizes are near equal. Defined results: null text has size 8 and the
checksum of no bytes; rows that repeat an id have slots of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm.common import local_table, located, spool, with_places
from lineloom.llm.mixing import size_of

SHARDS, LAW = 24, "bytes"
#: Bytes that each row adds to its text's.
OVERHEAD = 8
#: Buckets for a shard that ordinary groups are dealt to.
BUCKETS_PER_SHARD = 512
#: A group that holds more than this share of a shard is an item of its own, in pieces of it at most.
LARGE = 0.25
#: Rows of a unit within which one task numbers slots, on average.
UNIT_ROWS = 65_536
#: What bytes, tokens and rows weigh in the dot product; bytes lead, as the law asks.
WEIGHTS = (1.0, 0.25, 0.25)


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item; vectors: (items, dimensions), each dimension a share of all."""
    need = vectors * shards * np.asarray(weights)
    left = np.repeat(np.asarray(weights, float)[None, :], shards, axis=0)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-need.max(axis=1), kind="stable"):
        # what has run over in one dimension counts against a shard, so residuals may be negative
        out[i] = np.argmax(left @ need[i])
        left[out[i]] -= need[i]
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    thin = located(with_places(docs), F.col(id_col).alias("doc_id"), (F.length(body).cast("long") + OVERHEAD).alias("size"), size_of(F.col(text_col)).alias("tokens"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"))
    thin = spool(thin, "shard-rows")
    total = thin.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    total = [max(1, x or 0) for x in total]
    groups = thin.groupBy("digest").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    share = F.greatest(F.col("b") / total[0], F.col("t") / total[1], F.col("n") / total[2])
    # at most 3 / (LARGE / shards) groups, whatever the table holds: three sums of shares, each 1
    large = spool(groups.where(share > LARGE / shards).select("digest", F.ceil(share * shards / LARGE).cast("long").alias("pieces")), "shard-large")
    buckets = shards * BUCKETS_PER_SHARD
    place = F.xxhash64("at_file", "at_row")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(place, F.col("pieces")))
    # large has a proven bound
    rows = thin.join(F.broadcast(large), "digest", "left").withColumn("bucket", F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("string")).otherwise(F.concat_ws("-", F.hex("digest"), piece)))
    sums = spool(rows.groupBy("bucket").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")), "shard-items")
    # as many items as buckets, plus the pieces of the large groups
    items = sums.orderBy("bucket").collect()
    vectors = np.array([[x["b"] / total[0], x["t"] / total[1], x["n"] / total[2]] for x in items]).reshape(-1, 3)
    where = pack(vectors, shards)
    placed = local_table(spark, [{"bucket": x["bucket"], "shard": int(s), "units": -(-x["n"] // UNIT_ROWS)} for x, s in zip(items, where, strict=True)], "bucket:string,shard:int,units:bigint")
    rows = rows.join(F.broadcast(placed), "bucket").withColumn("unit", F.pmod(F.xxhash64(F.lit(1), "at_file", "at_row"), F.col("units")))
    units = rows.groupBy("shard", "bucket", "unit").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket", "unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.select("bucket", "unit", offset.alias("offset"))
    number = F.row_number().over(Window.partitionBy("bucket", "unit").orderBy("doc_id", "at_file", "at_row")) - 1
    numbered = rows.select("doc_id", "size", "text_crc32", "shard", "bucket", "unit", number.cast("long").alias("number"))
    return numbered.join(units, ["bucket", "unit"]).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("offset") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, **options) -> None:
    """Writes the assignment, a folder for each shard; a shard's files hold successive runs of slots."""
    shard(docs, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
