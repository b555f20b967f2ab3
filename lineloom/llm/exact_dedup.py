"""Exact dedup as a stateful stream.

Documents arrive as files. A streaming aggregation keeps, for every SHA-256 of a normalised
text, the largest stable identifier seen, the locator (file and row) of that document, and a
count. That state lives in RocksDB, is checkpointed in the shared folder and never expires.
Documents whose digest is shared are then compared, byte by byte, with the retained document,
fetched by its locator. Only built-in expressions run.

Defined results: null text counts as empty; a null id sorts below every other; of rows that
repeat an id and text, exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import ascii_lower, located, shared_dir, spool, with_places

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State stores on disk, without room taken in advance for each partition's logs.
STORE = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Copies that are compared with one fetched keeper in one task at most, on average.
COPIES_PER_TASK = 4096


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_stream(spark: SparkSession, path: str, schema, trigger_bytes: int) -> DataFrame:
    """A file stream over `path`, a Parquet file or a folder of them."""
    # a stream wants a folder or a pattern; this pattern matches the path alone
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")


def keyed_state(arrivals: DataFrame, state_dir: str, stores: int | None = None) -> DataFrame:
    """Runs the stream `arrivals` (digest, id, at_file, at_row) to its present end.

    Returns digest, last (struct of id, at_file, at_row) and n, as the state store holds them.
    A second call with the same `state_dir` goes on from the first one's state. stores: how many
    stores share the keys, fixed by the first run; spark.sql.shuffle.partitions if not given.
    """
    spark = arrivals.sparkSession
    wanted = STORE | ({"spark.sql.shuffle.partitions": str(stores)} if stores else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = (
            arrivals.groupBy("digest").agg(F.max(F.struct("id", "at_file", "at_row")).alias("last"), F.count("*").alias("n"))
            .writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if query.lastProgress is None:  # no file has arrived yet, so there is no state to read
        return spark.createDataFrame([], "digest binary, last struct<id:bigint,at_file:string,at_row:bigint>, n bigint")
    return spark.read.format("statestore").load(state_dir).select(F.col("key.digest"), F.col("value.max").alias("last"), F.col("value.count").alias("n"))


def verdicts(docs: DataFrame, state: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """at_file, at_row, id, digest, last, n, same: whether the row's bytes are the keeper's."""
    alone = state.where("n = 1").select("last.at_file", "last.at_row", "last.id", "digest", "last", "n", F.lit(True).alias("same"))
    text = ascii_lower(F.col(text_col))
    rows = located(docs, F.col(id_col).alias("id"), text.alias("body"), digest(text).alias("digest"))
    # whole texts are shuffled here alone; only those that share a digest go on
    hits = spool(rows.join(state.where("n > 1"), "digest").withColumn("parts", F.ceil(F.col("n") / COPIES_PER_TASK)), "dedup-hits")
    is_keeper = (F.col("at_file") == F.col("last.at_file")) & (F.col("at_row") == F.col("last.at_row"))
    keepers = hits.where(is_keeper).select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hits = hits.withColumn("part", F.pmod(F.xxhash64("at_file", "at_row"), F.col("parts")))
    compared = hits.join(keepers, ["digest", "part"]).select("at_file", "at_row", "id", "digest", "last", "n", (F.col("body") == F.col("kept_body")).alias("same"))
    return alone.unionByName(compared)


def exact_dedup(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, trigger_bytes: int = 64 << 30, state_dir: str | None = None, stores: int | None = None) -> DataFrame:
    """One row per row of `docs`: at_file, at_row, id, keep_id, group_size, kept, digest.

    path: the files of `docs`, streamed as they are; without it, a thin table of digests and
    locators is written to the shared folder and streamed. trigger_bytes: input of a micro-batch.
    state_dir, stores: see keyed_state().
    """
    spark = docs.sparkSession
    state_dir = state_dir or shared_dir(spark, "dedup-state")
    if path:
        source = as_stream(spark, path, docs.schema, trigger_bytes)
        meta = F.col("_metadata")
        arrivals = source.select(digest(ascii_lower(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), meta["file_path"].alias("at_file"), meta["row_index"].alias("at_row"))
    else:
        docs = with_places(docs)
        thin = located(docs, digest(ascii_lower(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"))
        folder = shared_dir(spark, "dedup-arrivals")
        thin.write.mode("append").parquet(folder)
        arrivals = as_stream(spark, folder, thin.schema, trigger_bytes)
    found = spool(verdicts(docs, keyed_state(arrivals, state_dir, stores), id_col, text_col, digest), "dedup-verdicts")
    is_keeper = F.col("at_file").eqNullSafe(F.col("last.at_file")) & F.col("at_row").eqNullSafe(F.col("last.at_row"))
    plain = found.select("at_file", "at_row", "id", F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"), is_keeper.alias("kept"), "digest")
    if found.where("not same").isEmpty():
        return plain
    # texts of one digest that differ: the bytes decide, grouped as whole texts
    odd = found.where("not same").select("at_file", "at_row")
    texts = located(docs, F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("body")).join(odd, ["at_file", "at_row"])
    groups = texts.groupBy("body").agg(F.max(F.struct("id", "at_file", "at_row")).alias("last"), F.count("*").alias("group_size"))
    apart = texts.join(groups, "body").select("at_file", "at_row", "id", F.col("last.id").alias("keep_id"), "group_size", is_keeper.alias("kept"), digest(F.col("body")).alias("digest"))
    gone = found.where("not same").groupBy("digest").agg(F.count("*").alias("gone"))
    together = found.where("same").join(gone, "digest", "left").select("at_file", "at_row", "id", F.col("last.id").alias("keep_id"), (F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"), is_keeper.alias("kept"), "digest")
    return together.unionByName(apart)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    docs = with_places(docs)
    dropped = exact_dedup(docs, id_col=id_col, text_col=text_col).where("not kept").select("at_file", "at_row")
    whole = located(docs, F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    return whole.join(dropped, ["at_file", "at_row"], "left_anti").select("whole.*")
