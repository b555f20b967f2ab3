"""Canonical tables made from general-purpose ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at its end starts no further line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def documents_as_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_files: a file for each document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "lang", "source", "doc_id")
    return d.select(F.lit("head").alias("commit_id"), path.alias("file_path"), F.octet_length("text").cast("bigint").alias("size"), F.lit(False).alias("is_binary"))


def documents_as_blame(spark: SparkSession, sf_dir: str, max_bytes: int = 80_000) -> DataFrame:
    """blame_lines: documents up to `max_bytes` are files; their source is the author."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where((F.octet_length("text") <= max_bytes) & (F.col("text") != ""))
    path = F.concat_ws("/", "lang", "source", "doc_id")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600)
    mail = F.concat(F.lit("<"), "source", F.lit("@"), "lang", F.lit(">"))
    rows = d.select(path.alias("file_path"), F.col("source").alias("author_name"), mail.alias("author_mail"), ts.alias("author_ts"), F.posexplode(split_lines(F.col("text"))).alias("at", "contents"))
    return rows.select(F.lit("head").alias("commit_id"), "file_path", (F.col("at") + 1).alias("line_number"), "author_name", "author_mail", "author_ts", F.col("file_path").alias("origin_commit_id"), "contents")


def events_as_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits: an event is a commit of its user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("commit_id"), name.alias("author_name"), F.concat(F.lit("<"), name, F.lit("@"), "event_type", F.lit(">")).alias("author_mail"), F.col("ts").cast("timestamp").alias("commit_ts"))


#: Lines of each file version that orders_as_hunks() makes up, and authors who wrote them.
HUNK_LINES, HUNK_AUTHORS = 12, 40


def orders_as_hunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hunks, dst_blame, src_blame, commits): an order is a commit with one hunk, whose kind, ranges and authors follow from its key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, line = F.col("commit_id"), F.col("line_number")
    rows = o.select(F.col("o_orderkey").alias("commit_id"), F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file_path"), F.col("o_orderdate").cast("timestamp").alias("commit_ts"))

    def person(number: Column) -> list[Column]:
        who = F.concat(F.lit("c"), F.pmod(number, F.lit(HUNK_AUTHORS)).cast("string"))
        return [who.alias("author_name"), F.concat(F.lit("<"), who, F.lit("@x>")).alias("author_mail")]

    op = F.element_at(F.array(*map(F.lit, ("New", "Add", "Change", "Delete"))), (key % 4 + 1).cast("int"))
    src, dst = F.when(F.col("op") == "New", 1).otherwise(key % 5 + 1), F.when(F.col("op") == "New", 1).otherwise(key % 7 + 1)
    n_src = F.when(F.col("op").isin("Change", "Delete"), key % 3 + 1).otherwise(0)
    n_dst = F.when(F.col("op") == "Delete", 0).otherwise(F.floor(key / 4) % 4 + 1)
    hunks = rows.withColumn("op", op).select("commit_id", "file_path", F.when(F.col("op") != "New", key - 1).alias("prev_commit_id"), "op", *[c.cast("int").alias(n) for c, n in ((src, "src_from"), (src + n_src - 1, "src_to"), (dst, "dst_from"), (dst + n_dst - 1, "dst_to"))])
    lines = rows.withColumn("line_number", F.explode(F.sequence(F.lit(1), F.lit(HUNK_LINES))))
    after = lines.select("commit_id", "file_path", "line_number", *person(key * 7 + line), F.col("commit_ts").alias("author_ts"))
    old = F.timestamp_seconds(F.unix_seconds("commit_ts") - (key * 13 + line * 7) % 60 * 86_400)
    before = lines.select((key - 1).alias("commit_id"), "file_path", "line_number", *person((key - 1) * 5 + line), old.alias("author_ts"))
    commits = rows.select("commit_id", *person(key), F.col("commit_ts").alias("author_ts"))
    return hunks, after, before, commits


def orders_as_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id and diff, a text in normal form, of the hunks of orders_as_hunks() that change a version."""
    h = orders_as_hunks(spark, sf_dir)[0].where("op <> 'New'")

    def span(first: str, last: str) -> Column:
        a, b = F.col(first).cast("string"), F.col(last).cast("string")
        return F.when(F.col(last) <= F.col(first), F.when(F.col(last) < F.col(first), b).otherwise(a)).otherwise(F.concat(a, F.lit(","), b))

    def side(mark: str, first: str, last: str) -> Column:
        every = F.transform(F.sequence(first, last), lambda i: F.concat(F.lit(mark), F.lit(" 3,4c5 line "), i.cast("string")))
        return F.when(F.col(last) >= F.col(first), F.array_join(every, "\n"))

    letter = F.lower(F.substring("op", 1, 1))
    rule = F.when(F.col("op") == "Change", "---")
    return h.select(F.col("commit_id").alias("pair_id"), F.concat_ws("\n", F.concat(span("src_from", "src_to"), letter, span("dst_from", "dst_to")), side("<", "src_from", "src_to"), rule, side(">", "dst_from", "dst_to"), F.lit("\\ No newline at end of file")).alias("diff"))


def orders_as_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, src, dst: two versions of a text per order; no line occurs twice, so one shortest edit leads from one to the other."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pair_id"))
    numbers = F.sequence(F.lit(1).cast("long"), F.col("pair_id") % 7 + 6)
    key = F.col("pair_id")
    text = lambda lines: F.array_join(F.flatten(F.transform(numbers, lines)), "")
    line = lambda mark, i: F.concat(F.lit(mark), i.cast("string"), F.lit("\n"))
    none = F.array().cast("array<string>")
    src = text(lambda i: F.array(line("old ", i)))
    dst = text(lambda i: F.concat(F.when((i * 7 + key) % 5 == 0, none).otherwise(F.array(line("old ", i))), F.when((i * 3 + key) % 4 == 0, F.array(line("new ", i))).otherwise(none)))
    return o.select("pair_id", src.alias("src"), dst.alias("dst"))


def lineitem_as_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_touches: a part is a line, the items of an order that ship on a day are a commit, a supplier
    an author; the part's brand and size are the file. So a commit has one date."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    # numbers alone are shuffled and sorted; names come after
    rows = i.select("l_partkey", "l_orderkey", "l_suppkey", "l_shipdate", F.lag("l_shipdate").over(w).alias("src_ts"), F.lag("l_suppkey").over(w).alias("src_suppkey"))

    def people(key: str, name: str, mail: str) -> DataFrame:
        s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
        return s.select(F.col("s_suppkey").alias(key), F.col("s_name").alias(name), F.concat(F.lit("<"), "s_suppkey", F.lit("@"), "s_nationkey", F.lit(">")).alias(mail))

    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_size").alias("file_path"))
    rows = rows.join(people("l_suppkey", "actor_name", "actor_mail"), "l_suppkey").join(p, "l_partkey").join(people("src_suppkey", "src_author_name", "src_author_mail"), "src_suppkey", "left")
    return rows.select(
        (F.col("l_orderkey") * 100_000 + F.unix_date(F.col("l_shipdate").cast("date"))).alias("commit_id"), "file_path", F.when(F.col("src_ts").isNull(), "New").otherwise("Change").alias("op"), F.lit(1).cast("bigint").alias("lines"),
        "actor_name", "actor_mail", "src_author_name", "src_author_mail", F.col("actor_name").alias("commit_author_name"), F.col("l_shipdate").alias("commit_ts"), "src_ts",
    )
