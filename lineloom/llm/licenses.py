"""Licence scan by diagonal voting.

All rolling word k-grams of every text are hashed and joined with the k-grams of the templates.
A match at word `pos` of the text and `at` of the template votes for the diagonal pos - at;
neighbouring diagonals are merged (they differ where words were put in or left out; a notice allows
half its length of them at one place), and spans that hold enough of their template are kept. Short phrases use k = 2 and must match whole;
notices use k = 5 and a similarity of 0.8 or more, the share of the template's k-grams found.
A vote counts only if its words equal the template's, so no hash collision passes.

Defined results: null or empty texts have no words and no labels; rows that repeat an id are
scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm.common import ascii_lower, local_table
from lineloom.llm.license_texts import BASE_PHRASES, MORE_PHRASES, NOTICES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_K, NOTICE_K = 2, 5
MIN_SIMILARITY = 0.8
#: Diagonals of a notice belong to one span if no further apart than its words divided by this: up to
#: half a notice may be put in at one place, such as a page header or a name.
NEAR_PART = 2
#: Every text has one gram of this "word", which no text contains; it carries the text's row.
MARK = "\x00"
#: Template k-grams that are broadcast at most; with more of them the join shuffles.
BROADCAST_GRAMS = 200_000


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def templates(base=BASE_PHRASES, more=MORE_PHRASES, notices=NOTICES) -> list[dict]:
    """tid, kind (base, phrase or notice), label, words, k, of each template."""
    kinds = [("base", PHRASE_K, x) for x in base] + [("phrase", PHRASE_K, x) for x in more] + [("notice", NOTICE_K, x) for x in notices]
    found = [{"tid": i, "kind": kind, "label": label, "words": words_of(text), "k": k} for i, (kind, k, (text, label)) in enumerate(kinds)]
    if short := [t["tid"] for t in found if len(t["words"]) < t["k"]]:
        raise ValueError(f"templates {short} have fewer words than their k")
    return found


def gram_table(spark: SparkSession, found: list[dict]) -> DataFrame:
    """tid, at, k, n_grams, kind, label, gram, h: a row for each k-gram of each template."""
    rows = [{"tid": t["tid"], "at": at, "k": t["k"], "n_grams": len(t["words"]) - t["k"] + 1, "kind": t["kind"], "label": t["label"], "gram": t["words"][at : at + t["k"]]} for t in found for at in range(len(t["words"]) - t["k"] + 1)]
    rows.append({"tid": -1, "at": 0, "k": 0, "n_grams": 0, "kind": "mark", "label": "", "gram": [MARK]})
    table = local_table(spark, rows, "tid:int,at:int,k:int,n_grams:int,kind:string,label:string,gram:array<string>")
    hashed = table.withColumn("h", F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(NOTICE_K)]))
    return F.broadcast(hashed) if len(rows) <= BROADCAST_GRAMS else hashed


def rolling(words: Column, k: int) -> Column:
    """The hash at each word of it and the k - 1 after it; the last ones hold fewer and match nothing."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: list[dict] | None = None) -> DataFrame:
    """row, doc_id, n_words, spans: array of (kind, label, first, last, similarity), by text row."""
    found = templates() if found is None else found
    grams = gram_table(docs.sparkSession, found)
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
    rows = rows.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.concat(rolling(F.col("words"), PHRASE_K), rolling(F.col("words"), NOTICE_K), F.array(F.xxhash64(F.lit(MARK)))).alias("hashes"))
    each = rows.select("row", "doc_id", "words", "n_words", F.posexplode("hashes").alias("i", "h"))
    votes = each.join(grams, "h").withColumn("pos", F.when(F.col("k") == NOTICE_K, F.col("i") - F.col("n_words")).otherwise(F.col("i")))
    in_block = F.when(F.col("k") == PHRASE_K, F.col("i") < F.col("n_words")).otherwise((F.col("i") >= F.col("n_words")) & (F.col("i") < 2 * F.col("n_words")))
    same = (F.col("pos") + F.col("k") <= F.col("n_words")) & in_block & (F.slice("words", F.greatest(F.col("pos") + 1, F.lit(1)), F.col("k")) == F.col("gram"))
    votes = votes.where((F.col("tid") == -1) | same).select("row", "doc_id", "n_words", "tid", "kind", "label", "n_grams", "k", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    # all that follows stays within a text's row: one shuffle, of the votes alone
    votes = votes.repartition("row")
    keys = ["row", "doc_id", "n_words", "tid", "kind", "label", "n_grams", "k"]
    diagonals = votes.groupBy(*keys, F.when(F.col("tid") == -1, 0).otherwise(F.col("diagonal")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    in_order = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(in_order) > F.when(F.col("kind") == "notice", F.floor((F.col("n_grams") + F.col("k") - 1) / NEAR_PART)).otherwise(0)
    spans = diagonals.withColumn("span", F.sum(apart.cast("int")).over(in_order)).groupBy(*keys, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hit"), F.min("first").alias("first"), (F.max("last") + F.first("k") - 1).alias("last")
    )
    similarity = F.col("hit") / F.col("n_grams")
    good = (F.col("tid") >= 0) & (similarity >= F.when(F.col("kind") == "notice", MIN_SIMILARITY).otherwise(1.0))
    span = F.when(good, F.struct("kind", "label", "first", "last", similarity.alias("similarity")))
    return spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def license_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest row of each text: counts, places and labels."""

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    base = F.filter("spans", lambda s: s["kind"] == "base")
    starts = F.transform(base, lambda s: s["first"].cast("long"))
    return scan(docs, id_col, text_col).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )
