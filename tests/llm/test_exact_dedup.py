import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lineloom import session
from lineloom.llm import common, exact_dedup, queries
from tests.llm import cases


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_query_matches_brute_force(spark, tmp_path):
    rows = cases.awkward()
    out = queries.op1_exact_dedup(spark, cases.table(spark, tmp_path, cases.frame(spark))).collect()
    want = by_hand(rows)
    assert len(out) == len(rows)
    digests = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all(digests[r.text_sha256] == (r.keep_id, r.group_size) for r in out)
    # one row of each group stays, repeated rows and null ids included
    assert sum(r.kept for r in out) == len(want)


def test_digest_collisions_are_told_apart_by_bytes(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["a", "b", "A", "c", "b", "dd"])]
    weak = lambda text: F.unhex(F.substring(F.sha2(F.length(text).cast("string"), 256), 1, 4))
    out = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(cases.frame(spark, rows), digest=weak).collect()}
    assert out == {0: (2, 2, False), 2: (2, 2, True), 1: (4, 2, False), 4: (4, 2, True), 3: (3, 1, True), 5: (5, 1, True)}


def test_state_goes_on_over_micro_batches_and_runs(spark, tmp_path):
    path = f"{tmp_path}/in/d.parquet"
    one = cases.frame(spark, [(1, "x", "en", "s", 0), (2, "y", "en", "s", 0)]).repartition(2)
    one.write.parquet(path)
    state_dir = f"file://{tmp_path}/state"
    docs = spark.read.parquet(path)
    first = exact_dedup.exact_dedup(docs, path=path, trigger_bytes=1, state_dir=state_dir).collect()
    assert {(r.id, r.keep_id, r.group_size) for r in first} == {(1, 1, 1), (2, 2, 1)}
    cases.frame(spark, [(9, "X", "en", "s", 0)]).write.mode("append").parquet(path)
    docs = spark.read.parquet(path)
    again = exact_dedup.exact_dedup(docs, path=path, trigger_bytes=1, state_dir=state_dir).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in again} == {(1, 9, 2, False), (9, 9, 2, True), (2, 2, 1, True)}


def test_keep_one_keeps_columns_and_clashing_names(spark):
    docs = cases.frame(spark, extra=True)
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert out.count() == len(by_hand(cases.awkward()))
    assert exact_dedup.keep_one(cases.empty(spark)).count() == 0


def test_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", "en", "s", 0) for i in range(3000)]
    out = exact_dedup.exact_dedup(cases.frame(spark, rows)).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in out} == {(2000, True): 1, (2000, False): 1999, (1, True): 1000}


def exploded(spark, tmp_path):
    """Rows that share their place in a file: each document twice, and its text in passages."""
    path = cases.table(spark, tmp_path, cases.frame(spark, [(i, f"text {i} " * (i + 1), "en", "s", 0) for i in range(10)]))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    return docs.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))


def test_rows_of_an_exploded_frame_have_places_of_their_own(spark, tmp_path):
    docs = exploded(spark, tmp_path)
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == 20 and sum(r.kept for r in out) == 10 and {r.group_size for r in out} == {2}
    assert exact_dedup.keep_one(docs).count() == 10
    passages = docs.select("doc_id", F.explode(F.split("text", " (?=text)")).alias("text"))
    assert exact_dedup.keep_one(passages).count() == len({r.text for r in passages.collect()})


def test_scans_keep_their_places_and_other_plans_are_written(spark, tmp_path):
    path = f"{cases.table(spark, tmp_path, cases.frame(spark))}/documents.parquet"
    docs = spark.read.parquet(path)
    for same in (docs, docs.where("doc_id > 3").select("doc_id", "text"), docs.alias("d")):
        assert common.with_places(same) is same
    for other in (docs.union(docs), spark.read.parquet(path, path), docs.where(F.rand() < 2), docs.join(docs.select("doc_id"), "doc_id"), docs.limit(3), docs.distinct()):
        placed = common.with_places(other)
        rows = common.located(placed).collect()
        assert placed is not other and len(set(rows)) == len(rows) == other.count()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_base(Session())


def test_more_stores_than_shuffle_partitions(spark, tmp_path):
    out = exact_dedup.exact_dedup(cases.frame(spark), stores=7, state_dir=f"file://{tmp_path}/state")
    assert out.where("kept").count() == len(by_hand(cases.awkward()))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert len([p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]) == 7
