import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lineloom.llm import queries, sharding
from tests.llm import cases


def check(rows, out):
    assert len(out) == len(rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == want
    for s in range(24):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.law for r in out} <= {"bytes"} and all(0 <= r.shard < 24 and r.grown_shard is None for r in out)


def test_sizes_are_near_equal_and_copies_stay_together(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 400) + str(i % 900), "en", "s", 0) for i in range(2400)]
    out = queries.op7_vector_sharding(spark, cases.table(spark, tmp_path, cases.frame(spark, rows))).collect()
    check(rows, out)
    sums = [sum(x["size"] for x in out if x.shard == s) for s in range(24)]
    assert max(sums) / np.mean(sums) < 1.02 and min(sums) / np.mean(sums) > 0.98
    text = {x[0]: x[1] for x in rows}
    shards = {}
    assert all(shards.setdefault(text[x.doc_id], x.shard) == x.shard for x in out)


def test_awkward_empty_and_hot(spark):
    check(cases.awkward(), sharding.shard(cases.frame(spark, extra=True)).collect())
    assert sharding.shard(cases.empty(spark)).count() == 0
    rows = [(i, "hot text" if i % 3 else f"text {i}", "en", "s", 0) for i in range(4800)]
    out = sharding.shard(cases.frame(spark, rows)).collect()
    check(rows, out)
    sums = [sum(x["size"] for x in out if x.shard == s) for s in range(24)]
    assert max(sums) / np.mean(sums) < 1.05


def test_files_hold_every_row(spark, tmp_path):
    sharding.write_shards(spark, cases.frame(spark), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").agg(F.count("*")).first()[0] == len(cases.awkward())


def test_items_go_where_the_dot_product_is_highest():
    r = np.random.default_rng(4)
    vectors = r.pareto(1.5, (200, 3))
    vectors /= vectors.sum(0)
    left = [list(sharding.WEIGHTS) for _ in range(24)]
    want = [0] * 200
    need = [[v * 24 * w for v, w in zip(row, sharding.WEIGHTS, strict=True)] for row in vectors.tolist()]
    for i in sorted(range(200), key=lambda i: -max(need[i])):
        fits = [sum(a * b for a, b in zip(free, need[i], strict=True)) for free in left]
        want[i] = max(range(24), key=lambda s: fits[s])
        left[want[i]] = [a - b for a, b in zip(left[want[i]], need[i], strict=True)]
    assert sharding.pack(vectors, 24).tolist() == want
    # ties: of equal items the first, of equal shards the first
    assert sharding.pack(np.full((4, 3), 0.25), 2).tolist() == [0, 1, 0, 1]
