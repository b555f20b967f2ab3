import re
from collections import defaultdict

import numpy as np
import pytest

from lineloom.llm import mixing, queries
from tests.llm import cases


def fill(sizes, weights=(5, 2, 1), limit=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        goal = {s: limit * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        above = [s for s in free if goal[s] > limit * sizes[s]]
        if not above:
            return goal
        capped.update(above)


def words(text):
    return len(re.findall(mixing.SPACED_WORD, text or ""))


@pytest.mark.parametrize("many", [False, True])
def test_targets_and_taken(spark, tmp_path, many):
    rows = cases.awkward()
    if many:
        rows = [(i, " ".join("w" * (1 + (i * 7) % 5) for _ in range(1 + i * 37 % 90)), "en", None if i % 9 == 4 else f"s{(i % 9) ** 2 % 7}" if i % 100 else "tiny", 0) for i in range(3000)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    goal = fill(sizes)
    path = cases.table(spark, tmp_path, cases.frame(spark, rows))
    out = queries.op3_entropy_mixing(spark, path).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in out if r.doc_id is not None) == sorted((False, r[0], words(r[1])) for r in rows if r[0] is not None)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[round(r.target, 3), r.source_size] += r.taken
    want = {(round(goal[s], 3), sizes[s]): s for s in sizes}
    assert set(taken) == set(want)
    if many:
        assert all(abs(t - k[0]) <= max(0.02 * k[0], 45) for k, t in taken.items())
    again = queries.op3_entropy_mixing(spark, path).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = cases.frame(spark, [(i, "w " * (i % 7 + 1), "en", f"s{i % 2}", 0) for i in range(200)], extra=True)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = mixing.mix_rows(docs).agg({"copies": "sum"}).first()[0]
    assert out.count() == taken
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.mix_rows(cases.empty(spark)).count() == 0


def test_rates_are_the_exponentially_tilted_optimum(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", f"s{i % 9 % 5}", 0) for i in range(900)] + [(10_000 + i, "w " * 400, "en", "tiny", 0) for i in range(3)]
    docs = cases.frame(spark, rows)
    params = {r.key: r for r in mixing.plan(docs)[1].collect()}
    sizes = defaultdict(list)
    for r in rows:
        sizes["0" + r[3]].append(words(r[1]))
    goal = fill({k[1:]: sum(v) for k, v in sizes.items()})
    assert set(params) == set(sizes)
    for key, found in sizes.items():
        size, mean = np.array(found, float), np.mean(found)
        got = lambda lam: (size * np.minimum(3, np.exp(lam * size / mean))).sum()  # noqa: E731, B023
        low, high = -200.0, 200.0
        for _ in range(200):  # tokens grow with lam, so halving finds the one root
            low, high = ((low + high) / 2, high) if got((low + high) / 2) < goal[key[1:]] else (low, (low + high) / 2)
        if goal[key[1:]] < 3 * size.sum():
            assert abs(params[key].lam - low) < 1e-5 * max(1, abs(low))
        assert abs(got(params[key].lam) - goal[key[1:]]) <= 1e-6 * goal[key[1:]]
    # and the copies taken come as near as whole documents allow
    taken, source = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in mixing.mix_rows(docs).collect():
        taken[source[r.doc_id]] += r.taken
    assert all(abs(t - goal[s]) <= (400 if s == "tiny" else 90) for s, t in taken.items())


def test_empty_documents_stay_once(spark):
    docs = cases.frame(spark, [(1, None, "", "a", 0), (2, "", "", "a", 0), (3, " \n", "", "b", 0), (4, "w", "", "b", 0)])
    assert sorted(r.doc_id for r in mixing.mix(docs).collect() if r.doc_id < 4) == [1, 2, 3]
    assert sorted(r.doc_id for r in mixing.mix(docs.where("doc_id < 4")).collect()) == [1, 2, 3]
