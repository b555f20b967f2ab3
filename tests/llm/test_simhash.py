import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineloom.llm import graph, queries, simhash
from lineloom.llm.mixing import SPACED_WORD
from tests.llm import cases


def by_hand(text):
    words = re.findall(SPACED_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes, radius=3):
    """Component number of each code, by brute force."""
    root = list(range(len(codes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(codes))]


def test_hash_is_that_of_the_engine(spark):
    assert spark.sql("select xxhash64('the quick brown')").first()[0] == simhash.signed(xxhash.xxh64_intdigest(b"the quick brown", 42))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cé\n\t\x0b\x85\xa0😀", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == by_hand(text)


def near_codes(n, seed=1):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        c = r.choice(centres)
        for _ in range(r.randint(0, 9)):
            c ^= 1 << r.randrange(64)
        out.add(c)
    return sorted(out)


def spanned(codes, links):
    at = {c: i for i, c in enumerate(codes)}
    root = list(range(len(codes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(at[a]), top(at[b])
        root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(codes))]


def levels_by_hand(codes):
    """What each node of tree_levels() must know, its parents' bits included."""
    out, width = [], simhash.LEAF
    while True:
        parts = [codes[i : i + width] for i in range(0, len(codes), width)]
        every = [int(np.bitwise_and.reduce(p)) for p in parts]
        some = [int(np.bitwise_or.reduce(p)) for p in parts]
        out.insert(0, [((1 << 64) - 1 & ~(e ^ o), e & ~(e ^ o)) for e, o in zip(every, some, strict=True)])
        if len(parts) == 1:
            return out
        width *= 2


def test_shared_bits_lie_in_the_highest_node_that_has_them():
    codes = np.array(near_codes(700, 3), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    levels, want = simhash.tree_levels(codes), levels_by_hand(codes)
    for d, (mask, bits) in enumerate(levels):
        for k in range(len(mask)):
            path = [(levels[e][0][k >> d - e], levels[e][1][k >> d - e]) for e in range(d + 1)]
            assert sum(int(m).bit_count() for m, _ in path) == want[d][k][0].bit_count()
            assert (int(np.bitwise_or.reduce([m for m, _ in path])), int(np.bitwise_or.reduce([b for _, b in path]))) == want[d][k]


def linked_groups(codes, parts):
    """Groups by group_links() over all pairs of the parts, in both turns; and the share of pairs compared."""
    found, compared = [], 0
    for turn in (0, 1):
        links = simhash.Links()
        turned = [np.array([(c >> 32 | c << 32) & (1 << 64) - 1 if turn else c for c in p], np.uint64) for p in parts]
        for i, one in enumerate(turned):
            for other in turned[i:]:
                compared += simhash.group_links(one, None if other is one else other, links)
        found += [((a >> 32 | a << 32) & (1 << 64) - 1, (b >> 32 | b << 32) & (1 << 64) - 1) if turn else (a, b) for a, b in links.found]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    return spanned(codes, found), compared / max(1, len(codes) ** 2)


def test_index_loses_no_link_and_prunes():
    for n in (1, 2, 15, 16, 17, 300, 999):
        codes = near_codes(n, n)
        assert linked_groups(codes, [codes])[0] == groups(codes)
        parts = [codes[: n // 5], codes[n // 5 : n // 2], codes[n // 2 :]]
        assert linked_groups(codes, [p for p in parts if p])[0] == groups(codes)
    codes = near_codes(8000, 2)
    assert linked_groups(codes, [codes])[1] < 0.15


def test_trees_over_the_table_lose_no_link(spark):
    dense = [0x1234_5678_9ABC << 16 | x for x in range(400)]  # one run of the order, split down to its last bits
    codes = sorted(set(near_codes(500, 5) + dense + [0, (1 << 64) - 1, 1 << 63]))
    df = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp bigint")
    for group, first in ((1024, 8), (40, 4)):
        levels, parts = simhash.trees(df.select(F.inline(F.array(*simhash.turns(F.col("fp"), simhash.NEAR)))), group, first)
        sizes = [len(r.codes) for r in parts.collect()]
        assert sum(sizes) == 2 * len(codes) and max(sizes) <= group and (group == 1024 or len(levels) > 3)
        links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.fingerprint_links(df, group, first).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        assert spanned(codes, links) == groups(codes)
        assert len(links) < 20 * len(codes)


def test_gray_ranks_are_those_of_the_sequence():
    codes = np.array([i ^ i >> 1 for i in range(300)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(300))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(-5, -9)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(200)}, -5: -9, -9: -9}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_matches_brute_force(spark, tmp_path):
    rows = cases.awkward()
    out = queries.op6_simhash_near_dedup(spark, cases.table(spark, tmp_path, cases.frame(spark))).collect()
    codes = [by_hand(r[1]) for r in rows]
    distinct = sorted(set(codes))
    of = dict(zip(distinct, groups(distinct), strict=True))
    want = sorted((str(r[0]), f"{c:016x}", str(min((x[0] for x, y in zip(rows, codes, strict=True) if of[y] == of[c] and x[0] is not None), default=None))) for r, c in zip(rows, codes, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want


def sketch_by_hand(text):
    """WORDS fingerprints over the distinct 5-word shingles, each of the SplitMix64 outputs at that step."""
    words = re.findall(SPACED_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    full, out = (1 << 64) - 1, []
    for step in range(simhash.WORDS):
        hashes = []
        for s in shingles:
            x = xxhash.xxh64_intdigest(s.encode(), 42) + step * 0x9E3779B97F4A7C15 & full
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
            x = (x ^ x >> 27) * 0x94D049BB133111EB & full
            hashes.append(x ^ x >> 31)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def near_by_hand(sketches):
    """Group number of each sketch: linked by equal codes, or by codes within 7 bits whose checks are within 14."""
    signed = simhash.signed
    homes = sorted({signed(s[0]) for s in sketches})
    root = {h: h for h in homes}

    def top(x):
        return x if root[x] == x else top(root[x])

    def join(x, y):
        root[max(top(x), top(y))] = min(top(x), top(y))

    for w in range(len(sketches[0])):
        first = {}
        for s in sketches:
            one = (signed(s[0]), signed(s[(w + 1) % len(s)]))
            first[s[w]] = min(first.get(s[w], one), one)
        for s in sketches:
            join(signed(s[0]), first[s[w]][0])
        for x in first:
            for y in first:
                if (x ^ y).bit_count() <= 7 and ((first[x][1] ^ first[y][1]) & (1 << 64) - 1).bit_count() <= 14:
                    join(first[x][0], first[y][0])
    return [top(signed(s[0])) for s in sketches]


def near_texts_corpus():
    """Texts of 30 families: prose, the same with words changed here and there, short and empty texts."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = ["", None, "one", "One", "one two three four", "one two three five"]
    for family in range(30):
        words = [r.choice(vocabulary) for _ in range(60 + 20 * family)]
        for changes in range(4):
            other = list(words)
            for _ in range(changes * len(words) // 250):
                other[r.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    return texts


def test_near_texts_match_brute_force(spark):
    texts = near_texts_corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.id: r.root for r in simhash.near_texts(docs).collect()}
    want = near_by_hand([sketch_by_hand(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts)


def test_near_texts_are_those_with_most_shingles_in_common(spark):
    texts = near_texts_corpus()
    sets = [set(simhash.shingle_hashes(t, simhash.TEXT_SHINGLE).tolist()) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    root = {r.id: r.root for r in simhash.near_texts(docs).collect()}
    pairs = [(i, j, len(a & b) / len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b]
    near = [root[i] == root[j] for i, j, s in pairs if s >= 0.9]
    assert len(near) > 30 and all(near)
    assert not any(root[i] == root[j] for i, j, s in pairs if s < 0.3)


def test_codes_with_checks_lose_no_link(spark):
    codes = np.array(near_codes(600, 8), np.uint64)
    checks = np.array([c ^ (0x3FFFF if k % 3 == 0 else 0) for k, c in enumerate(codes.tolist())], np.uint64)
    reach = simhash.NEAR_TEXT
    found = []
    for turn in range(reach.turns):
        bits = turn * reach.block
        links = simhash.Links()
        simhash.group_links(np.array([simhash.turned(c, bits) for c in codes.tolist()], np.uint64), None, links, reach, (checks, None))
        found += [tuple(simhash.turned(x, 64 - bits) for x in pair) for pair in links.found]
    at = {c: k for k, c in enumerate(codes.tolist())}
    near = [(a, b) for a in at for b in at if a < b and (a ^ b).bit_count() <= 7 and (int(checks[at[a]]) ^ int(checks[at[b]])).bit_count() <= 14]
    assert spanned(list(at), found) == spanned(list(at), near)
    assert len({*spanned(list(at), near)}) < len(at)


def test_keep_one(spark):
    docs = cases.frame(spark, extra=True)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert out.count() == len(set(near_by_hand([sketch_by_hand(r[1]) for r in cases.awkward()])))
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def test_keep_one_of_an_exploded_frame(spark, tmp_path):
    docs = spark.read.parquet(cases.table(spark, tmp_path, cases.frame(spark)) + "/documents.parquet")
    twice = docs.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    assert simhash.keep_one(twice).count() == simhash.keep_one(docs).count()
