"""SimHash near-dedup over a Gray-order hierarchical index.

1. Fingerprints: 64 majority bits of the XXH64 (seed 42) of all 3-word shingles of a text.
2. Equal fingerprints collapse to one row each.
3. Trees hold all fingerprints in Gray order: one as they are, one for each of their other blocks turned to the front.
   In Gray order all codes with the same leading bits lie together, so a node is a run of the order
   named by its leading bits. A node keeps only the bits that all codes below it share and that its
   parent doesn't hold already: what is shared is factored into the upper nodes. A node with more
   than GROUP codes is split by STEP further bits, as often as it takes, so no group is without bound.
4. Pairs of nodes are taken from the roots down. A pair carries the differences found so far; a step
   down adds those in bits that have become known for both nodes. A pair goes, with all below it,
   once it differs in more than the radius, or in more of the tree's leading block than the block
   that holds fewest differences can have, so one of the trees keeps every link: radius 3 over two
   blocks leaves 1 in a leading half, radius 7 over four blocks 1 in a leading quarter.
5. What is left are pairs of groups of bounded size. A task continues both groups' trees in memory,
   down to leaves, and compares the leaves' codes. Only links that join separate groups leave a batch.
6. Links join into components; a component is named by its smallest doc_id.

With n fingerprints a node has about log2(n) partners of its own size, so work grows with n log n.

`near_dedup` is the contract's: one fingerprint, radius 3. `near_texts` and `keep_one` look for texts that
share 0.8 or more of their distinct 5-word shingles. At 0.8 a tenth of the bits and more differ, so they take
WORDS fingerprints of 64 bits instead of one, each with radius 7; a link must also hold in the next
fingerprint, within CHECK_RADIUS, which leaves no links by chance. Two texts link if any of the fingerprints
links them: SimHash estimates similarity, and the README gives the share of pairs found.

Defined results: null and empty texts have fingerprint zero, linked like any other; a null id
takes part and names no component unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import located, spool, with_places
from lineloom.llm.graph import components

SEED = 42


class Reach(NamedTuple):
    """How far links reach: bits that may differ, and bits of the blocks that take turns at the front."""

    radius: int
    block: int
    check: int = 64  # bits that may differ in the check that comes with a code

    @property
    def turns(self) -> int:
        return 64 // self.block

    @property
    def leading(self) -> int:
        """Of the differences of a link, those that one of the blocks holds at most."""
        return self.radius // self.turns


#: The contract's links, with its words to a shingle.
NEAR, SHINGLE = Reach(3, 32), 3
#: Links of near texts, words to their shingles, and fingerprints.
CHECK_RADIUS = 14
NEAR_TEXT, TEXT_SHINGLE, WORDS = Reach(7, 16, CHECK_RADIUS), 5, 6
#: Leading bits of the first nodes, further bits of each split, and codes of a node that is not split.
FIRST_BITS, STEP, GROUP = 6, 3, 1024
#: The same of near texts: a code meets about log2(codes / group) other groups, which larger ones lower.
TEXT_FIRST_BITS, TEXT_GROUP = 4, 16384
#: Codes of a leaf in memory, and pairs of leaves compared at a time.
LEAF, PAIRS_AT_ONCE = 16, 4096


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The XXH64 of every k-word shingle, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return majority(shingle_hashes(text, SHINGLE))


def sketch(text: str | None) -> list[int]:
    """WORDS fingerprints of a text's distinct shingles, unsigned; each has hash bits of its own."""
    hashes = np.unique(shingle_hashes(text, TEXT_SHINGLE))
    return [majority(mixed(hashes, w)) for w in range(WORDS)]


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits for each hash: the SplitMix64 output `word` steps on."""
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes))))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """id and fp (the fingerprint as a signed bigint) of each row, plus the columns `extra`."""
    return _per_text(docs, id_col, text_col, extra, ["fp"], lambda t: [fingerprint(t)])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """id and w0, w1, ... (the sketch's fingerprints as signed bigints) of each row, plus the columns `extra`."""
    return _per_text(docs, id_col, text_col, extra, [f"w{w}" for w in range(WORDS)], sketch)


def _per_text(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...], names: list[str], of: Callable[[str | None], list[int]]) -> DataFrame:
    wanted = docs.select(F.col(id_col).alias("id"), *[F.col(c) for c in extra], F.col(text_col).cast("string").alias("body"))
    schema = wanted.drop("body").withColumns({n: F.lit(0).cast("long") for n in names}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [of(t.as_py()) for t in b.column(b.num_columns - 1)]
            columns = [pa.array([signed(x[k]) for x in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], *names])

    return wanted.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


Level = tuple[np.ndarray, np.ndarray]


def tree_levels(codes: np.ndarray) -> list[Level]:
    """(mask, bits) of each level's nodes, the root first; `codes` in Gray order.

    A leaf holds LEAF codes, an upper node two nodes. mask has the bits that all codes below share
    and that no node above holds.
    """
    first = np.arange(0, len(codes), LEAF)
    every, some = np.bitwise_and.reduceat(codes, first), np.bitwise_or.reduceat(codes, first)
    levels = [(~(every ^ some), every)]
    while len(levels[0][0]) > 1:
        mask, bits = levels[0]
        left = np.arange(0, len(mask), 2)
        right = np.minimum(left + 1, len(mask) - 1)
        shared = mask[left] & mask[right] & ~(bits[left] ^ bits[right])
        held = np.repeat(shared, 2)[: len(mask)]
        levels[0] = (mask & ~held, bits & mask & ~held)
        levels.insert(0, (shared, bits[left] & shared))
    mask, bits = levels[-1]
    levels[-1] = (mask, bits & mask)
    return levels


def near_leaves(one: list[Level], other: list[Level], same: bool, reach: Reach = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two trees that may hold links, from the roots down; i <= j if the trees are the same.

    Each pair carries the bits known on its two paths and the differences among those known on both.
    """
    front = np.uint64((1 << reach.block) - 1 << 64 - reach.block)
    i = j = np.zeros(1, np.int64)
    path_a = path_b = (np.zeros(1, np.uint64), np.zeros(1, np.uint64))
    apart, leading = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(max(len(one), len(other))):
        # the leaves of a lower tree wait for those of the other one
        goes_a, goes_b = depth < len(one), depth < len(other)
        if depth:
            sides_a, sides_b = range(1 + goes_a), range(1 + goes_b)
            times = len(sides_a) * len(sides_b)
            i = np.concatenate([i * len(sides_a) + x for x in sides_a for _ in sides_b])
            j = np.concatenate([j * len(sides_b) + y for _ in sides_a for y in sides_b])
            real = (i < len(one[min(depth, len(one) - 1)][0])) & (j < len(other[min(depth, len(other) - 1)][0]))
            if same:
                real &= i <= j
            i, j, apart, leading = i[real], j[real], np.tile(apart, times)[real], np.tile(leading, times)[real]
            path_a, path_b = (tuple(np.tile(x, times)[real] for x in path) for path in (path_a, path_b))
        before = path_a[0] & path_b[0]
        if goes_a:
            path_a = (path_a[0] | one[depth][0][i], path_a[1] | one[depth][1][i])
        if goes_b:
            path_b = (path_b[0] | other[depth][0][j], path_b[1] | other[depth][1][j])
        found = (path_a[1] ^ path_b[1]) & path_a[0] & path_b[0] & ~before
        apart, leading = apart + np.bitwise_count(found), leading + np.bitwise_count(found & front)
        near = (apart <= reach.radius) & (leading <= reach.leading)
        i, j, apart, leading = i[near], j[near], apart[near], leading[near]
        path_a, path_b = (tuple(x[near] for x in path) for path in (path_a, path_b))
    return i, j


class Links:
    """Links among codes, less those whose ends earlier ones join already."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.top(x), self.top(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.found.append((x, y))

    def stars(self) -> list[tuple[int, int]]:
        """What add() joined, as links to the least of each group: batches that join the same give the same links."""
        return [(self.top(x), x) for x in self.parent]


#: Something of each code of two groups; the second is None if they are one.
Sides = tuple[np.ndarray, np.ndarray | None] | None


def group_links(one: np.ndarray, other: np.ndarray | None, links: Links, reach: Reach = NEAR, checks: Sides = None, homes: Sides = None) -> int:
    """Adds the links between two groups of distinct codes, or within one; returns how many pairs were compared.

    checks: for each code of both groups the bits that must lie within the reach's check as well;
    homes: for each code what it links in its place.
    """
    same = other is None
    orders = [np.argsort(gray_rank(x)) for x in ((one,) if same else (one, other))]
    one = one[orders[0]]
    other = one if same else other[orders[-1]]
    tree = tree_levels(one)
    a, b = near_leaves(tree, tree if same else tree_levels(other), same, reach)
    leaves, others = filled(one), filled(other)
    if checks is not None:
        check_leaves, check_others = filled(checks[0][orders[0]]), filled(checks[0 if same else 1][orders[-1]])
    if homes is not None:
        home_leaves, home_others = filled(homes[0][orders[0]]), filled(homes[0 if same else 1][orders[-1]])
    for k in range(0, len(a), PAIRS_AT_ONCE):
        at, to = a[k : k + PAIRS_AT_ONCE], b[k : k + PAIRS_AT_ONCE]
        left, right = leaves[at], others[to]
        p, i, j = np.nonzero(np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= reach.radius)
        x, y = left[p, i], right[p, j]
        if checks is not None:
            good = np.bitwise_count(check_leaves[at][p, i] ^ check_others[to][p, j]) <= reach.check
            p, i, j, x, y = p[good], i[good], j[good], x[good], y[good]
        if homes is not None:
            x, y = home_leaves[at][p, i], home_others[to][p, j]
        links.add(x[x != y], y[x != y])
    return len(a) * LEAF * LEAF


def filled(x: np.ndarray) -> np.ndarray:
    """x by leaves; a short leaf is filled up with its last code, and what that finds twice is one link."""
    return np.concatenate([x, np.full(-len(x) % LEAF, x[-1])]).reshape(-1, LEAF)


def turned(code: int, bits: int) -> int:
    """The code with its leading bits moved to the end; unsigned."""
    return (code << bits | code >> 64 - bits) & (1 << 64) - 1


def prefix(code: Column, bits: int) -> Column:
    """The leading bits of a code, as a number; of a node, its name in its level."""
    return F.shiftrightunsigned(code, 64 - bits)


def turns(code: Column, reach: Reach, first: Column | None = None, *extra: str) -> list[Column]:
    """A struct (turn, code, extra columns) for each block at the front, turns counted from `first`."""

    def rotated(bits: int) -> Column:
        return F.shiftleft(code, bits).bitwiseOR(F.shiftrightunsigned(code, 64 - bits)) if bits else code

    return [F.struct((F.lit(t) if first is None else first + t).alias("turn"), rotated(t * reach.block).alias("code"), *extra) for t in range(reach.turns)]


def trees(rows: DataFrame, group: int, first_bits: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, groups) of the trees over the codes of each turn; rows: turn, code, distinct, and check and home or neither.

    levels: turn, up, node, mask, bits, open of each level's nodes; open: whether the node is split
    by the next level. groups: turn, level, node and codes (with checks and homes, if any) of the nodes that are not split.
    """
    kept = rows.columns
    code = F.struct("code", "check", "home") if "check" in kept else F.col("code")
    rows = spool(rows, "codes")
    levels, groups = [], []
    depth, before = first_bits, 0
    held: DataFrame | None = None
    while True:
        up = prefix(F.col("code"), before) if before else F.lit(0).cast("long")
        named = rows.withColumn("node", prefix(F.col("code"), depth)).withColumn("up", up)
        nodes = named.groupBy("turn", "up", "node").agg(F.bit_and("code").alias("every"), F.bit_or("code").alias("some"), F.count("*").alias("n"))
        shared = F.bitwise_not(F.col("every").bitwiseXOR(F.col("some")))
        nodes = nodes.select("turn", "up", "node", shared.alias("shared"), F.col("every").alias("bits"), (F.col("n") > group).alias("open"))
        if held is not None:  # the bits that the parent holds, with those above it, are left to it
            nodes = nodes.join(held.select("turn", F.col("node").alias("up"), F.col("shared").alias("above")), ["turn", "up"])
        else:
            nodes = nodes.withColumn("above", F.lit(0).cast("long"))
        own = F.col("shared").bitwiseAND(F.bitwise_not(F.col("above")))
        nodes = spool(nodes.select("turn", "up", "node", own.alias("mask"), F.col("bits").bitwiseAND(own).alias("bits"), "open", "shared"), "nodes")
        levels.append(nodes)
        marked = named.join(nodes.select("turn", "node", "open"), ["turn", "node"])
        whole = marked.where("not open").groupBy("turn", "node").agg(F.collect_list(code).alias("codes"))
        groups.append(spool(whole.select("turn", F.lit(len(levels) - 1).alias("level"), "node", "codes"), "groups"))
        # the next split goes beyond the leading bits that every open node shares
        width = nodes.where("open").agg(F.max(F.length(F.bin(F.bitwise_not("shared"))))).first()[0]
        if width is None:
            break
        rows = spool(marked.where("open").select(*kept), "codes")
        held, before, depth = nodes, depth, min(64, max(depth, 64 - width) + STEP)
    every = groups[0]
    for more in groups[1:]:
        every = every.unionByName(more)
    return levels, every


def near_groups(levels: list[DataFrame], n_turns: int, reach: Reach) -> DataFrame:
    """turn, a_level, a, b_level, b: pairs of groups that may hold links, from the roots down."""
    sides = ("a", "b")
    # a root's name is 0, and nothing is known of the codes below it
    at = {x: F.lit(0).cast("long") for s in sides for x in (s, f"{s}_mask", f"{s}_bits")}
    spark = levels[0].sparkSession
    pairs = spark.range(n_turns).select(F.col("id").cast("int").alias("turn"), *[c.alias(n) for n, c in at.items()], F.lit(True).alias("a_open"), F.lit(True).alias("b_open"), F.lit(-1).alias("a_level"), F.lit(-1).alias("b_level"), F.lit(0).alias("apart"), F.lit(0).alias("leading"), F.lit(True).alias("twin"))
    done = []
    for depth, nodes in enumerate(levels):
        for s in sides:
            below = nodes.select(F.col("turn").alias("n_turn"), F.col("up").alias("n_up"), F.col("node").alias("n_node"), F.col("mask").alias("n_mask"), F.col("bits").alias("n_bits"), F.col("open").alias("n_open"))
            # a group that is not split stays as it is
            joined = pairs.join(below, (pairs.turn == below.n_turn) & (pairs[s] == below.n_up) & pairs[f"{s}_open"], "left")
            got = F.col("n_node").isNotNull()
            pairs = joined.withColumns({
                s: F.coalesce("n_node", s), f"{s}_open": F.coalesce("n_open", F.lit(False)), f"{s}_level": F.when(got, depth).otherwise(F.col(f"{s}_level")),
                f"{s}_new": F.coalesce("n_mask", F.lit(0).cast("long")), f"{s}_bits": F.col(f"{s}_bits").bitwiseOR(F.coalesce("n_bits", F.lit(0).cast("long"))),
            }).drop(*below.columns)
        # of a node and itself, each pair of children comes once
        pairs = pairs.where(~F.col("twin") | (F.col("a") <= F.col("b")))
        known = {s: F.col(f"{s}_mask").bitwiseOR(F.col(f"{s}_new")) for s in sides}
        fresh = known["a"].bitwiseAND(known["b"]).bitwiseAND(F.bitwise_not(F.col("a_mask").bitwiseAND(F.col("b_mask"))))
        found = F.col("a_bits").bitwiseXOR(F.col("b_bits")).bitwiseAND(fresh)
        pairs = pairs.withColumn("found", found).withColumns({"a_mask": known["a"], "b_mask": known["b"], "apart": F.col("apart") + F.bit_count("found"), "leading": F.col("leading") + F.bit_count(F.shiftrightunsigned("found", 64 - reach.block))})
        pairs = pairs.where((F.col("apart") <= reach.radius) & (F.col("leading") <= reach.leading)).drop("a_new", "b_new", "found")
        pairs = pairs.withColumn("twin", (F.col("a_level") == F.col("b_level")) & (F.col("a") == F.col("b")))
        pairs = spool(pairs, "near-nodes")
        done.append(pairs.where("not a_open and not b_open").select("turn", "a_level", "a", "b_level", "b", "twin"))
        pairs = pairs.where("a_open or b_open")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


def fingerprint_links(distinct: DataFrame, group: int = GROUP, first_bits: int = FIRST_BITS) -> DataFrame:
    """(a, b): links that span the groups of fingerprints (column fp) within the contract's reach."""
    rows = distinct.select(F.inline(F.array(*turns(F.col("fp"), NEAR))))
    return links(rows, NEAR.turns, NEAR, group, first_bits)


def links(rows: DataFrame, n_turns: int, reach: Reach, group: int = GROUP, first_bits: int = FIRST_BITS) -> DataFrame:
    """(a, b): links that span the groups of codes, or of their homes; rows as trees() takes them."""
    levels, groups = trees(rows, group, first_bits)
    checked = "check" in rows.columns
    pairs = near_groups(levels, n_turns, reach)
    one, other = (groups.select("turn", F.col("level").alias(f"{s}_level"), F.col("node").alias(s), F.col("codes").alias(f"{s}_codes")) for s in ("a", "b"))
    ready = pairs.join(other, ["turn", "b_level", "b"]).join(one, ["turn", "a_level", "a"])
    # a group and itself are one list
    ready = ready.select("turn", "a_codes", F.when(~F.col("twin"), F.col("b_codes")).alias("b_codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Links] = defaultdict(Links)
            for k, turn in enumerate(batch.column(0).to_pylist()):
                values = [x.values if x.is_valid else None for x in (batch.column(c)[k] for c in (1, 2))]
                codes, checks, homes = (tuple(None if v is None else numbers(v.field(n) if checked else v) for v in values) for n in range(3))
                # homes are the same in all turns
                of = found[-1 if checked else turn]
                group_links(*codes, of, reach, *((checks, homes) if checked else ()))
            back = [tuple(signed(turned(x, -turn % reach.turns * reach.block) if turn > 0 else x) for x in pair) for turn, of in found.items() for pair in (of.stars() if checked else of.found)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in back], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return ready.mapInArrow(run, "a bigint, b bigint")


def numbers(codes: pa.Array) -> np.ndarray:
    return codes.to_numpy(zero_copy_only=False).view(np.uint64)


def classes(prints: DataFrame) -> DataFrame:
    """prints (id, fp, ...) with root, the component's key, and component_id, the smallest id reachable."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """id, fp, component_id (and `extra`) of every row."""
    return classes(spool(fingerprints(docs, id_col, text_col, *extra), "fingerprints"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """id, root (and `extra`) of every row; near texts share their root.

    A code stands for the sketches that have it, by the first of them, its home; a home is named by its w0.
    Sketches of one code are linked to its home, and so are the homes of linked codes.
    """
    prints = spool(sketches(docs, id_col, text_col, *extra), "sketches")
    words = [f"w{w}" for w in range(WORDS)]
    each = [F.struct(F.lit(w).alias("word"), F.col(words[w]).alias("code"), F.col(words[(w + 1) % WORDS]).alias("check"), F.col("w0").alias("home")) for w in range(WORDS)]
    long = prints.select(*words).distinct().select(F.inline(F.array(*each)))
    codes = long.groupBy("word", "code").agg(F.min(F.struct("home", "check")).alias("first"), F.count("*").alias("n"))
    codes = spool(codes.select("word", "code", "first.home", "first.check", "n"), "words")
    rows = codes.select(F.inline(F.array(*turns(F.col("code"), NEAR_TEXT, F.col("word") * NEAR_TEXT.turns, "check", "home"))))
    linked = links(rows, WORDS * NEAR_TEXT.turns, NEAR_TEXT, TEXT_GROUP, TEXT_FIRST_BITS)
    shared = long.select("word", "code", F.col("home").alias("b_home")).join(codes.where("n > 1").select("word", "code", F.col("home").alias("a_home")), ["word", "code"])
    roots = components(linked.union(shared.select("a_home", "b_home")).toDF("a", "b"))
    named = prints.select("id", *extra, F.col("w0").alias("node")).join(roots, "node", "left")
    return named.select("id", *extra, F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near texts: the first, by id, then by place; with its columns."""
    docs = with_places(docs)
    rows = located(docs, F.col(id_col).alias("key_id"), F.col(text_col).alias("key_text"))
    found = near_texts(rows, "key_id", "key_text", "at_file", "at_row")
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "at_file", "at_row")).alias("s"))
    stays = stays.select(F.col("s.at_file").alias("at_file"), F.col("s.at_row").alias("at_row"))
    whole = located(docs, F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    return whole.join(stays, ["at_file", "at_row"], "left_semi").select("whole.*")
