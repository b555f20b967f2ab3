"""Diffs of two texts, and the parser of their normal form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the header of a hunk in the normal form.
HEADER = re.compile(r"(\d+)(?:,(\d+))?([acd])(\d+)(?:,(\d+))?")
OPS = {"a": "Add", "c": "Change", "d": "Delete"}


@dataclass(frozen=True)
class Hunk:
    """Line ranges are inclusive; a side without lines has from above to."""

    op: str
    src_from: int
    src_to: int
    dst_from: int
    dst_to: int
    src: tuple[str, ...] = ()
    dst: tuple[str, ...] = ()


def parse_normal(text: str) -> list[Hunk]:
    """Hunks of a diff in normal form; notes on missing line ends are skipped."""
    out: list[Hunk] = []
    head: tuple | None = None
    src: list[str] = []
    dst: list[str] = []

    def done() -> None:
        if head:
            out.append(Hunk(*head, tuple(src), tuple(dst)))

    for line in text.split("\n"):
        if m := HEADER.fullmatch(line):
            done()
            a, b, c, d = int(m[1]), int(m[2] or m[1]), int(m[4]), int(m[5] or m[4])
            op = OPS[m[3]]
            head, src, dst = (op, a + 1 if op == "Add" else a, a if op == "Add" else b, c + 1 if op == "Delete" else c, c if op == "Delete" else d), [], []
        elif line[:2] == "< ":
            src.append(line[2:])
        elif line[:2] == "> ":
            dst.append(line[2:])
        elif line and line != "---" and not line.startswith("\\") and line not in ("<", ">"):
            raise ValueError(f"no line of a normal diff: {line!r}")
    done()
    return out


def expand(range_text: str) -> list[int]:
    """The line numbers of "8" or "8,9"."""
    first, _, last = range_text.partition(",")
    return list(range(int(first), int(last or first) + 1))


def lines_of(text: str) -> list[str]:
    """The lines of a text with their ends; the last one may lack it, and differs by that."""
    return [x + "\n" for x in text.split("\n")[:-1]] + ([text.rsplit("\n", 1)[-1]] if not text.endswith("\n") and text else [])


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A run of equal lines (x, y) to (u, v) in the middle of a shortest edit of a to b, by search from both ends."""
    n, m = len(a), len(b)
    odd = (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            start = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            other = n - m - k
            if odd and -d < other < d and x + back[other] >= n:
                return *start, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            start = x, y
            while x < n and y < m and a[n - x - 1] == b[m - y - 1]:
                x, y = x + 1, y + 1
            back[k] = x
            other = n - m - k
            if not odd and -d <= other <= d and x + ahead[other] >= n:
                return n - x, m - y, n - start[0], m - start[1]
    raise AssertionError("two lists always have a shortest edit")


def _kept(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places that a shortest edit keeps; halves are solved one after another, in memory that grows with the lists."""
    out: list[tuple[int, int]] = []
    left = [(0, len(a), 0, len(b))]
    while left:
        i, n, j, m = left.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i < n and j < m:
            x, y, u, v = _middle(a[i:n], b[j:m])
            out += [(i + x + t, j + y + t) for t in range(u - x)]
            left += [(i, i + x, j, j + y), (i + u, n, j + v, m)]
    return sorted(out)


def diff_lines(src: list[str], dst: list[str]) -> list[Hunk]:
    """Hunks of a shortest edit. Lines that one side alone has are set aside first; a run of
    lines only added or only removed lies as far down as it can. Where equal lines allow several
    shortest edits, other tools may choose another one."""
    number = {line: i for i, line in enumerate(dict.fromkeys([*src, *dst]))}
    a, b = [number[x] for x in src], [number[x] for x in dst]
    in_a, in_b = set(a), set(b)
    places_a, places_b = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    kept = [(places_a[i], places_b[j]) for i, j in _kept([a[i] for i in places_a], [b[j] for j in places_b])]
    out = []
    i = j = at = 0
    kept.append((len(a), len(b)))
    while at < len(kept):
        u, v = kept[at]
        if (u > i) != (v > j):
            # one side only: it may move down over lines that equal its first ones
            side, start, stop = (a, i, u) if u > i else (b, j, v)
            while at + 1 < len(kept) and kept[at + 1] == (u + 1, v + 1) and side[start] == side[stop]:
                i, j, u, v, at, start, stop = i + 1, j + 1, u + 1, v + 1, at + 1, start + 1, stop + 1
        if u > i or v > j:
            op = "Change" if u > i and v > j else "Delete" if u > i else "Add"
            out.append(Hunk(op, i + 1, u, j + 1, v, tuple(x.removesuffix("\n") for x in src[i:u]), tuple(x.removesuffix("\n") for x in dst[j:v])))
        i, j, at = u + 1, v + 1, at + 1
    return out


def diff_texts(src: str, dst: str) -> list[Hunk]:
    """Hunks between two texts; a last line without its end differs from the same line with one."""
    return diff_lines(lines_of(src), lines_of(dst))


DDL = "pair_id bigint, op string, src_from int, src_to int, dst_from int, dst_to int"


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """The hunks of each row of pairs (pair_id, src, dst); null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, h.op, h.src_from, h.src_to, h.dst_from, h.dst_to) for i, s, d in zip(b.pair_id, b.src, b.dst, strict=True) for h in diff_texts(s or "", d or "")]
            yield pd.DataFrame(rows, columns=["pair_id", "op", "src_from", "src_to", "dst_from", "dst_to"])

    return pairs.select("pair_id", "src", "dst").mapInPandas(run, DDL)


def parsed(diffs: DataFrame) -> DataFrame:
    """The hunks of each row of diffs (pair_id, diff), texts in normal form; built-in expressions alone.

    Lines of the two sides begin with a mark, so no other line looks like a header.
    """
    lines = diffs.select("pair_id", F.explode(F.split("diff", "\n")).alias("line")).where(F.col("line").rlike(f"^{HEADER.pattern}$"))
    part = lambda i: F.regexp_extract("line", f"^{HEADER.pattern}$", i)
    number = lambda i, j: F.when(part(i) != "", part(i)).otherwise(part(j)).cast("int")
    added, removed = part(3) == "a", part(3) == "d"
    return lines.select(
        "pair_id", F.when(added, "Add").when(removed, "Delete").otherwise("Change").alias("op"),
        (number(1, 1) + F.when(added, 1).otherwise(0)).alias("src_from"), F.when(added, number(1, 1)).otherwise(number(2, 1)).alias("src_to"),
        (number(4, 4) + F.when(removed, 1).otherwise(0)).alias("dst_from"), F.when(removed, number(4, 4)).otherwise(number(5, 4)).alias("dst_to"),
    )
