"""SentencePiece encoding and decoding.

A text's best segmentation maximises the sum of its pieces' scores (Viterbi). Pieces lie in a
double-array trie over bytes, with the white-space marker as a space byte. Where a piece begins
with the marker, no piece may run across it, so words are independent; the distinct words of a
batch are segmented together, one array step for each place and piece length. A character that
no piece covers falls back to its bytes. Decoding joins pieces, turns markers into spaces and
drops the space put before the text; it gives back every text exactly, a literal marker character
included, since that one always falls back to bytes.

Of segmentations with equal scores, the one whose last differing piece starts first wins.

Defined results: null stays null in encode() and counts as empty in the digest rows; an empty
text has no pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "▁"
#: What a character without a piece costs beyond the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Zipf-Mandelbrot: a piece's share is inverse to its rank plus this.
ZIPF_SHIFT = 2.7
WORDS = re.compile(r" *[^ ]+| +")
#: Characters of text that Python takes from a batch at a time, and distinct words segmented at once.
CHUNK_CHARS, WORDS_AT_ONCE = 4_000_000, 50_000
#: Distinct words that a worker remembers.
REMEMBERED = 300_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    base: np.ndarray  # of each trie state: where the state for byte b is, less b
    check: np.ndarray  # of each trie state: the state it is reached from
    piece: np.ndarray  # of each trie state: the piece that ends there, or -1
    scores: np.ndarray
    surface: list[bytes]  # of each piece, as decoded
    byte_ids: np.ndarray
    unknown: float
    longest: int
    splits: bool  # no piece holds a marker after other characters


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a double-array trie of the keys."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in zip(keys, values, strict=True):
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][b]
        ends[node] = value
    size = 4 * len(children) + 8192
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    # where to look first for room, by the number of labels: below it there was none
    look = [1] * 257
    window = 2048
    places = [(0, 0)]
    for node, at in places:
        value[at] = ends[node]
        if not children[node]:
            continue
        labels = sorted(children[node])
        while True:
            start = look[len(labels)]
            if start + window + 256 >= len(taken):
                grow = len(taken)
                base, check, value = np.pad(base, (0, grow)), np.pad(check, (0, grow), constant_values=-1), np.pad(value, (0, grow), constant_values=-1)
                taken = np.pad(taken, (0, grow))
            full = np.zeros(window, bool)
            for b in labels:
                full |= taken[start + b : start + b + window]
            room = int(np.argmin(full))
            if not full[room]:
                break
            look[len(labels)] += window
        look[len(labels)] = start = start + room
        base[at] = start
        for b in labels:
            taken[start + b] = True
            check[start + b] = at
            places.append((children[node][b], start + b))
    last = int(np.flatnonzero(taken)[-1]) + 257
    return base[:last], check[:last], value[:last]


@lru_cache(maxsize=4)
def load(model: str = DEFAULT_MODEL, stored_scores: bool = False) -> Vocabulary:
    """The vocabulary of a SentencePiece model file.

    A file made for pair merging stores each piece's rank, not its log probability; Zipf's law
    turns ranks into log scores. stored_scores: take the file's numbers as they are instead.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
    byte_ids = np.full(256, -1, np.int32)
    surface: list[bytes] = []
    normal = []
    for i, name in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            surface.append(bytes([int(name[3:5], 16)]))
        elif i in special:
            surface.append(b"")
        else:
            surface.append(name.replace(MARKER, " ").encode())
            normal.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
    if not stored_scores:
        ranked = np.array(normal)[np.argsort(-scores[normal], kind="stable")]
        share = 1 / (np.arange(len(ranked)) + ZIPF_SHIFT)
        scores[ranked] = np.log(share / share.sum())
    base, check, piece = double_array([surface[i] for i in normal], normal)
    splits = not any(MARKER in names[i].lstrip(MARKER) for i in normal)
    return Vocabulary(base, check, piece, scores, surface, byte_ids, float(scores[normal].min()) - UNKNOWN_PENALTY, max(len(surface[i]) for i in normal), splits)


def segment(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of the words (space for marker) one after another, and each word's count."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    in_order = lengths[order]
    flats, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    i = 0
    while i < len(order):
        # words of like length, so that padding stays small, and few of them if they are long
        longest_here = int(in_order[i]) * 5 // 4 + 4
        stop = min(int(np.searchsorted(in_order, longest_here, "right")), i + max(1, min(WORDS_AT_ONCE, 4_000_000 // longest_here)))
        flat, count = _viterbi([words[k] for k in order[i:stop].tolist()], in_order[i:stop], v)
        flats.append(flat)
        counts.append(count)
        i = stop
    flat, count = np.concatenate(flats), np.concatenate(counts)
    # from the order of lengths back to that of the words
    firsts = np.cumsum(count) - count
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    sizes = count[back]
    return flat[np.repeat(firsts[back] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


def _viterbi(words: list[bytes], lengths: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    width = int(lengths.max(initial=0))
    n = len(words)
    # place by place in rows, so that a step reads neighbouring memory
    text = np.zeros((width + 4, n), np.uint8)
    if width:
        text[:width] = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T
    best = np.full((width + 5, n), -np.inf)
    best[0] = 0
    start = np.zeros((width + 5, n), np.int32)
    chosen = np.full((width + 5, n), -1, np.int32)
    for p in range(width):
        rows = np.flatnonzero((best[p] > -np.inf) & (lengths > p))
        if not len(rows):
            continue
        here = best[p, rows]
        lead = text[p, rows]
        chars = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(rows), bool)
        live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for q in range(p, min(width, p + v.longest)):
            nxt = v.base[state] + text[q, rows[live]]
            go = (v.check[nxt] == state) & (lengths[rows[live]] > q)
            live, state = live[go], nxt[go]
            if not len(live):
                break
            piece = v.piece[state]
            ends = piece >= 0
            hit, ids = live[ends], piece[ends]
            single[hit] |= chars[hit] == q + 1 - p
            score = here[hit] + v.scores[ids]
            at = rows[hit]
            better = score > best[q + 1, at]
            at = at[better]
            best[q + 1, at], start[q + 1, at], chosen[q + 1, at] = score[better], p, ids[better]
        lone = np.flatnonzero(~single)
        if len(lone):
            at, to = rows[lone], np.minimum(p + chars[lone], lengths[rows[lone]])
            score = here[lone] + v.unknown
            better = score > best[to, at]
            at, to = at[better], to[better]
            best[to, at], start[to, at], chosen[to, at] = score[better], p, -1
    # back from the ends of all words together: (word, start, end, piece or -1)
    at, left = lengths.copy(), np.flatnonzero(lengths > 0)
    steps = []
    while len(left):
        e = at[left]
        s = start[e, left]
        steps.append(np.stack([left, s, e, chosen[e, left]]))
        at[left] = s
        left = left[s > 0]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    word, first, end, piece = np.concatenate(steps, axis=1)
    order = np.lexsort((first, word))
    word, first, end, piece = word[order], first[order], end[order], piece[order]
    # a character without a piece becomes a piece for each of its bytes
    times = np.where(piece < 0, end - first, 1)
    within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    word, first, piece = np.repeat(word, times), np.repeat(first, times), np.repeat(piece, times)
    ids = np.where(piece < 0, v.byte_ids[text[first + within, word]], piece).astype(np.int32)
    return ids, np.bincount(word, minlength=n)


class Numbers(dict):
    """word -> number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Segments:
    """The pieces of words met so far: a word's number gives its run in one flat array.

    Forgets all once it holds REMEMBERED words, so memory stays bounded.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.flat, self.firsts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; words not met before are segmented together."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, known = self.number, len(self.number)
        lists = []
        for t in texts:
            words = (WORDS.findall(" " + t) if self.v.splits else [" " + t]) if t else []
            lists.append(np.array(list(map(number.__getitem__, words)), np.int64))
        fresh = list(islice(number, known, None))
        flat, sizes = segment([w.encode("utf-8", "surrogatepass") for w in fresh], self.v)
        self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        out = []
        for words in lists:
            n = self.sizes[words]
            total = int(n.sum())
            out.append(self.flat[np.repeat(self.firsts[words] - (np.cumsum(n) - n), n) + np.arange(total)])
        return out


def encode_texts(texts: list[str], v: Vocabulary) -> list[np.ndarray]:
    return Segments(v).encode(texts)


def decode_bytes(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text of piece ids, as UTF-8."""
    joined = b"".join(map(v.surface.__getitem__, ids.tolist()))
    return joined[1:] if joined[:1] == b" " else joined


def _parts(column: pa.Array) -> Iterator[tuple[int, list]]:
    """The batch's values, in runs of bounded characters; each run with its first index."""
    at, run, chars = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py()
        run.append(t)
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield at, run
            at, run, chars = i + 1, [], 0
    if run:
        yield at, run


def beside(df: DataFrame, out_col: str, value: Column) -> DataFrame:
    """All columns of df but out_col as one, and `value`; so no name of df is in the way."""
    return df.select(F.struct(*[df[c] for c in df.columns if c != out_col]).alias("whole"), value.alias("value"))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """`docs` with the piece ids of each text, array<int>."""
    v = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: its size is the model's
    rows = beside(docs, out_col, docs[text_col].cast("string"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Segments(v.value)
        for b in batches:
            for at, texts in _parts(b.column(1)):
                ids = pa.array([None if t is None else x for t, x in zip(texts, words.encode([t or "" for t in texts]), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids], names=["whole", "ids"])

    return rows.mapInArrow(run, schema).select("whole.*", F.col("ids").alias(out_col))


def decode(encoded: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """`encoded` with the text of its piece ids."""
    v = encoded.sparkSession.sparkContext.broadcast(load(model))
    rows = beside(encoded, out_col, encoded[ids_col])
    schema = T.StructType([rows.schema[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([None if x.as_py() is None else decode_bytes(np.array(x.as_py(), np.int32), v.value).decode("utf-8", "replace") for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["whole", "text"])

    return rows.mapInArrow(run, schema).select("whole.*", F.col("text").alias(out_col))


def piece_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_bytes, n_pieces, n_byte_pieces, ids_sha256 (of little-endian int32), decoded_sha256, exact."""
    v = docs.sparkSession.sparkContext.broadcast(load(model))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = np.zeros(len(v.value.scores), bool)
        is_byte[v.value.byte_ids] = True
        words = Segments(v.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, texts in _parts(b.column(1)):
                rows = []
                for i, t, x in zip(ids[at : at + len(texts)], texts, words.encode([t or "" for t in texts]), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    back = decode_bytes(x, v.value)
                    rows.append({"doc_id": i, "n_bytes": len(raw), "n_pieces": len(x), "n_byte_pieces": int(is_byte[x].sum()), "ids_sha256": hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest(), "exact": back == raw})
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "doc_id bigint, n_bytes bigint, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)
