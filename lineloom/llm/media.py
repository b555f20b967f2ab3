"""ISO media files in columns: what their boxes say, and documents stored as such files.

The reader walks nested boxes, decodes each track's sample tables and its fragments' runs, and
gives codec, duration and the byte ranges of keyframes; sample bytes are never decoded, only
located. The writer makes a movie of a text: raw 8-bit grey frames, 24 by 24 samples each.

Defined results: null text counts as empty; an empty text still fills one frame; equal texts give
equal files. Of a media column: null gives status "null"; a file whose boxes run past their parent
or whose tables contradict each other gives no tracks and a status that names the fault, never an
error; a file without tracks gives status "ok" and none. Samples that end beyond the file are
"ok" and counted as missing, since files may be cut or their samples lie elsewhere.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 24
FRAME = SIDE * SIDE
TIMESCALE, FRAME_TICKS = 1000, 40
#: Every so many frames one is marked as a keyframe.
GROUP = 12
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf"}
#: Levels of boxes that a file may have; the largest number a column holds.
DEEPEST, MOST = 16, (1 << 63) - 1


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), body)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with bytes 255 to a positive multiple of the frame; their count before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % FRAME or (0 if raw else FRAME)), len(raw)


def write_movie(payload: bytes) -> bytes:
    """The movie file of a payload of whole frames."""
    frames = len(payload) // FRAME
    ticks = frames * FRAME_TICKS
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mvhd = full(b"mvhd", struct.pack(">2Q", 0, 0) + struct.pack(">IQ", TIMESCALE, ticks) + struct.pack(">IH10x", 0x10000, 0x100) + MATRIX + b"\0" * 24 + struct.pack(">I", 2), 1)
    tkhd = full(b"tkhd", struct.pack(">2QIIQ", 0, 0, 1, 0, ticks) + b"\0" * 16 + MATRIX + struct.pack(">2I", SIDE << 16, SIDE << 16), 1, 7)
    mdhd = full(b"mdhd", struct.pack(">2QIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), 1)
    hdlr = full(b"hdlr", struct.pack(">I4s12x", 0, b"vide") + b"frames\0")
    vmhd = full(b"vmhd", b"\0" * 8, 0, 1)
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1) + full(b"url ", b"", 0, 1)))
    entry = box(b"raw ", b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 16 + struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1) + b"\0" * 32 + struct.pack(">Hh", 40, -1))
    stsd = full(b"stsd", struct.pack(">I", 1) + entry)
    stts = full(b"stts", struct.pack(">3I", 1, frames, FRAME_TICKS))
    keys = range(1, frames + 1, GROUP)
    stss = full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys))
    stsz = full(b"stsz", struct.pack(">2I", FRAME, frames))
    chunks = -(-frames // GROUP)
    runs = [(1, GROUP, 1)] if frames >= GROUP else []
    if frames % GROUP:
        runs.append((chunks, frames % GROUP, 1))
    stsc = full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">3I", *r) for r in runs))

    def moov(first: int) -> bytes:
        at = range(first, first + len(payload), FRAME * GROUP)
        co64 = full(b"co64", struct.pack(f">I{len(at)}Q", len(at), *at))
        stbl = box(b"stbl", stsd, stts, stss, stsc, stsz, co64)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", vmhd, dinf, stbl))))

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(head) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path of kinds, first byte of the box, first and last byte of its body) of every box, parents before children."""
    end = len(data) if end is None else end
    if len(path) > DEEPEST:
        raise ValueError(f"boxes nest deeper than {DEEPEST}")
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} bytes left over in {path}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise ValueError(f"box {kind!r} in {path} runs past its parent")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} in {path} runs past its parent")
        yield (*path, kind), start, body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


@dataclass
class Track:
    """One track: samples are (offset, size); keys are the places of keyframes among them."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: list[tuple[int, int]] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)

    @property
    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (start, stop) of the keyframes."""
        return [(self.samples[k][0], sum(self.samples[k])) for k in self.keys]


class Body:
    """Numbers of a box's body, one row after another; a row past its end is an error that names the box."""

    def __init__(self, data: bytes, kind: bytes, at: int, end: int) -> None:
        self.data, self.kind, self.at, self.end = data, kind, at, end

    def rows(self, form: str, n: int = 1) -> list[tuple]:
        size = n * struct.calcsize(f">{form}")
        if self.at + size > self.end:
            raise ValueError(f"box {self.kind!r} ends within its table")
        self.at += size
        return list(struct.iter_unpack(f">{form}", self.data[self.at - size : self.at])) if n else []

    def row(self, form: str) -> tuple:
        return self.rows(form)[0]

    def column(self, n: int, form: str = "I") -> list[int]:
        return [x for (x,) in self.rows(form, n)]

    def claimed(self, n: int) -> int:
        """A count of samples that no table of their own backs up; each takes a byte of the file at least."""
        if n > len(self.data):
            raise ValueError(f"box {self.kind!r} claims {n} samples")
        return n


def sample_sizes(tables: dict[bytes, Body]) -> list[int]:
    if b"stsz" in tables:
        body = tables[b"stsz"]
        _, same, n = body.row("3I")
        return [same] * body.claimed(n) if same else body.column(n)
    body = tables[b"stz2"]
    _, bits, n = body.row("3I")
    bits &= 0xFF
    if bits == 4:
        return [half for x in body.column((n + 1) // 2, "B") for half in (x >> 4, x & 15)][:n]
    if bits not in (8, 16):
        raise ValueError(f"box b'stz2' has sizes of {bits} bits")
    return body.column(n, "B" if bits == 8 else "H")


def decode_tables(track: Track, tables: dict[bytes, Body]) -> None:
    """Fills in codec, samples and keyframes from the boxes of a track's stbl."""
    if b"stsd" in tables and tables[b"stsd"].row("2I")[1]:
        track.codec = tables[b"stsd"].row("I4s")[1].decode("latin-1")
    if not (b"stsz" in tables or b"stz2" in tables):
        return
    sizes = sample_sizes(tables)
    wide = b"co64" in tables
    if sizes and not (b"stsc" in tables and (wide or b"stco" in tables)):
        raise ValueError("a track has sample sizes and no chunks")
    if sizes:
        chunks = tables[b"co64" if wide else b"stco"]
        offsets = chunks.column(chunks.row("2I")[1], "Q" if wide else "I")
        runs = tables[b"stsc"].rows("3I", tables[b"stsc"].row("2I")[1])
        for (first, per, _), (stop, *_) in zip(runs, [*runs[1:], (len(offsets) + 1,)], strict=True):
            if not 1 <= first <= stop <= len(offsets) + 1:
                raise ValueError("box b'stsc' names chunks that the track does not have")
            for place in offsets[first - 1 : stop - 1]:
                k = len(track.samples)
                for size in sizes[k : k + per]:
                    track.samples.append((place, size))
                    place += size
        if len(track.samples) != len(sizes):
            raise ValueError(f"chunks hold {len(track.samples)} of {len(sizes)} samples")
    if b"stss" in tables:
        track.keys = [m - 1 for m in tables[b"stss"].column(tables[b"stss"].row("2I")[1])]
        if any(not 0 <= k < len(sizes) for k in track.keys):
            raise ValueError("box b'stss' names samples that the track does not have")
    else:  # without the table every sample is one
        track.keys = list(range(len(sizes)))


#: Bits of the flags of tfhd and trun, and of a sample that needs others.
TFHD_BASE, TFHD_DESCRIPTION, TFHD_DURATION, TFHD_SIZE, TFHD_FLAGS, TFHD_FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TRUN_OFFSET, TRUN_FIRST, TRUN_DURATION, TRUN_SIZE, TRUN_FLAGS, TRUN_TIME = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
DEPENDS = 0x10000


class Fragment:
    """A traf: where its data begins, and what its samples have unless a run says otherwise."""

    def __init__(self, body: Body, defaults: dict[int, tuple[int, int, int]], moof: int, before: Fragment | None) -> None:
        bits, self.track = body.row("2I")
        self.base = body.row("Q")[0] if bits & TFHD_BASE else moof if bits & TFHD_FROM_MOOF or before is None else before.next
        if bits & TFHD_DESCRIPTION:
            body.row("I")
        known = defaults.get(self.track, (0, 0, 0))
        self.duration, self.size, self.flags = (body.row("I")[0] if bits & bit else known[i] for i, bit in enumerate((TFHD_DURATION, TFHD_SIZE, TFHD_FLAGS)))
        self.next = self.base

    def add(self, body: Body, track: Track) -> None:
        """The samples of a trun."""
        bits, n = body.row("2I")
        if bits & TRUN_OFFSET:
            self.next = self.base + body.row("i")[0]
        first = body.row("I")[0] if bits & TRUN_FIRST else None
        given = [bit for bit in (TRUN_DURATION, TRUN_SIZE, TRUN_FLAGS, TRUN_TIME) if bits & bit]
        rows = body.rows(f"{len(given)}I", n) if given else [()] * body.claimed(n)
        for i, row in enumerate(rows):
            own = dict(zip(given, row, strict=True))
            flags = first if first is not None and i == 0 else own.get(TRUN_FLAGS, self.flags)
            if not flags & DEPENDS:
                track.keys.append(len(track.samples))
            size = own.get(TRUN_SIZE, self.size)
            track.samples.append((self.next, size))
            track.duration += own.get(TRUN_DURATION, self.duration)
            self.next += size


def read_movie(data: bytes) -> list[Track]:
    """The tracks of a file in order of their boxes, the samples of its fragments included."""
    tracks: list[Track] = []
    tables: list[dict[bytes, Body]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[Body, int, list[Body]]] = []
    moof = 0
    for path, start, a, b in walk(data):
        kind, body = path[-1], Body(data, path[-1], a, b)
        long = data[a : a + 1] == b"\1"
        if kind == b"trak":
            tracks.append(Track())
            tables.append({})
        elif kind == b"moof":
            moof = start
        elif kind == b"trex":
            _, track, _, *rest = body.row("6I")
            defaults[track] = tuple(rest)
        elif kind == b"tfhd":
            fragments.append((body, moof, []))
        elif kind == b"trun" and fragments:
            fragments[-1][2].append(body)
        elif tracks and kind == b"tkhd":
            tracks[-1].track_id = body.row("I2QI" if long else "I2II")[-1]
        elif tracks and kind == b"mdhd":
            tracks[-1].timescale, tracks[-1].duration = body.row("I2QIQ" if long else "I2III")[-2:]
        elif tracks and path[-2:] == (b"mdia", b"hdlr"):
            tracks[-1].handler = body.row("2I4s")[-1].decode("latin-1")
        elif tracks and path[-2:-1] == (b"stbl",):
            tables[-1][kind] = body
    for track, boxes in zip(tracks, tables, strict=True):
        decode_tables(track, boxes)
    by_id = {t.track_id: t for t in tracks}
    last: tuple[int, Fragment] | None = None
    for body, moof, runs in fragments:
        fragment = Fragment(body, defaults, moof, last[1] if last and last[0] == moof else None)
        if fragment.track not in by_id:
            raise ValueError(f"a fragment is of track {fragment.track}, which the file does not have")
        for run in runs:
            fragment.add(run, by_id[fragment.track])
        last = moof, fragment
    return tracks


def feature_of(track: Track) -> str:
    """codec, seconds, frames, and the keyframes' count, first and last range and checksum."""
    keys = track.keyframes
    packed = b"".join(struct.pack(">2Q", *k) for k in keys)
    return f"codec={track.codec.strip()};seconds={track.duration / track.timescale:.3f};samples={len(track.samples)};keyframes={len(keys)};first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]};ranges={zlib.crc32(packed):08x}"


TRACKS = pa.list_(pa.struct([
    ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("missing", pa.int64()),
    ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
]))
TRACKS_DDL = "array<struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,missing:bigint,keyframes:array<struct<start:bigint,stop:bigint>>>>"


def status_and_tracks(data: bytes | None) -> tuple[str, list[dict]]:
    if data is None:
        return "null", []
    try:
        tracks = read_movie(data)
    except ValueError as e:
        return str(e), []
    return "ok", [
        {
            "track_id": t.track_id, "handler": t.handler, "codec": t.codec.strip(), "timescale": t.timescale, "duration": min(t.duration, MOST), "samples": len(t.samples),
            "missing": sum(sum(x) > len(data) for x in t.samples), "keyframes": [{"start": min(a, MOST), "stop": min(b, MOST)} for a, b in t.keyframes],
        }
        for t in tracks
    ]


def read_media(files: DataFrame, media_col: str = "media", status_col: str = "media_status", tracks_col: str = "media_tracks") -> DataFrame:
    """`files` with the status of the media file in a binary column and its tracks (TRACKS_DDL); columns of these two names are replaced."""
    kept = [c for c in files.columns if c not in (status_col, tracks_col)]
    rows = files.select(F.struct(*[files[c] for c in kept]).alias("whole"), files[media_col].cast("binary").alias("media"))
    ddl = T.StructType([rows.schema["whole"], T.StructField("status", T.StringType()), T.StructField("tracks", T._parse_datatype_string(TRACKS_DDL))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found = [status_and_tracks(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.string()), pa.array([t for _, t in found], TRACKS)], names=["whole", "status", "tracks"])

    return rows.mapInArrow(run, ddl).select("whole.*", F.col("status").alias(status_col), F.col("tracks").alias(tracks_col))


ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
MEDIA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("duration_ms", pa.int64()),
    ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
])
MEDIA_DDL = "doc_id bigint, n_bytes bigint, media binary, codec string, duration_ms bigint, keyframes array<struct<start:bigint,stop:bigint>>"
ROW_DDL = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
#: Rows of one Arrow batch that Python turns into media at a time.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the file), codec, duration_ms, keyframes (byte ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                payload, n = payload_of(t)
                media = write_movie(payload)
                (movie,) = read_movie(media)
                rows.append({"doc_id": i, "n_bytes": n, "media": media, "codec": movie.codec.strip(), "duration_ms": movie.duration * 1000 // movie.timescale, "keyframes": [{"start": a, "stop": b} for a, b in movie.keyframes]})
            yield pa.RecordBatch.from_pylist(rows, MEDIA)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, MEDIA_DDL)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest row of each document's movie; the payload is read back through its tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                payload, n = payload_of(t)
                media = write_movie(payload)
                (movie,) = read_movie(media)
                back = b"".join(media[a : a + size] for a, size in movie.samples)
                rows.append({"doc_id": i, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(movie)})
            yield pa.RecordBatch.from_pylist(rows, ROW)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ROW_DDL)
