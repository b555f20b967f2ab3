import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineloom.llm import media, queries
from tests.llm import cases


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=3000))
def test_round_trip(text):
    payload, n = media.payload_of(text)
    assert n == len(text.encode()) and len(payload) % 576 == 0 and len(payload) > 0
    data = media.write_movie(payload)
    (movie,) = media.read_movie(data)
    assert b"".join(data[a : a + s] for a, s in movie.samples) == payload
    assert (movie.codec, movie.handler, movie.track_id) == ("raw ", "vide", 1) and movie.duration == 40 * len(movie.samples)
    assert len(movie.keyframes) == -(-len(movie.samples) // media.GROUP)
    assert all(b - a == 576 for a, b in movie.keyframes)


def test_walk_gives_parents_first_and_names_broken_boxes():
    data = media.write_movie(media.payload_of("x")[0])
    paths = [p for p, *_ in media.walk(data)]
    assert paths[0] == (b"ftyp",) and paths[-1] == (b"mdat",)
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths
    with pytest.raises(ValueError, match="mdat"):
        list(media.walk(data[:-1]))


def test_query(spark, tmp_path):
    rows = cases.awkward()
    out = queries.op10_iso_media(spark, cases.table(spark, tmp_path, cases.frame(spark, extra=True))).collect()
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(want)
    by_text = {}
    assert all(by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature) for r in out)
    files = media.to_media(cases.frame(spark)).collect()
    assert all(bytes(f.media[k.start : k.stop]) for f in files for k in f.keyframes)
    assert media.media_digests(cases.empty(spark)).count() == 0


box, full, pack = media.box, media.full, struct.pack


def track(number, handler, codec, tables, timescale=1000, duration=0, version=0):
    times = pack(">2QIQ", 0, 0, timescale, duration) if version else pack(">4I", 0, 0, timescale, duration)
    head = pack(">2QI", 0, 0, number) if version else pack(">3I", 0, 0, number)
    stbl = box(b"stbl", full(b"stsd", pack(">I", 1) + box(codec, b"\0" * 8)), *tables)
    return box(b"trak", full(b"tkhd", head + b"\0" * 60, version), box(b"mdia", full(b"mdhd", times + b"\0" * 4, version), full(b"hdlr", pack(">I4s", 0, handler) + b"\0" * 12), box(b"minf", stbl)))


def two_tracks():
    """Video with sizes and keyframes, sound with 4-bit sizes; their chunks take turns. And what must be read."""
    data = bytes(range(200))
    video = [full(b"stsz", pack(">6I", 0, 4, 10, 20, 30, 40)), full(b"stsc", pack(">7I", 2, 1, 1, 1, 3, 2, 1)), full(b"stss", pack(">3I", 2, 1, 3))]
    sound = [full(b"stz2", pack(">2I", 4, 3) + b"\x5a\x70"), full(b"stsc", pack(">4I", 1, 1, 3, 1))]

    def head(at):
        v, s = full(b"stco", pack(">4I", 3, at, at + 50, at + 100)), full(b"co64", pack(">IQ", 1, at + 10))
        return box(b"ftyp", b"isom") + box(b"moov", full(b"mvhd", b"\0" * 96), track(1, b"vide", b"avc1", [*video, v], 90_000, 360_000, 1), track(7, b"soun", b"mp4a", [*sound, s], 48_000, 96_000))

    at = len(head(0)) + 8
    return head(at) + box(b"mdat", data), at


def test_several_tracks_keep_their_own_tables():
    data, at = two_tracks()
    video, sound = media.read_movie(data)
    assert (video.codec, video.handler, video.track_id, video.timescale, video.duration) == ("avc1", "vide", 1, 90_000, 360_000)
    assert video.samples == [(at, 10), (at + 50, 20), (at + 100, 30), (at + 130, 40)]
    assert video.keyframes == [(at, at + 10), (at + 100, at + 130)]
    assert (sound.codec, sound.track_id, sound.samples) == ("mp4a", 7, [(at + 10, 5), (at + 15, 10), (at + 25, 7)])
    assert sound.keyframes == [(at + 10, at + 15), (at + 15, at + 25), (at + 25, at + 32)]


def test_fragments():
    empty = [full(b"stsz", pack(">2I", 0, 0)), full(b"stsc", pack(">I", 0)), full(b"stco", pack(">I", 0))]
    moov = box(b"moov", track(1, b"vide", b"hvc1", empty), track(2, b"soun", b"Opus", empty), box(b"mvex", full(b"trex", pack(">5I", 1, 1, 40, 0, 0x10000)), full(b"trex", pack(">5I", 2, 1, 20, 6, 0))))
    run = full(b"trun", pack(">IiI", 3, 500, 0) + pack(">3I", 11, 12, 13), flags=media.TRUN_OFFSET | media.TRUN_FIRST | media.TRUN_SIZE)
    more = full(b"trun", pack(">I", 1) + pack(">2I", 99, 14), flags=media.TRUN_DURATION | media.TRUN_SIZE)
    sound = full(b"trun", pack(">I", 2))
    moof = box(b"moof", full(b"mfhd", pack(">I", 1)), box(b"traf", full(b"tfhd", pack(">I", 1), flags=media.TFHD_FROM_MOOF), run, more), box(b"traf", full(b"tfhd", pack(">I", 2)), sound))
    data = moov + moof + box(b"moof", box(b"traf", full(b"tfhd", pack(">IQ", 2, 5000), flags=media.TFHD_BASE), sound))
    one, two = media.read_movie(data)
    first = len(moov) + 500
    assert one.samples == [(first, 11), (first + 11, 12), (first + 23, 13), (first + 36, 14)] and one.keys == [0]
    assert one.duration == 3 * 40 + 99
    assert two.samples == [(first + 50, 6), (first + 56, 6), (5000, 6), (5006, 6)] and two.keys == [0, 1, 2, 3] and two.duration == 80


def test_media_column(spark):
    good, at = two_tracks()
    cut = good[: at + 120][:-1]
    nested = b""
    for _ in range(40):
        nested = box(b"moov", nested)
    lying = box(b"moov", track(1, b"vide", b"x264", [full(b"stsz", pack(">2I", 5, 1 << 31))]))
    wrong_key = box(b"moov", track(1, b"vide", b"x264", [full(b"stsz", pack(">2I", 0, 0)), full(b"stss", pack(">2I", 1, 9))]))
    short = box(b"moov", track(1, b"vide", b"x264", [full(b"stsz", pack(">2I", 0, 50))]))
    no_chunks = box(b"moov", track(1, b"vide", b"x264", [full(b"stsz", pack(">2I", 1, 2))]))
    rows = [(1, good), (2, None), (3, b""), (4, b"text"), (5, cut), (6, nested), (7, lying), (8, wrong_key), (9, box(b"ftyp", b"isom")), (10, short), (11, no_chunks), (1, good), (12, box(b"moof", box(b"traf", full(b"tfhd", pack(">I", 3)))))]
    df = spark.createDataFrame(rows, "doc_id int, media binary").selectExpr("*", "'x' as whole", "'y' as status", "1 as tracks")
    out = media.read_media(df)
    assert out.columns == [*df.columns, "media_status", "media_tracks"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and (got[1].whole, got[1].status, got[1].tracks) == ("x", "y", 1)
    assert {k: r.media_status.split(" ")[0] if r.media_status not in ("ok", "null") else r.media_status for k, r in got.items()} == {1: "ok", 2: "null", 3: "ok", 4: "4", 5: "box", 6: "boxes", 7: "box", 8: "box", 9: "ok", 10: "box", 11: "a", 12: "a"}
    assert [(t.codec, t.samples, t.missing, len(t.keyframes)) for t in got[1].media_tracks] == [("avc1", 4, 0, 2), ("mp4a", 3, 0, 3)]
    assert all(r.media_tracks == [] for k, r in got.items() if k != 1)
    assert media.read_media(out).columns == out.columns and media.read_media(df.limit(0)).count() == 0


def test_samples_beyond_the_file_are_counted():
    head = lambda at: box(b"moov", track(1, b"vide", b"x264", [full(b"stsz", pack(">4I", 0, 2, 5, 5)), full(b"stsc", pack(">4I", 1, 1, 2, 1)), full(b"stco", pack(">2I", 1, at))]))
    data = head(len(head(0)) + 8) + box(b"mdat", b"1234567")
    status, (found,) = media.status_and_tracks(data)
    assert status == "ok" and (found["samples"], found["missing"]) == (2, 1)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_no_damage_is_more_than_a_status(data):
    good = bytearray(two_tracks()[0][:900])
    for _ in range(data.draw(st.integers(1, 6))):
        good[data.draw(st.integers(0, len(good) - 1))] = data.draw(st.integers(0, 255))
    status, tracks = media.status_and_tracks(bytes(good[: data.draw(st.integers(0, len(good)))]))
    assert status == "ok" or tracks == []
