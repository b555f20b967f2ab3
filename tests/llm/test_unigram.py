import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineloom.llm import queries, unigram
from tests.llm import cases

pytestmark = pytest.mark.skipif(not os.path.exists(unigram.DEFAULT_MODEL), reason="no vocabulary here")


def best_score(text, v):
    """The score of the best segmentation, by a plain dynamic programme over the whole text."""
    data = b" " + text.encode()
    pieces = {s: v.scores[i] for i, s in enumerate(v.surface) if s and i not in set(v.byte_ids.tolist())}
    best = [-np.inf] * (len(data) + 1)
    best[0] = 0.0
    for p in range(len(data)):
        if best[p] == -np.inf or data[p] & 0xC0 == 0x80:
            continue
        chars = 1 + sum(data[p] >= x for x in (0xC0, 0xE0, 0xF0))
        for q in range(p + 1, min(len(data), p + v.longest) + 1):
            if data[p:q] in pieces:
                best[q] = max(best[q], best[p] + pieces[data[p:q]])
        if data[p : p + chars] not in pieces:
            best[p + chars] = max(best[p + chars], best[p] + v.unknown)
    return best[-1]


def score_of(text, ids, v):
    """Pieces' scores; a run of byte pieces costs one unknown for each character it spells."""
    total, pending = 0.0, b""
    for i in ids.tolist():
        if i in set(v.byte_ids.tolist()):
            pending += v.surface[i]
        else:
            total += v.scores[i]
    lost = b"".join(v.surface[i] for i in ids.tolist() if i in set(v.byte_ids.tolist()))
    return total + v.unknown * len(lost.decode())


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="the andré ▁\n\té😀ß ", max_size=40))
def test_segmentation_is_the_best_and_decodes(text):
    v = unigram.load()
    ids = unigram.encode_texts([text], v)[0]
    assert unigram.decode_bytes(ids, v).decode() == text
    if text:
        assert score_of(text, ids, v) == pytest.approx(best_score(text, v), rel=1e-9)


def test_trie_holds_its_keys_and_no_other():
    keys = [b"a", b"ab", b"abc", b"b", b"xyz", b"\xff\x00"]
    base, check, value = unigram.double_array(keys, list(range(6)))

    def find(key):
        s = 0
        for b in key:
            n = base[s] + b
            if n >= len(check) or check[n] != s:
                return -1
            s = n
        return value[s]

    assert [find(k) for k in keys] == list(range(6))
    assert [find(k) for k in (b"", b"abcd", b"xy", b"c", b"\xff")] == [-1] * 5


def test_memory_is_forgotten_without_change(monkeypatch):
    monkeypatch.setattr(unigram, "REMEMBERED", 3)
    v = unigram.load()
    words = unigram.Segments(v)
    for text in ("one two three four", "five six seven", "one nine"):
        assert words.encode([text])[0].tolist() == unigram.encode_texts([text], v)[0].tolist()


def test_encode_and_decode_frames(spark, tmp_path):
    docs = cases.frame(spark, extra=True)
    back = unigram.decode(unigram.encode(docs)).select("doc_id", "text", "decoded").collect()
    assert len(back) == len(cases.awkward()) and all(r.text == r.decoded for r in back)
    rows = queries.op8_unigram_pieces(spark, cases.table(spark, tmp_path, cases.frame(spark))).collect()
    assert len(rows) == len(cases.awkward()) and all(r.exact for r in rows)
    assert unigram.piece_rows(cases.empty(spark)).count() == 0


def test_names_that_the_operator_uses_itself(spark):
    docs = cases.frame(spark, [(1, "a b", "", "", 0), (2, None, "", "", 0)]).selectExpr("*", "'x' as __text", "2 as __ids")
    out = unigram.decode(unigram.encode(docs)).orderBy("doc_id").collect()
    assert [(r["__text"], r["__ids"], r.decoded) for r in out] == [("x", 2, "a b"), ("x", 2, None)]


def test_ties_go_to_the_last_piece_that_starts_first():
    keys = [b"a", b"aa", b"aaa", b" "]
    base, check, piece = unigram.double_array(keys, [0, 1, 2, 3])
    v = unigram.Vocabulary(base, check, piece, np.array([-1.0, -2.0, -3.0, -1.0]), keys, np.zeros(256, np.int32), -9.0, 3, True)
    for word, want in ((b"aa", [1]), (b"aaa", [2]), (b"aaaa", [0, 2]), (b"aaaaa", [1, 2])):
        assert unigram.segment([word], v)[0].tolist() == want
