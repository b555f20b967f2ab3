import random
import re

from lineloom.llm import licenses, queries
from lineloom.llm.license_texts import BASE_PHRASES, NOTICES
from tests.llm import cases


def by_hand(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.", "MIT license mit LICENSE, mit-license; cc by cc by", "gnu general public", "GNU General Public License gnu general public license",
    "Apache\nLicense apache  license cc", "cc bykes cc by", "", None, "über mit license мит license", "MIT License " * 500, NOTICES[0][0], "by cc by",
]


def test_base_columns_match_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    out = queries.op2_license_scan(spark, cases.table(spark, tmp_path, cases.frame(spark, rows))).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out} == {i: by_hand(t) for i, t in enumerate(TEXTS)}
    assert all(0 <= r.score <= 1 for r in out)


def test_awkward_rows_are_each_scanned(spark):
    out = licenses.license_rows(cases.frame(spark, extra=True)).collect()
    assert sorted(r.n_words for r in out) == sorted(by_hand(t)[0] for _, t, *_ in cases.awkward())
    assert licenses.license_rows(cases.empty(spark)).count() == 0


def test_notices_survive_edits_and_below_the_threshold_are_none(spark):
    mit = NOTICES[0][0].split()
    edited = " ".join(["word"] * 30 + mit[:20] + ["inserted"] + mit[20:] + ["more"] * 5)
    half = " ".join(mit[: len(mit) // 2])
    out = {r.doc_id: r for r in licenses.license_rows(cases.frame(spark, [(1, edited, "", "", 0), (2, half, "", "", 0), (3, "plain text of no licence", "", "", 0)])).collect()}
    assert out[1].labels == "mit" and 0.8 <= out[1].score < 1 and out[1].n_base == 0
    assert out[2].labels == "" and out[3].labels == "" and out[3].score == 0
    span = licenses.scan(cases.frame(spark, [(1, edited, "", "", 0)])).first().spans[0]
    assert (span.first, span.last) == (30, 30 + len(licenses.words_of(NOTICES[0][0])))


def test_notices_with_a_stretch_put_in_are_found(spark):
    """Whole notices with 5 to 10 words in their middle: a place costs 4 grams, whatever its length."""
    rows, want = [], {}
    for text, label in NOTICES:
        words = text.split()
        grams = len(licenses.words_of(text)) - licenses.NOTICE_K + 1
        if (grams - 4) / grams < licenses.MIN_SIMILARITY:
            continue
        for n in (5, 10):
            i = len(rows)
            middle = len(words) // 2
            rows.append((i, " ".join(words[:middle] + ["other"] * n + words[middle:]), "", "", 0))
            want[i] = label
    out = {r.doc_id: r.labels.split(",") for r in licenses.license_rows(cases.frame(spark, rows)).collect()}
    assert len(want) >= 12 and all(label in out[i] for i, label in want.items())
    # halves that lie further apart than half the notice are two spans, and neither is enough
    words = NOTICES[0][0].split()
    apart = " ".join(words[:30] + ["other"] * len(words) + words[30:])
    assert licenses.license_rows(cases.frame(spark, [(1, apart, "", "", 0)])).first().labels == ""


def labels_by_hand(text):
    """Labels and score: every template's grams looked up one by one, places of one stretch taken together."""
    words = licenses.words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(), 0.0
    for t in licenses.templates():
        grams = [tuple(t["words"][i : i + t["k"]]) for i in range(len(t["words"]) - t["k"] + 1)]
        votes = sorted({(p - at, at) for p in range(len(words) - t["k"] + 1) for at, g in enumerate(grams) if tuple(words[p : p + t["k"]]) == g})
        reach = len(t["words"]) // licenses.NEAR_PART if t["kind"] == "notice" else 0
        found, before = set(), None
        for diagonal, at in [*votes, (1 << 40, -1)]:
            if before is not None and diagonal - before > reach:
                share = len(found) / len(grams)
                if share >= (licenses.MIN_SIMILARITY if t["kind"] == "notice" else 1.0):
                    labels.add(t["label"])
                    score = max(score, share)
                found = set()
            found.add(at)
            before = diagonal
    return ",".join(sorted(labels)), score


def test_labels_and_scores_match_brute_force(spark):
    r = random.Random(2)
    texts = list(TEXTS)
    for text, _ in NOTICES[:4]:
        words = text.split()
        for edits in (1, 4, 12):
            w = list(words)
            for _ in range(edits):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 2)] = ["other"] * r.randint(0, 6)
            texts.append(" ".join(["before"] * r.randint(0, 9) + w + w[: len(w) // 2]))
    out = {x.doc_id: (x.labels, x.score) for x in licenses.license_rows(cases.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        labels, score = labels_by_hand(t)
        assert out[i][0] == labels and abs(out[i][1] - score) < 1e-12
