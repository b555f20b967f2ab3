import random
import zlib

import numpy as np

from lineloom.llm import quality, queries, toxicity
from tests.llm import cases

SEEDS = {"quality": 1, "toxic": 2}


def corpus(n=600, seed=3):
    r = random.Random(seed)
    syllables = ["ba", "ri", "to", "men", "la", "us", "ken", "dor"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 120))]
        toxic, junk = r.random() < 0.25, r.random() < 0.3
        if toxic:
            for _ in range(r.randint(2, 6)):
                words[r.randrange(len(words))] = r.choice(["zarkfool", "vexq" + word(), "grumb" + word()])
        text = " ".join(words)
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " | ".join(text.split())
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def tables(spark, tmp_path):
    docs, labels = corpus()
    cases.table(spark, tmp_path, cases.frame(spark, docs + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "no id", "en", "s", 0)]))
    cases.table(spark, tmp_path, spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (77_777, 0, 1)], "doc_id bigint, quality int, toxic int"), "labels")
    return str(tmp_path), {r[0]: r[1:] for r in labels}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def check(rows, labels, at, threshold):
    assert len(rows) == 603
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    known = [r for r in rows if r.doc_id in labels and r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][at] for r in known]) > 0.93


def test_quality_held_out(spark, tmp_path):
    path, labels = tables(spark, tmp_path)
    check(queries.op4_rule_quality(spark, path).collect(), labels, 0, 0.3)


def test_toxicity_held_out(spark, tmp_path):
    path, labels = tables(spark, tmp_path)
    check(queries.op5_crf_toxicity(spark, path).collect(), labels, 1, 0.5)


def test_held_out_labels_change_nothing(spark, tmp_path):
    path, labels = tables(spark, tmp_path)
    before = {r.doc_id: r.score for r in queries.op5_crf_toxicity(spark, path).collect()}
    turned = [(i, q if not held(i) else 1 - q, t if not held(i) else 1 - t) for i, (q, t) in labels.items()]
    cases.table(spark, tmp_path, spark.createDataFrame(turned, "doc_id bigint, quality int, toxic int"), "labels")
    after = {r.doc_id: r.score for r in queries.op5_crf_toxicity(spark, path).collect()}
    assert all(abs(before[k] - after[k]) < 1e-9 for k in before)


def test_without_labels(spark):
    docs, none = cases.frame(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score_rows(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score_rows(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert toxicity.keep_clean(docs, none).columns == docs.columns
    assert quality.score_rows(cases.empty(spark), quality.fit(docs, none)).count() == 0


def test_compiled_rules_equal_the_model(spark):
    docs, labels = corpus(200)
    df, known = cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, known)
    assert len(model.rules) > 0
    rows = quality.with_features(df, df.text).select("doc_id", *quality.NAMES).toPandas().sort_values("doc_id")
    want = model.score(rows[quality.NAMES].to_numpy(float))
    got = [r.score for r in quality.score_rows(df, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want)


def test_weights_are_those_of_the_lasso():
    """At the optimum a kept rule's pull equals the penalty, and the bias has none."""
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 3))
    y = (r.random(1500) < 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) - 1.5 * (x[:, 1] < -0.2))))).astype(float)
    model = quality.fit_rules(x, y)
    error = y - model.score(x)
    assert model.rules and abs(error.mean()) < 1e-4
    for w, terms in model.rules:
        hits = quality.holds(x, terms).astype(float)
        pull = ((hits - hits.mean()) / hits.std()) @ error / len(y)
        assert abs(pull - np.sign(w) * quality.LASSO) < 2e-4


def enumerate_marginals(model, words):
    """P(toxic) of each token from all state sequences."""
    emit = [toxicity.Emissions(model)[w] + model.bias for w in words]
    total, on = 0.0, np.zeros(len(words))
    for code in range(1 << len(words)):
        y = [code >> i & 1 for i in range(len(words))]
        p = np.exp(sum(e for e, s in zip(emit, y, strict=True) if s) + sum(model.switch[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        on += p * np.array(y)
    return on / total


def test_marginals_over_runs_are_exact():
    model = toxicity.ToxicModel({"bad": 0, "vex*": 1}, np.array([4.0, 2.5]), -3.0, np.array([[0.5, -0.7], [0.2, 0.9]]))
    for text in ("bad", "a b bad", "bad c d e", "a vexing b c d bad e f", "bad vexed", "a b c bad d vexx vexy e"):
        at, emit, total = toxicity.active(text, toxicity.Emissions(model))
        got = toxicity.marginals(model, [(at, emit, total)])[0]
        assert np.allclose(got, enumerate_marginals(model, text.split())[at], atol=1e-6)


def forward_backward(model, words):
    """P(toxic) of each token, token by token."""
    emit = [np.exp(np.array([0.0, toxicity.Emissions(model)[w] + model.bias])) for w in words]
    step = np.exp(model.switch)
    ahead, back = [emit[0] / emit[0].sum()], [np.ones(2)]
    for e in emit[1:]:
        a = (ahead[-1] @ step) * e
        ahead.append(a / a.sum())
    for e in emit[:0:-1]:
        b = step @ (e * back[-1])
        back.append(b / b.sum())
    p = np.array(ahead) * np.array(back[::-1])
    return p[:, 1] / p.sum(1)


def test_marginals_over_long_runs_are_exact():
    sticky = np.array([[0.0, -7.0], [-8.5, 0.0]])
    for switch, bias in ((sticky, 0.0), (sticky, -0.001), (sticky.T, 0.002), (np.array([[-3.0, 1.0], [1.0, -3.0]]), -0.5), (np.zeros((2, 2)), -2.0)):
        model = toxicity.ToxicModel({"bad": 0}, np.array([4.0]), bias, switch)
        for gap in (0, 1, 7, 1500, 5000):
            words = ["x"] * gap + ["bad"] + ["x"] * gap + ["bad", "bad"] + ["x"] * (gap // 2)
            at, emit, total = toxicity.active(" ".join(words), toxicity.Emissions(model))
            got = toxicity.marginals(model, [(at, emit, total)])[0]
            assert np.allclose(got, forward_backward(model, words)[at], atol=1e-9)


def test_gradient_of_the_chain_is_that_of_its_likelihood(monkeypatch):
    """One step of training from zero moves along the gradient of the windows' log-likelihood."""
    monkeypatch.setattr(toxicity, "TRAIN_STEPS", 1)
    texts, y = ["a b bad c", "bad", "a bad b"], np.array([1, 0, 1])
    model = toxicity.ToxicModel({"bad": 0}, np.zeros(1))
    toxicity._train_chain(model, texts, y, {"bad": 1.0}, np.ones(3))

    def likelihood(theta):
        total = 0.0
        for text, toxic in zip(texts, y, strict=True):
            words = text.split()
            emit = [theta[0] * (w == "bad") + theta[1] for w in words]
            score = lambda s: sum(e for e, k in zip(emit, s, strict=True) if k) + sum(theta[2 + 2 * a + b] for a, b in zip(s, s[1:], strict=False))  # noqa: E731, B023
            states = [[c >> i & 1 for i in range(len(words))] for c in range(1 << len(words))]
            total += score([int(toxic and w == "bad") for w in words]) - np.log(sum(np.exp(score(s)) for s in states))
        return total / 3 - toxicity.RIDGE / 2 * (theta @ theta)

    start = np.array([0.0, -2.0, 0, 0, 0, 0])
    slope = [(likelihood(start + d) - likelihood(start - d)) / 2e-5 for d in np.eye(6) * 1e-5]
    moved = np.concatenate([model.weights, [model.bias], model.switch.ravel()]) - start
    assert np.allclose(moved, 0.1 * np.sign(slope), atol=1e-3)


def test_awkward_frames_are_scored(spark):
    docs, labels = corpus(200)
    docs = [(1000 + r[0], *r[1:]) for r in docs]
    known = spark.createDataFrame([(1000 + i % 170, q, t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    df = cases.frame(spark, docs + cases.awkward(), extra=True)
    n = len(docs) + len(cases.awkward())
    for rows in (quality.score_rows(df, quality.fit(df, known)), toxicity.score_rows(df, toxicity.fit(df, known))):
        out = rows.collect()
        assert len(out) == n and all(0 <= r.score <= 1 for r in out)
        twice = [r for r in out if r.doc_id == 102]
        assert len(twice) == 2 and len({r.score for r in twice}) == 1
    assert toxicity.keep_clean(df, known).columns == df.columns


def test_offsets_of_spans(spark):
    docs, labels = corpus()
    df, known = cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, known)
    text = "ba ri Zarkfool to men"
    (start, stop, p), = toxicity.spans(model, text)
    assert text[start:stop] == "Zarkfool" and p > 0.5
    found = toxicity.offending(cases.frame(spark, [(1, text, "", "", 0), (2, "ba ri", "", "", 0), (3, None, "", "", 0)]), model).collect()
    assert [(r.doc_id, r.spans[0].start) for r in found] == [(1, 6)]


def test_scores_keep_the_rate_of_labels_that_are_cut_to_the_sample(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(4000):
        toxic = r.random() < 0.1
        words = [r.choice(["ba", "ri", "to", "men", "la"]) for _ in range(12)]
        if r.random() < (0.5 if toxic else 0.05):  # a sign that proves neither label
            words[r.randrange(12)] = "zarkfool"
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    df, known = cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    share = np.mean([t for i, _, t in labels if held(i)])
    scores = {}
    for sample in (250, 4000):  # as on a large table, with both labels cut; and with all labels
        rows = toxicity.score_rows(df, toxicity.fit(df, known, sample=sample)).where("held_out").collect()
        assert abs(np.mean([x.score for x in rows]) - share) < 0.03
        scores[sample] = np.array([x.score for x in sorted(rows)])
    assert np.abs(scores[250] - scores[4000]).mean() < 0.03


def test_a_long_text_leaves_no_feature_untrained():
    texts = ["zarkfool " * 60_001] + ["ba ri vexq to", "men zarkfool la"] * 20 + ["ba ri to men la"] * 100
    model = toxicity.fit_model(texts, [1] * 41 + [0] * 100)
    assert {"vexq", "zarkfool"} <= set(model.features)
    assert all(model.weights[i] > 0 for i in model.features.values())


def test_quality_sample_of_repeated_ids_holds_texts_of_all_lengths(spark, monkeypatch):
    docs = [(i, "ba " * (1 + (7 * i + 13 * c) % 100), "en", "s", 0) for i in range(100) for c in range(10)]
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_rules", lambda x, y: seen.append(x) or quality.RuleModel(0.0, ()))
    for sample in (20, 1000):  # 200 rows of the sampled ids, cut to 40; and nothing cut
        quality.fit(cases.frame(spark, docs), known, sample=sample)
    assert len(seen[0]) == 40 and abs(seen[0][:, 0].mean() - seen[1][:, 0].mean()) < 0.4
