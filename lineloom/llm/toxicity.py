"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, lowered. Documents carry the labels, tokens don't: words and word
beginnings that toxic documents of the sample hold far more often than others label the tokens of
toxic documents as toxic, all others as clean. A two-state chain is trained on these token
sequences (log-likelihood with a ridge, gradients by forward-backward). Its marginals mark
offending spans with their offsets; a document's score is a logistic function of its greatest
marginal and of the sum of its marginals, fitted on the sample's document labels. Where the sample
holds fewer documents of a label than there are, each stands for several: chain and score are
fitted with these weights, so that they see the labels at the table's rates.

Tokens without any feature are alike, so a run of them is a power of one 2 by 2 matrix, taken in
closed form from its eigenvalues; forward and backward passes jump over runs of any length and stay exact.

Bounds: at most SAMPLE labelled documents of each label teach the model (twice as many rows where
ids repeat), chosen by hash. All their tokens and all features that pass the test are used.

Defined results: null text counts as empty and gets a score; labels that are null or of unknown
ids are ignored, and of labels that repeat an id the largest counts; without labels of both
kinds every score is the share of label 1 (zero if there is none).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import held_out
from lineloom.llm.quality import permitted_labels

#: Labelled documents that a model is fitted on at most, of each label.
SAMPLE = 3_000
THRESHOLD = 0.5
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features, besides whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A feature needs so many toxic documents, and this score of a two-share test, to be kept.
LEAST_DOCS, LEAST_Z = 4, 5.0
#: Tokens around one with features that a training sequence holds.
AROUND = 6
#: Training sequences that are spelled out at a time.
WINDOWS_AT_ONCE = 4096
TRAIN_STEPS, RIDGE = 120, 1e-3
#: Texts of one Arrow batch that Python scores at a time, by characters.
CHUNK_CHARS = 2_000_000
#: Distinct words whose features a worker remembers, and the driver while it fits.
REMEMBERED, FIT_REMEMBERED = 400_000, 100_000
NO_FEATURES: tuple[list[int], bool] = ([], False)


@dataclass
class ToxicModel:
    """features: word, or beginning and "*" -> index. Scores are those of state 1 less state 0."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    switch: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: of the document score: constant, greatest marginal's logit, log of the sum
    blend: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0]))


def names_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n]]


class Emissions(dict):
    """word -> its emission score; 0.0 exactly for words without features."""

    def __init__(self, model: ToxicModel) -> None:
        self.model = model

    def __missing__(self, word: str) -> float:
        known = [self.model.features[n] for n in names_of(word) if n in self.model.features]
        value = float(self.model.weights[known].sum()) or 1e-12 if known else 0.0
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def pick_features(texts: list[str], toxic: np.ndarray) -> tuple[dict[str, int], dict[str, float]]:
    """Words and beginnings that toxic documents hold far more often than others; and how precise each is."""

    def names(wanted: int) -> Iterator[set[str]]:
        """The distinct names of each text of a label, one text at a time."""
        for t, y in zip(texts, toxic, strict=True):
            if y == wanted:
                yield {n for x in set(TOKEN.findall(t.lower())) for n in names_of(x)}

    # rough counts by hash rule out most names; the others are counted exactly
    rough = np.zeros(1 << 22, np.int32)
    for found in names(1):
        rough[np.unique(np.fromiter(map(hash, found), np.int64, len(found)) & (len(rough) - 1))] += 1
    inside: Counter = Counter()
    for found in names(1):
        inside.update(n for n in found if rough[hash(n) & (len(rough) - 1)] >= LEAST_DOCS)
    likely = {n for n, c in inside.items() if c >= LEAST_DOCS}
    outside: Counter = Counter()
    for found in names(0):
        outside.update(found & likely)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    z = {}
    for n in likely:
        a, b = inside[n] / n1, outside[n] / n0
        both = (inside[n] + outside[n]) / (n1 + n0)
        z[n] = (a - b) / np.sqrt(max(both * (1 - both) * (1 / n1 + 1 / n0), 1e-12))
    best = sorted(n for n in z if z[n] >= LEAST_Z)
    return {n: i for i, n in enumerate(best)}, {n: (inside[n] / n1) / (inside[n] / n1 + outside[n] / n0) for n in best}


def fit_model(texts: list[str], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> ToxicModel:
    """stands_for: how many documents of the table each text of label 0 and 1 stands for."""
    y = np.asarray(labels, np.int64)
    weight = np.asarray(stands_for, np.float64)[y]
    weight = weight / weight.mean() if len(y) else weight
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return ToxicModel(blend=np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    features, precision = pick_features(texts, y)
    model = ToxicModel(features, np.zeros(len(features)))
    if features:
        _train_chain(model, texts, y, precision, weight)
    peak, mass = document_evidence(model, texts)
    model.blend = _logistic(np.stack([np.ones(len(y)), peak, mass], 1), y, weight)
    return model


def _train_chain(model: ToxicModel, texts: list[str], y: np.ndarray, precision: dict[str, float], weight: np.ndarray) -> None:
    """Fits weights, bias and switch scores on windows around all tokens that have features.

    Kept are the tokens in reach of a window, one after another, with places that hold none between
    texts; windows are spelled out from them in turn, so memory follows the texts' own size.
    """
    known: dict[str, tuple[list[int], bool]] = {}
    rows, cols, marks, valid = array("q"), array("i"), array("b", bytes(AROUND)), array("b", bytes(AROUND))
    centres, shares = array("q"), array("d")
    for text, toxic, share in zip(texts, y, weight, strict=True):
        tokens = TOKEN.findall(text.lower())
        hits = []
        for w in tokens:
            hit = known.get(w)
            if hit is None:
                ids = [model.features[n] for n in names_of(w) if n in model.features]
                hit = (ids, any(precision[n] >= 0.9 for n in names_of(w) if n in precision)) if ids else NO_FEATURES
                if len(known) < FIT_REMEMBERED:
                    known[w] = hit
            hits.append(hit)
        done = 0
        for i, (ids, _) in enumerate(hits):
            if not ids:
                continue
            done = max(done, i - AROUND)
            # up to i + AROUND all are kept now, and i lies as far before the last one
            for here, mark in hits[done : i + AROUND + 1]:
                rows.extend([len(marks)] * len(here))
                cols.extend(here)
                marks.append(bool(toxic) and mark)
                valid.append(True)
            done = min(i + AROUND + 1, len(hits))
            centres.append(len(marks) - done + i)
            shares.append(share)
        marks.extend(bytes(AROUND))
        valid.extend(bytes(AROUND))
    rows, cols, marks, valid = np.array(rows), np.array(cols), np.array(marks, np.int64), np.array(valid, bool)
    centres, shares = np.array(centres), np.array(shares)
    around = np.arange(-AROUND, AROUND + 1)
    k, n, size = len(centres), len(marks), len(model.features)

    def windows() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Places, whether they hold tokens, weights, and weights of neighbouring tokens."""
        for i in range(0, k, WINDOWS_AT_ONCE):
            at = centres[i : i + WINDOWS_AT_ONCE, None] + around
            ok, share = valid[at], shares[i : i + WINDOWS_AT_ONCE, None]
            yield at, ok, share, (ok[:, 1:] & ok[:, :-1]) * share

    seen = np.zeros((2, 2))
    for at, _, _, both in windows():
        state = marks[at]
        seen += [[(both * ((state[:, :-1] == a) & (state[:, 1:] == b))).sum() for b in (0, 1)] for a in (0, 1)]
    theta = np.zeros(size + 5)
    theta[size] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, TRAIN_STEPS + 1):
        scores = np.bincount(rows, theta[cols], n) + theta[size]
        switch = theta[size + 1 :].reshape(2, 2)
        gaps, expected = np.zeros(n), np.zeros((2, 2))
        for at, ok, share, both in windows():
            p, pairs = _window_marginals(scores[at] * ok, switch)
            expected += (pairs * both[:, :, None, None]).sum((0, 1))
            low, high = at[0, 0], at[-1, -1] + 1
            gaps[low:high] += np.bincount((at - low).ravel(), ((marks[at] - p) * ok * share).ravel(), high - low)
        grad = np.concatenate([np.bincount(cols, gaps[rows], size), [gaps.sum()], (seen - expected).ravel()]) / max(1, shares.sum()) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    model.weights, model.bias, model.switch = theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)


def _window_marginals(emit: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) at each place of equally long windows, and pair marginals (window, place, 2, 2)."""
    n, width = emit.shape
    m = np.exp(switch)
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], 2)
    ahead, back = np.zeros((n, width, 2)), np.ones((n, width, 2))
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        a = (ahead[:, t - 1] @ m) * e[:, t]
        ahead[:, t] = a / a.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        b = (back[:, t + 1] * e[:, t + 1]) @ m.T
        back[:, t] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p = p[:, :, 1] / p.sum(2)
    pairs = ahead[:, :-1, :, None] * m * (e * back)[:, 1:, None, :]
    return p, pairs / pairs.sum((2, 3), keepdims=True)


class PlainRuns:
    """Runs of tokens without features: the matrix of one such token, to any power, scaled."""

    def __init__(self, model: ToxicModel) -> None:
        self.step = np.exp(model.switch)
        self.start = np.array([1.0, np.exp(np.clip(model.bias, -30, 30))])
        (a, b), (c, d) = self.step * self.start
        # power g, over the larger eigenvalue's, is P + ratio**g (1 - P); each term without cancellation
        half, mean = (a - d) / 2, (a + d) / 2
        root = np.sqrt(half**2 + b * c)
        upper, lower = ((half + root), b * c / (root + half)) if half >= 0 else (b * c / (root - half), root - half)
        self.projection = np.array([[upper, b], [c, lower]]) / (2 * root)
        self.ratio = (a * d - b * c) / (mean + root) ** 2

    def power(self, gap: np.ndarray) -> np.ndarray:
        """The matrices over `gap` such tokens each, 0 or more."""
        left = np.power(self.ratio, gap.astype(np.float64))[..., None, None]
        return self.projection * (1 - left) + np.eye(2) * left

    def onward(self, gap: np.ndarray) -> np.ndarray:
        """As power(), with the step to the token after the run."""
        return self.power(gap) @ (self.step / self.step.sum())


def marginals(model: ToxicModel, sequences: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """P(toxic) of the tokens with features. Each sequence: their places, emissions, and all tokens' count.

    Sequences of like length run together.
    """
    runs = PlainRuns(model)
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    order = sorted((i for i in range(len(sequences)) if len(sequences[i][0])), key=lambda i: len(sequences[i][0]))
    i = 0
    while i < len(order):
        longest_here = len(sequences[order[i]][0]) * 5 // 4 + 4
        j = i
        while j < len(order) and len(sequences[order[j]][0]) <= longest_here and (j - i) * longest_here < 2_000_000:
            j += 1
        group = order[i:j]
        lengths = np.array([len(sequences[g][0]) for g in group])
        width, n = int(lengths.max()), len(group)
        e = np.ones((n, width, 2))
        gap = np.zeros((n, width + 1), np.int64)
        for r, g in enumerate(group):
            at, emit, total = sequences[g]
            e[r, : len(at), 1] = np.exp(np.clip(emit + model.bias, -30, 30))
            gap[r, 1 : len(at)] = np.diff(at) - 1
            gap[r, 0], gap[r, len(at)] = at[0], total - 1 - at[-1]
        # the first token has no switch before it: a run before it starts from the plain emissions
        head = np.where((gap[:, 0] > 0)[:, None], np.einsum("a,nab->nb", runs.start, runs.onward(np.maximum(gap[:, 0] - 1, 0))), 1.0)
        ahead, back = np.zeros((n, width, 2)), np.ones((n, width, 2))
        a = head * e[:, 0]
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, width):
            a = np.einsum("na,nab->nb", ahead[:, t - 1], runs.onward(gap[:, t])) * e[:, t]
            ahead[:, t] = a / a.sum(1, keepdims=True)
        rows = np.arange(n)
        tail_gap = gap[rows, lengths]
        # after the last one: a run of plain tokens, with nothing behind it
        tail = np.where((tail_gap > 0)[:, None], np.einsum("nab,b->na", runs.power(np.maximum(tail_gap - 1, 0)), runs.step @ runs.start), 1.0)
        for t in range(width - 1, -1, -1):
            last = lengths - 1 == t
            if t + 1 < width:
                b = np.einsum("nab,nb->na", runs.onward(gap[:, t + 1]), back[:, t + 1] * e[:, t + 1])
            else:
                b = np.ones((n, 2))
            b = np.where(last[:, None], tail, b)
            back[:, t] = b / b.sum(1, keepdims=True)
        p = ahead * back
        p = p[:, :, 1] / p.sum(2)
        for r, g in enumerate(group):
            out[g] = p[r, : lengths[r]]
        i = j
    return out


def active(text: str, emissions: Emissions) -> tuple[np.ndarray, np.ndarray, int]:
    scores = np.fromiter(map(emissions.__getitem__, TOKEN.findall(text.lower())), np.float64)
    at = np.flatnonzero(scores)
    return at, scores[at], len(scores)


def document_evidence(model: ToxicModel, texts: list[str], emissions: Emissions | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each text's greatest marginal, and the log of 1 plus the marginals' sum."""
    emissions = Emissions(model) if emissions is None else emissions
    found = marginals(model, [active(t, emissions) for t in texts]) if model.features else [np.zeros(0)] * len(texts)
    peak = np.array([p.max(initial=1e-6) for p in found])
    peak = np.clip(peak, 1e-6, 1 - 1e-6)
    return np.log(peak / (1 - peak)), np.log1p([p.sum() for p in found])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def spans(model: ToxicModel, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, stop, marginal) of runs of tokens that are toxic likelier than `least`, in characters."""
    lowered = text.lower()
    if len(lowered) != len(text):  # lowering may change lengths; then character by character
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at, emit, total = active(lowered, Emissions(model))
    if not len(at):
        return []
    p = marginals(model, [(at, emit, total)])[0]
    places = [m.span() for m in TOKEN.finditer(lowered)]
    out: list[tuple[int, int, float]] = []
    before = -2
    for i, q in zip(at.tolist(), p.tolist(), strict=True):
        if q > least:
            a, b = places[i]
            if out and i == before + 1:
                out[-1] = (out[-1][0], b, max(out[-1][2], q))
            else:
                out.append((a, b, q))
            before = i
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicModel:
    """A model of `label` from at most `sample` labelled documents of each kind, whole texts, weighted to the rates of all labels."""
    permitted = permitted_labels(labels.where(F.col(label).isin(0, 1)), label, id_col)
    one, other = (permitted.where(F.col("y") == y).orderBy(F.xxhash64("train_id"), "train_id").limit(sample) for y in (1, 0))
    chosen = F.broadcast(one.unionByName(other))  # twice `sample` rows of two numbers at most
    known = docs.select(F.col(id_col).alias("train_id"), F.col(text_col).cast("string").alias("train_text")).join(chosen, "train_id")
    # by another hash than the one that chose the ids, which would put the label with more ids first;
    # nothing is cut unless ids repeat, and then by the texts' hash, whatever they hold
    rows = known.orderBy(F.xxhash64("train_id", "train_text", F.lit("order")), "train_id", "train_text").limit(2 * sample).collect()
    counts = {r["y"]: r["count"] for r in permitted.groupBy("y").count().collect()}
    stands_for = [max(1.0, counts.get(y, 0) / sample) for y in (0, 1)]
    return fit_model([r["train_text"] or "" for r in rows], [r["y"] for r in rows], (stands_for[0], stands_for[1]))


def _scored(docs: DataFrame, model: ToxicModel, columns: list[str], text_col: str) -> DataFrame:
    """`columns` of docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the features of 2 * SAMPLE documents at most
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))
    schema = rows.drop("__text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emissions = Emissions(model)

        def scores(texts: list[str]) -> list[float]:
            peak, mass = document_evidence(model, texts, emissions)
            z = model.blend[0] + model.blend[1] * peak + model.blend[2] * mass
            return (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()

        for b in batches:
            out: list[float] = []
            texts, chars = [], 0
            for x in b.column(b.num_columns - 1):
                texts.append(x.as_py() or "")
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    out += scores(texts)
                    texts, chars = [], 0
            if texts:
                out += scores(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)


def score_rows(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")), model, ["doc_id"], "body")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (start, stop, marginal), of documents that have any."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "stop": e, "marginal": p} for s, e, p in spans(shared.value, x.as_py() or "")] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    ddl = "doc_id bigint, spans array<struct<start:bigint,stop:bigint,marginal:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, ddl).where("size(spans) > 0")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not toxic, with their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col(text_col).alias("body"))
    return _scored(whole, model, ["whole"], "body").where(F.col("score") < threshold).select("whole.*")
