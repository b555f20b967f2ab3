"""Quality by a sparse rule ensemble.

Text statistics are built-in column expressions. On a bounded sample of labelled rows, shallow
boosted trees are grown; every path from a root to a node becomes a rule (a conjunction of
thresholds); a lasso logistic regression weighs the rules and drops most; the rest are compiled
into one Spark column expression, so scoring runs without Python.

Bounds: SAMPLE labelled rows at most teach the model (twice as many where ids repeat), chosen by
hash; every rule that the lasso keeps is used.

Defined results: null text counts as empty and gets a score; labels that are null, or of ids
without a text, are ignored, and of labels that repeat an id the largest counts; without labels
of both kinds the score is the share of label 1 (one half if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import held_out

#: Labelled rows that a model is fitted on at most: those with the least hash of their id.
SAMPLE = 20_000
TREES, DEPTH, CUTS, SHRINK = 30, 3, 24, 0.3
LASSO, LASSO_STEPS = 0.002, 400
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """name -> expression over one text; two steps, since words and lines serve several."""
    t = F.coalesce(text, F.lit(""))
    return {
        "chars": F.length(t).cast("double"),
        "word_list": F.regexp_extract_all(t, F.lit(r"(\S+)"), F.lit(1)),
        "line_list": F.split(t, "\n"),
        "upper": F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("double"),
        "symbols": F.length(F.regexp_replace(t, r"[^#$%&*|!@<>{}\[\]_=+~^\\/]+", "")).cast("double"),
        "digits": F.length(F.regexp_replace(t, "[^0-9]+", "")).cast("double"),
        "stops": F.length(F.regexp_replace(t, "[^.,;:?]+", "")).cast("double"),
    }


def features() -> dict[str, Column]:
    """name -> expression over the columns of statistics()."""
    n = F.greatest(F.size("word_list"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("chars"), F.lit(1.0))
    lines = F.greatest(F.size("line_list"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.size("word_list")),
        "word_length": F.col("chars") / n,
        "upper_share": F.col("upper") / chars,
        "symbols_per_word": F.col("symbols") / n,
        "digits_per_word": F.col("digits") / n,
        "stops_per_word": F.col("stops") / n,
        "distinct_words": F.size(F.array_distinct("word_list")) / n,
        "distinct_lines": F.size(F.array_distinct("line_list")) / lines,
        "words_per_line": n / lines,
    }


NAMES = ["log_words", "word_length", "upper_share", "symbols_per_word", "digits_per_word", "stops_per_word", "distinct_words", "distinct_lines", "words_per_line"]


def with_features(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with a column of each of NAMES."""
    kept = docs.columns
    return docs.select(*kept, *[c.alias(k) for k, c in statistics(text).items()]).select(*kept, *[c.alias(k) for k, c in features().items()])


@dataclass(frozen=True)
class RuleModel:
    bias: float
    #: (weight, ((feature index, is_above, threshold), ...))
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, terms in self.rules:
            z += w * holds(x, terms)
        return 1 / (1 + np.exp(-z))


def holds(x: np.ndarray, terms: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    return reduce(np.logical_and, [x[:, f] > c if above else x[:, f] <= c for f, above, c in terms])


def tree_paths(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
    """Paths to the nodes of one regression tree on first and second derivatives; and its output."""
    paths, out = [], np.zeros(len(x))

    def grow(rows: np.ndarray, terms: tuple) -> None:
        if terms:
            paths.append(terms)
        g, h = slope[rows].sum(), bend[rows].sum()
        best = (1e-3, None)
        if len(terms) < DEPTH and len(rows) >= 20:
            for f, marks in enumerate(cuts):
                if not len(marks):
                    continue
                place = np.searchsorted(marks, x[rows, f], "left")
                gl = np.cumsum(np.bincount(place, slope[rows], len(marks) + 1))[:-1]
                hl = np.cumsum(np.bincount(place, bend[rows], len(marks) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(marks[k])))
        if best[1] is None:
            out[rows] = g / (h + 1)
            return
        f, mark = best[1]
        above = x[rows, f] > mark
        grow(rows[~above], (*terms, (f, False, mark)))
        grow(rows[above], (*terms, (f, True, mark)))

    grow(np.arange(len(x)), ())
    return paths, out


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weighed by lasso logistic regression (proximal gradient steps)."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleModel(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        paths, out = tree_paths(x, y - p, p * (1 - p), cuts)
        rules.update(dict.fromkeys(paths))
        z += SHRINK * out
    terms = list(rules)
    hits = np.stack([holds(x, t) for t in terms], 1).astype(np.float64)
    centre, scale = hits.mean(0), hits.std(0)
    keep = scale > 1e-6
    terms, hits, centre, scale = [t for t, k in zip(terms, keep, strict=True) if k], hits[:, keep], centre[keep], scale[keep]
    hits = (hits - centre) / scale
    bias, w = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(terms))
    step = 4 * len(y) / np.linalg.norm(hits, 2) ** 2
    old, momentum = w, 1.0
    ahead = w
    for _ in range(LASSO_STEPS):
        error = y - 1 / (1 + np.exp(-(bias + hits @ ahead)))
        bias += 2.0 * error.mean()
        moved = ahead + step * (hits.T @ error) / len(y)
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = w + (momentum - 1) / after * (w - old)
        old, momentum = w, after
    w = w / scale
    bias -= float(w @ centre)
    return RuleModel(bias, tuple((float(w[i]), terms[i]) for i in np.flatnonzero(w)))


def compiled(model: RuleModel) -> Column:
    """The model as an expression over the columns NAMES."""

    def rule(terms) -> Column:
        return reduce(lambda a, b: a & b, [F.col(NAMES[f]) > c if above else F.col(NAMES[f]) <= c for f, above, c in terms])

    z = F.lit(model.bias)
    for w, terms in model.rules:
        z = z + F.when(rule(terms), w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def permitted_labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(train_id, y) of all rows that models may learn from, one row for each id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("train_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def training_labels(labels: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """(train_id, y) of at most `most` rows that models may learn from, chosen by a hash of the id."""
    return permitted_labels(labels, label, id_col).orderBy(F.xxhash64("train_id"), "train_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleModel:
    """A model of `label`, from the statistics of a bounded sample."""
    # `sample` rows of two numbers: a proven bound for the broadcast
    chosen = F.broadcast(training_labels(labels, label, id_col, sample))
    known = docs.select(F.col(id_col).alias("train_id"), F.col(text_col).alias("train_text")).join(chosen, "train_id")
    # repeated ids may give more rows than are kept: their hash has no regard for length or quality
    rows = with_features(known, F.col("train_text")).select("y", *NAMES, F.xxhash64("train_id", "train_text").alias("place"))
    rows = rows.orderBy("place", *NAMES, "y").limit(2 * sample).toPandas().sort_values([*NAMES, "y"])
    return fit_rules(rows[NAMES].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_rows(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")), F.col("body"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
