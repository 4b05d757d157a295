"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its whole text.  The weights are learned from pairs
of a preferred and a rejected document, by logistic loss on the difference of their features.  The
decision is a quantile of the strengths of all labelled documents: the share of rejected ones among them.
Strengths are then mapped to 0..1 so that this quantile lies at the wanted threshold.

The weights are learned from at most TRAIN_TEXTS labelled documents of each label, in PAIRS pairs.  The cut is
taken from all labelled documents, and scores are those of all rows, from whole texts.

Defined cases: a null text counts as empty, and an empty text has a score like any other.  Labels other
than 0 and 1, null labels and labels of unknown documents are not looked at.  Ids may repeat: the weights are learned
from the smallest text of an id, an id labelled both ways counts as both, and each row is scored by its own
text.  Of equal strengths none is told apart.  If only one label occurs, every score is 1 or 0 as that label says;
without labels every score is 0.5.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomscope.llm.common import bounded_batches, staged

TRAIN_TEXTS, PAIRS = 3000, 40_000
THRESHOLD = 0.3
#: Marks counted one by one.
MARKS = ".,;:!?|#$%&*=<>{}[]()/\\_-+@\"'"


@functools.cache
def _classes() -> np.ndarray:
    """0 upper case, 1 other letter, 2 number, 3 white space, 4 mark, 5 other; what lies beyond U+3000 counts as letter."""
    out = np.full(0x3001, 1, np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        if chr(c).isspace():
            out[c] = 3
        elif kind in ("Lu", "Lt"):
            out[c] = 0
        else:
            out[c] = {"L": 1, "M": 1, "N": 2, "P": 4, "S": 4}.get(kind[0], 5)
    return out


def features(text: str | None) -> np.ndarray:
    text = text or ""
    n = len(text)
    words = text.split()
    m = len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(_classes()[np.minimum(codes, 0x3000)], minlength=6) / max(n, 1)
    bare = [w.rstrip(".,;:?!") for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, bare))
    parts = [
        *share,
        *(text.count(c) / max(m, 1) for c in MARKS),
        sum(map(eq, words, words[1:])) / max(m - 1, 1),
        1 - len(set(words)) / max(m, 1),
        1 - len(set(zip(words, words[1:]))) / max(m - 1, 1),
        1 - letters / max(m, 1),
        sum(map(str.isupper, words)) / max(m, 1),
        sum(map(str.istitle, words)) / max(m, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        text.count("!!") / max(m, 1),
    ]
    rates = np.minimum(np.array(parts), 2.0)
    sizes = np.array([math.log1p(n), math.log1p(m), math.log1p(n / max(m, 1)), math.log1p(m / max(len(lines), 1)), float(m == 0)])
    return np.concatenate([rates, np.sqrt(rates), sizes, (sizes / 5) ** 2])


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights


def fit(x: np.ndarray, label: np.ndarray, share: float, seed: int = 11) -> Ranking:
    """`share`: of label 0 among all labelled documents."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    width = x.shape[1] if len(x) else len(features(""))
    zero, one = np.zeros(width), np.ones(width)
    if not len(good) or not len(bad):
        return Ranking(zero, one, zero, 0.0, 1.0, 0.5 if not len(x) else float(len(good) > 0))
    weight = np.where(label == 1, (1 - share) / len(good), share / len(bad))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    preferred, rejected = good[rng.integers(0, len(good), PAIRS)], bad[rng.integers(0, len(bad), PAIRS)]
    w, first, second = zero.copy(), zero.copy(), zero.copy()
    for step in range(1, 401):
        pick = rng.integers(0, PAIRS, 4096)
        d = z[preferred[pick]] - z[rejected[pick]]
        g = -((1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None] * d).mean(0) + 1e-3 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    s = z @ w
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order])
    k = min(int(np.searchsorted(below, share)), len(s) - 2)
    cut = (s[order][k] + s[order][k + 1]) / 2
    # One slope, by Newton steps of a logistic fit through the cut.
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * (s - cut), -30, 30)))
        grad = (weight * (label - p) * (s - cut)).sum() - 1e-4 * slope
        bend = (weight * p * (1 - p) * (s - cut) ** 2).sum() + 1e-4
        slope = min(max(slope + grad / bend, 0.05), 20.0)
    return Ranking(mean, scale, w, float(cut), float(slope))


def _feature_array(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([features(t) for t in series])

    return run(text)


def strength(text: Column, model: Ranking) -> Column:
    broadcast_model = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            found = [broadcast_model.value.strengths(features(t)[None])[0] for t in series]
            yield pd.Series(found, dtype=float)

    return run(text)


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL").distinct()


def weighed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Weights learned from a bounded sample: at most 2 * TRAIN_TEXTS ids, and one text of each."""
    bounded_batches(docs.sparkSession)
    rows = _labels(labels, id_col, label_col).withColumn("draw", F.xxhash64("id", F.lit("sample")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for label in sorted(counts):
        part = rows.filter(F.col("label") == label).orderBy("draw", "id").limit(TRAIN_TEXTS)
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return fit(np.empty((0, len(features("")))), np.empty(0), 0.5)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    got = sorted((r["id"], r["label"], r["x"]) for r in found.select("id", "label", _feature_array(F.col("text")).alias("x")).collect())
    x = np.array([r[2] for r in got], float).reshape(len(got), len(features("")))
    share = counts.get(0, 0) / max(1, sum(counts.values()))
    return fit(x, np.array([r[1] for r in got]), share)


def cut_at_share(model: Ranking, strengths: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ranking:
    """The model with its cut at the quantile of all labelled rows' strengths; `strengths` has doc_id, strength."""
    if model.constant is not None:
        return model
    both = strengths.join(_labels(labels, id_col, label_col), F.col("doc_id") == F.col("id"))
    share = both.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    if share is None:
        return model
    cut = both.agg(F.percentile_approx("strength", share, 10_000)).first()[0]
    return replace(model, cut=float(cut))


def strengths(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and strength of every row, written once."""
    return staged(docs.select(F.col(id_col).alias("doc_id"), strength(F.col(text_col).cast("string"), model).alias("strength")), "strengths")


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """A model of a few numbers per feature."""
    model = weighed(docs, labels, id_col, text_col, label_col)
    if model.constant is not None:
        return model
    return cut_at_share(model, strengths(docs, model, id_col, text_col), labels, id_col, label_col)


def scored(strength_col: Column, model: Ranking) -> Column:
    """Score from strength."""
    if model.constant is not None:
        return F.lit(model.constant)
    shift = math.log(THRESHOLD / (1 - THRESHOLD))
    x = F.lit(model.slope) * (strength_col - F.lit(model.cut)) + F.lit(shift)
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def score(text: Column, model: Ranking) -> Column:
    return scored(strength(text, model), model)


def classify(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col).cast("string"), model).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learn_and_classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """As `classify` with `fitted`, but every text is weighed once."""
    model = weighed(docs, labels, id_col, text_col, label_col)
    rows = strengths(docs, model, id_col, text_col)
    model = cut_at_share(model, rows, labels, id_col, label_col)
    rows = rows.select("doc_id", scored(F.col("strength"), model).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
