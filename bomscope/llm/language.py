"""Language identification by a linear-chain conditional random field over the words of a text.

Each word's label scores are sums of learned weights of its features (the word itself as lexicon entry,
its beginnings and ends, its character n-grams), hashed into a table of fixed size; learned
transitions join neighbouring words.  Forward-backward gives each word's label probabilities; their
mean over a text is the text's.

Training reads at most TRAIN_TEXTS texts of each label, and of each the whole text or, if it is longer, TRAIN_RUNS
runs of RUN_CHARS characters that lie evenly over it from its beginning to its end.
Runs of words from texts of different labels are strung together, so that the transitions see changes of
language inside a sequence.  Prediction reads whole texts, in slices of bounded size.

Defined cases: a null text or one without a letter is `und` with score 0; a word with any letter counts, so `m²` does.
A run of more than 32 letters counts as several words.  Ids may repeat or be null: each row is predicted by
its own text, and rows that repeat an id are drawn or left together.  Without any labelled text every text is `und`.
Extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomscope.llm.common import bounded_batches

UNKNOWN = "und"
TRAIN_TEXTS, TRAIN_RUNS, RUN_CHARS = 400, 12, 128
BUCKETS = 1 << 16
WORD = re.compile(r"[^\W\d_]{1,32}")
#: Characters that are worked on at once.
CHUNK = 1_000_000
PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    # Number signs such as a superscript two pass the pattern but are no letters.
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(words: np.ndarray) -> np.ndarray:
    """Feature numbers of each word, a row each; BUCKETS stands for none."""
    n = len(words)
    codes = np.zeros((n, 34), np.uint64)
    wide = words.astype("U32").view(np.uint32).reshape(n, 32)
    codes[:, 1:33] = wide
    length = (wide != 0).sum(1)
    codes[:, 0] = 1  # word start
    codes[np.arange(n), length + 1] = 2  # word end
    mix = np.uint64(0x9E3779B97F4A7C15)

    def hashed(value: np.ndarray, kind: int) -> np.ndarray:
        h = (value + np.uint64(kind)) * mix
        return ((h ^ (h >> np.uint64(29))) * mix >> np.uint64(48)).astype(np.int64) % BUCKETS

    longest = int(length.max()) + 2 if n else 2
    out = []
    whole = np.zeros(n, np.uint64)
    for i in range(longest):
        whole = whole * mix + codes[:, i]
        if i in (1, 2, 3):  # beginnings of one to three letters
            out.append(np.where(length >= i, hashed(whole, i), BUCKETS))
    out.append(hashed(whole, 9))
    tail = np.zeros(n, np.uint64)
    for i in range(1, 5):  # ends of one to four letters
        tail = tail * mix + codes[np.arange(n), np.maximum(length + 1 - i, 0)]
        out.append(np.where(length >= i, hashed(tail, 10 + i), BUCKETS))
    for size in (2, 3):
        for i in range(longest - size + 1):
            gram = np.zeros(n, np.uint64)
            for k in range(size):
                gram = gram * mix + codes[:, i + k]
            out.append(np.where(i + size <= length + 2, hashed(gram, 20 + size), BUCKETS))
    return np.stack(out, 1)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS + 1, labels); the last row is zero
    transitions: np.ndarray  # (labels, labels)

    def emissions(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for start in range(0, len(words), 20_000):
            part = features(words[start : start + 20_000])
            for column in part.T:
                out[start : start + 20_000] += self.weights[column]
        return out


def _exp(a: np.ndarray) -> np.ndarray:
    return np.exp(a - a.max(-1, keepdims=True))


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; sequences lie one behind the other, all worked on side by side."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    psi, move = _exp(emissions.astype(np.float64)), np.exp(transitions - transitions.max())
    alpha = np.empty_like(psi)
    state = None
    for t, n in enumerate(active):
        at = starts[:n] + t
        state = psi[at] if state is None else (state[:n] @ move) * psi[at]
        state /= state.sum(1, keepdims=True)
        alpha[at] = state
    beta = np.ones((len(starts), psi.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        alpha[at] *= beta[:n]
        beta[:n] = (beta[:n] * psi[at]) @ move.T
        beta[:n] /= beta[:n].sum(1, keepdims=True)
    return alpha / alpha.sum(1, keepdims=True)


def _gradient(emissions: np.ndarray, gold: np.ndarray, transitions: np.ndarray):
    """Loss gradients of equally long sequences: emissions (B, T, L), gold (B, T)."""
    b, t, n = emissions.shape
    psi, move = _exp(emissions), np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    for i in range(t):
        a = psi[:, i] * (alpha[:, i - 1] @ move if i else 1.0)
        alpha[:, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (beta[:, i + 1] * psi[:, i + 1]) @ move.T
        beta[:, i] = x / x.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    d_trans = np.zeros((n, n))
    for i in range(1, t):
        pair = alpha[:, i - 1, :, None] * move * (beta[:, i] * psi[:, i])[:, None, :]
        d_trans += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    np.subtract.at(d_trans, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    gamma[np.arange(b)[:, None], np.arange(t), gold] -= 1
    return gamma, d_trans


def fit(samples: list[tuple[str, str]], epochs: int = 4, seed: int = 7) -> Model:
    """A model from (label, text) pairs, by gradient steps on the sequences' conditional log-likelihood."""
    labels = sorted({label for label, _ in samples})
    n = len(labels)
    model = Model(labels, np.zeros((BUCKETS + 1, n), np.float32), np.zeros((n, n)))
    if n < 2:
        return model
    rng = np.random.default_rng(seed)
    runs: list[list[tuple[str, int]]] = []
    for label, text in sorted(samples):
        k, found = labels.index(label), words_of(text)
        for start in range(0, len(found), 16):
            runs.append([(w, k) for w in found[start : start + 16]])
    rng.shuffle(runs)  # neighbouring runs then change their language
    chain = [pair for run in runs for pair in run]
    span = 32
    count = len(chain) // span
    if not count:
        span, count = len(chain), 1
    vocab, codes = np.unique(np.array([w for w, _ in chain], "U32"), return_inverse=True)
    table = features(vocab)
    codes = codes[: count * span].reshape(count, span)
    gold = np.array([k for _, k in chain])[: count * span].reshape(count, span)
    scale = np.full((BUCKETS + 1, n), 1e-6, np.float32)
    trans_scale = np.full((n, n), 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(count), max(1, count // 64)):
            used = table[codes[part]]
            scores = model.weights[used].sum(2, dtype=np.float64)
            d_scores, d_trans = _gradient(scores, gold[part], model.transitions)
            flat = used.reshape(-1, used.shape[2])
            step = np.stack(
                [np.bincount(flat.ravel(), np.repeat(d_scores[..., k].ravel(), flat.shape[1]), BUCKETS + 1) for k in range(n)], 1
            ).astype(np.float32) / len(part)
            step += 1e-5 * model.weights
            scale += step * step
            model.weights -= 0.05 * step / np.sqrt(scale)
            model.weights[BUCKETS] = 0
            d_trans /= len(part)
            trans_scale += d_trans * d_trans
            model.transitions -= 0.05 * d_trans / np.sqrt(trans_scale)
    return model


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = np.flatnonzero(lengths)
    if not len(some) or not model.labels:
        return langs, scores
    codes, vocab = pd.factorize(np.array([w for k in some for w in split[k]], dtype=object))
    probs = marginals(model.emissions(np.array(vocab, "U32"))[codes], lengths[some], model.transitions)
    ends = np.cumsum(lengths[some])
    mean = np.add.reduceat(probs, ends - lengths[some], axis=0) / lengths[some][:, None]
    best = mean.argmax(1)
    for row, k in enumerate(some):
        langs[k] = model.labels[best[row]]
    scores[some] = np.clip(mean.max(1), 0.0, 1.0)
    return langs, scores


def evenly(text: Column, runs: int, chars: int) -> Column:
    """The text, or if it is longer than the runs: so many runs from all over it, less the words that they cut."""
    size = F.length(text)
    last = F.lit(max(runs - 1, 1))
    run = lambda k: F.substring(text, (F.floor((size - chars) * k / last) + 1).cast("int"), F.lit(chars))
    whole = lambda k: F.regexp_replace(run(k), "^\\S*\\s+|\\s+\\S*$", "")
    drawn = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), whole), " ")
    return F.when(size <= runs * chars, text).otherwise(drawn)


def training_sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most TRAIN_TEXTS texts of each label, drawn by the hash of their id."""
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col), F.lit("sample")).alias("draw"),
    ).dropna(subset=["lang", "text"])
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for lang in sorted(counts):
        # A share that is expected to hold twice the bound leaves the sort below little to do.
        share = min(1.0, 2.0 * TRAIN_TEXTS / counts[lang])
        edge = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        drawn = rows.filter((F.col("lang") == lang) & (F.col("draw") <= min(edge, 2**63 - 1)))
        drawn = drawn.select("draw", evenly(F.col("text"), TRAIN_RUNS, RUN_CHARS).alias("text")).orderBy("draw", "text").limit(TRAIN_TEXTS)
        out += [(lang, r["text"]) for r in drawn.collect()]
    return out


def predicted(text: Column, broadcast_model) -> Column:
    """struct<lang, score> of a text."""

    @F.pandas_udf(PREDICTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = broadcast_model.value
        for series in batches:
            texts = series.tolist()
            # Texts of like length are worked on together: a chunk takes as many steps as its longest.
            order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            part: list[int] = []
            size = 0
            for place, k in enumerate(order):
                part.append(k)
                size += len(texts[k] or "")
                if size >= CHUNK or place == len(order) - 1:
                    found, score = predict(model, [texts[i] for i in part])
                    for i, lang, s in zip(part, found, score):
                        langs[i], scores[i] = lang, s
                    part, size = [], 0
            yield pd.DataFrame({"lang": langs, "score": scores})

    return run(text)


def fitted(labelled: DataFrame, **columns: str):
    """A broadcast model: BUCKETS rows of one weight per label, whatever the size of the data."""
    bounded_batches(labelled.sparkSession)
    return labelled.sparkSession.sparkContext.broadcast(fit(training_sample(labelled, **columns)))


def least_score(held_out: DataFrame, model, text_col: str = "text", lang_col: str = "lang") -> float:
    """Score below which a text is in none of the model's languages.

    It lies midway between an even share, 1 / labels, and what all but a hundredth of the rightly recognised
    held-out texts reach, so it bites alike for any number of labels.  With one label, or without
    recognised held-out texts, scores tell nothing and it is 0.
    """
    labels = len(model.value.labels)
    if labels < 2:
        return 0.0
    rows = held_out.select(F.col(lang_col).cast("string").alias("lang"), predicted(F.col(text_col).cast("string"), model).alias("p"))
    reached = rows.filter("p.lang = lang").agg(F.percentile_approx("p.score", 0.01, 10_000)).first()[0]
    return 0.0 if reached is None else (1 / labels + reached) / 2


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), predicted(F.col(text_col).cast("string"), model).alias("p"))
    return rows.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
