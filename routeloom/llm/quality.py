"""Quality classifier by positive-unlabelled learning.

A linear logistic model over style features of the whole text, fitted to trusted positives and to all documents as
unlabelled text by the non-negative risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss. E_u is over every document: each Newton step is one Spark aggregation of a gradient and a
Hessian. The class prior is estimated by the best-bin rule: the ratio of unlabelled to positive mass above the score at
which that ratio's upper confidence bound is least. Negative labels are not used.

Features that vary by chance in short texts are drawn towards the table's typical values: with n words, a text keeps
n / (n + SHRINK) of its deviation. Typical values are means over all documents, weighted by that same share.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, saved, table, unused

#: Labelled positives used to fit, at most (those with the least hash of their id); unlabelled rows have no bound.
POSITIVES = 20_000
FEATURES = (
    "length", "word_length", "distinct_words", "top_word", "repeats", "short_words", "symbol_ends", "symbols", "digits", "upper",
    "commas", "stops", "bangs", "pipes", "line_words", "repeated_lines", "non_ascii", "shout_words", "bigrams", "compressed",
)
#: Features of junk: their square roots are used, and their squares too.
RARE = {"repeats", "symbol_ends", "symbols", "digits", "bangs", "pipes", "shout_words", "repeated_lines"}
CHANCE = {"word_length", "distinct_words", "top_word", "short_words", "commas", "stops", "line_words", "non_ascii", "compressed", "upper", "bigrams"}
#: Words at which a text counts half of its own and half of the typical values of CHANCE.
SHRINK = 25
_CHANCE = [i for i, f in enumerate(FEATURES) if f in CHANCE]
_SQUARED = [i for i, f in enumerate(FEATURES) if f in RARE]
_SYMBOLS = b"#$%&*|@^~<>{}[]=+_\\/"
_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text: str) -> list[float]:
    """FEATURES of a whole text: shares of its words or bytes, square roots of those that clean text has next to none of.
    The first is n / (n + SHRINK) for n words. An empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    size = len(raw)
    count = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(1 for w in counts if len(w) > 1 and not (w[-1].isalnum() or w[-2].isalnum()))
    shout = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    packed = sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, size, 65536))
    values = [
        n / (n + SHRINK), (len(text) - n + 1) / n, len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(c for w, c in counts.items() if len(w) <= 3) / n,
        ends / len(counts), count(_SYMBOLS), count(_DIGITS), count(_UPPER), count(b","), count(b"."), count(b"!?"), count(b"|"),
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), 1 - len(text) / size, shout / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1), packed / size,
    ]
    return [v**0.5 if f in RARE else v for f, v in zip(FEATURES, values)]


def feature_column(text_col: str) -> Column:
    @F.pandas_udf("array<float>")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return f(F.coalesce(F.col(text_col), F.lit("")))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, len(FEATURES)).astype(np.float64)


def _summed(x: DataFrame, fn, size: int) -> np.ndarray:
    """Sum over all feature rows of fn(matrix) -> vector of a fixed size; Spark adds up one vector a task, by position."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(_matrix(b.column(0)))
        yield pa.RecordBatch.from_pydict({"k": np.arange(size, dtype=np.int32), "v": total})

    out = np.zeros(size)
    for r in x.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


class Scale:
    """Typical values, means and deviations of the features, and the design matrix [1, z, z^2 - 1 of RARE] by them."""

    def __init__(self, typical: np.ndarray, mean: np.ndarray, sd: np.ndarray):
        self.typical, self.mean, self.sd = typical, mean, sd

    @classmethod
    def of(cls, x: DataFrame) -> Scale | None:
        """From all feature rows, in one aggregation: moments of drawn-in values follow from those of near^i * value^j."""
        k = len(FEATURES)

        def sums(m):
            near = m[:, :1]
            return np.concatenate([[len(m)], near.sum(0), (near**2).sum(0), *((near**i * m**j).sum(0) for i, j in ((1, 1), (2, 1), (2, 2), (0, 1), (0, 2)))])

        v = _summed(x, sums, 3 + 5 * k)
        if not v[0]:
            return None
        n, near, near2 = v[0], v[1] / v[0], v[2] / v[0]
        a, b, c, d, e = (v[3 + i * k : 3 + (i + 1) * k] / n for i in range(5))
        typical = a / max(near, 1e-12)
        mean, square = d.copy(), e.copy()
        t = typical[_CHANCE]
        mean[_CHANCE] = t + (a[_CHANCE] - near * t)
        square[_CHANCE] = t**2 + 2 * t * (a[_CHANCE] - near * t) + (c[_CHANCE] - 2 * t * b[_CHANCE] + near2 * t**2)
        return cls(typical, mean, np.sqrt(np.maximum(square - mean**2, 1e-8)))

    def design(self, m: np.ndarray) -> np.ndarray:
        drawn = m.copy()
        drawn[:, _CHANCE] = self.typical[_CHANCE] + m[:, :1] * (m[:, _CHANCE] - self.typical[_CHANCE])
        z = np.clip((drawn - self.mean) / self.sd, -6, 6)
        return np.concatenate([np.ones((len(m), 1)), z, z[:, _SQUARED] ** 2 - 1], axis=1)


def _loss(g):
    return np.logaddexp(0, -g)


def _sigmoid(g):
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


class Model:
    """Weights over a scale's design, and the class prior they were fitted with."""

    def __init__(self, scale: Scale, weights: np.ndarray, prior: float):
        self.scale, self.weights, self.prior = scale, weights, prior

    def score(self, m: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale.design(m) @ self.weights)


def evaluate(x: DataFrame, positives: np.ndarray, scale: Scale, prior: float, w: np.ndarray, ridge: float) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """(negative part, risk, gradients of the positive and of the negative part, Hessian) at weights w; the risk includes
    ridge * |w|^2 / 2 without the first weight, the gradients and the Hessian don't."""
    d, xp = len(w), scale.design(positives)

    def sums(m):
        a = scale.design(m)
        s = _sigmoid(a @ w)
        return np.concatenate([[len(a), _loss(-(a @ w)).sum()], a.T @ s, ((a * (s * (1 - s))[:, None]).T @ a).ravel()])

    v = _summed(x, sums, 2 + d + d * d)
    n, gp = v[0], xp @ w
    sp = _sigmoid(gp)
    negative = v[1] / n - prior * _loss(-gp).mean()
    risk = prior * _loss(gp).mean() + max(0.0, negative) + ridge * (w[1:] ** 2).sum() / 2
    return negative, risk, -prior * (xp * (1 - sp)[:, None]).mean(0), v[2 : 2 + d] / n - prior * (xp * sp[:, None]).mean(0), v[2 + d :].reshape(d, d) / n


def minimise(x: DataFrame, positives: np.ndarray, scale: Scale, prior: float, steps: int, ridge: float) -> np.ndarray:
    """Newton steps from zero, up to the given number or until the risk falls no more; the weights of the least risk met."""
    w = np.zeros(1 + len(FEATURES) + len(_SQUARED))
    own = np.append(0.0, np.full(len(w) - 1, ridge))
    best, least = w, np.inf
    for _ in range(steps):
        negative, risk, grad_p, grad_n, hess = evaluate(x, positives, scale, prior, w, ridge)
        if risk < least - 1e-7:
            best, least = w, risk
        elif np.isfinite(least):
            break
        if negative < 0:  # the part that can't be below 0 is: climb back out of it, as the non-negative risk asks
            w = w + 0.5 * grad_n / max(np.linalg.norm(grad_n), 1e-12)
            continue
        w = w - np.linalg.solve(hess + np.diag(own) + 1e-6 * np.eye(len(w)), grad_p + grad_n + own * w)
    return best


def best_bin(unlabelled: np.ndarray, positive: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Class prior from two histograms over rising scores: the ratio of the shares above a score, taken where the ratio
    and (1 + gamma) times its deviation bound at confidence 1 - delta are least together."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    u, p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    ok = p > 0
    ratio = np.where(ok, u / np.where(ok, p, 1), np.inf)
    bound = np.where(ok, ratio + (1 + gamma) * slack / np.where(ok, p, 1), np.inf)
    return float(np.clip(ratio[int(bound.argmin())], 0.05, 0.95))


def estimate_prior(x: DataFrame, positives: np.ndarray, model: Model, bins: int = 400) -> float:
    """best_bin over the scores of all documents and of the trusted positives."""
    edges = np.linspace(0, 1, bins + 1)
    every = _summed(x, lambda m: np.histogram(model.score(m), edges)[0].astype(float), bins)
    return best_bin(every, np.histogram(model.score(positives), edges)[0].astype(float))


def fit(x: DataFrame, positives: np.ndarray, steps: int = 10, ridge: float = 0.01) -> Model | None:
    """Model from the feature rows of all documents (column x) and a matrix of trusted positives; None without either."""
    scale = Scale.of(x)
    if scale is None or not len(positives):
        return None
    first = minimise(x, positives, scale, 0.5, 5, ridge)
    prior = estimate_prior(x, positives, Model(scale, first, 0.5))
    return Model(scale, minimise(x, positives, scale, prior, steps, ridge), prior)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", x_col: str = "x", positives: int = POSITIVES) -> Model | None:
    """Model from a table with a feature row for each document. Labels: rows (doc_id, quality) outside the held-out
    fifth; null labels and labels of absent documents count for nothing, and an id with both labels isn't trusted."""
    rows = x.select(F.col(id_col).alias("id"), F.col(x_col).alias("x"))
    trusted = labels.select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality is not null")
    trusted = trusted.where(~held_out("id")).groupBy("id").agg(F.min("quality").alias("q")).where("q = 1")
    bound = trusted.join(rows, "id").orderBy(F.xxhash64("id"), "id").limit(positives).select("x")
    got = np.array([r.x for r in bound.collect()], np.float64).reshape(-1, len(FEATURES))
    return fit(rows.select("x"), got)


def score_column(x_col: str, model: Model | None) -> Column:
    """Score 0..1; without a model (no documents or no trusted positives) 0.5."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return score(F.col(x_col))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with its columns, that score at least the threshold. Features are computed once and kept beside
    the rows, in a column whose name docs doesn't have; repeated rows share their fate."""
    bounded_batches(docs.sparkSession)
    x = unused(docs.columns, "features")
    rows = saved(docs.select("*", feature_column(text_col).alias(x)), "scored")
    model = train(rows, labels, id_col, x)
    return rows.where(score_column(x, model) >= threshold).select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", feature_column("text").alias("x"))
    x = saved(docs, "features")
    model = train(x, table(spark, sf_dir, "labels"))
    s = x.select("doc_id", held_out("doc_id").alias("held_out"), score_column("x", model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
