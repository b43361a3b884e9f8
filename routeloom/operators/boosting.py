"""AdaBoost of decision stumps by histograms.

Features become bins once, and rows with the same bins and label become one pattern with its count. A round is one
aggregation: each task adds up its patterns' weights by feature, bin and label, Spark adds these sums, and the best stump
follows from their prefix sums. Weights follow from the stumps chosen so far, so none are shuffled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators.prefix import unused
from routeloom.sources.scratch import ensure_checkpoints


class Stump(NamedTuple):
    """Says `left` for values up to the threshold (nulls and NaN too), else `right`, with the given weight."""

    feature: str
    threshold: float
    left: int
    right: int
    alpha: float


def thresholds(rows: DataFrame, features: list[str], bins: int = 64) -> list[list[float]]:
    """For each feature at most bins - 1 rising values, of nearly equal numbers of rows between them; the greatest isn't one."""
    shares = [i / bins for i in range(1, bins)]
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    got = rows.agg(*[F.struct(F.percentile_approx(value(f), shares, 10_000).alias("q"), F.max(value(f)).alias("top")).alias(f"f{i}") for i, f in enumerate(features)]).first()
    return [sorted({x for x in g.q or [] if x < g.top}) for g in got]


def stump_sums(rows: DataFrame, features: list[str], cuts: list[list[float]], label: str, weight: str) -> DataFrame:
    """(feature, threshold, low_0, low_1, high_0, high_1): weights by label up to and above each threshold."""
    held = lambda f, t: F.coalesce(~(F.col(f).cast("double") > t) | F.isnan(F.col(f).cast("double")), F.lit(True))
    w = lambda c, y: F.sum(F.when(c & (F.col(label) == y), F.col(weight)).otherwise(0.0))
    sums = [F.struct(F.lit(f).alias("feature"), F.lit(float(t)).alias("threshold"), *[w(c, y).alias(f"{n}_{y}") for n, c in (("low", held(f, t)), ("high", ~held(f, t))) for y in (0, 1)]) for f, ts in zip(features, cuts) for t in ts]
    return rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def _best(hist: np.ndarray, features: list[str], cuts: list[list[float]]) -> tuple[Stump | None, float]:
    """The stump of least Gini impurity over sums by (feature, bin, label), the first of equals, and its weighted error."""
    best, out = math.inf, (None, 1.0)
    for f, ts in enumerate(cuts):
        low = np.cumsum(hist[f], axis=0)[: len(ts)]
        high = hist[f].sum(0) - low
        for t in range(len(ts)):
            impurity = sum(s.sum() - (s * s).sum() / s.sum() for s in (low[t], high[t]) if s.sum() > 0)
            if impurity < best - 1e-12:
                sides = [int(s[1] > s[0]) for s in (low[t], high[t])]
                best, out = impurity, (Stump(features[f], ts[t], *sides, 0.0), float(low[t][1 - sides[0]] + high[t][1 - sides[1]]))
    return out


class HistogramBoost:
    """Two classes, 0 and 1. Rows without a label take no part in fitting; nulls and NaN in features count as least.

    A stump's weight is rate * log((1 - error) / error), and rows it gets wrong gain by its exponential. Ends early at a
    stump without error, or one no better than chance.
    """

    def __init__(self, features: list[str], rounds: int = 200, rate: float = 0.05, bins: int = 64):
        self.features, self.rounds, self.rate, self.bins, self.stumps = features, rounds, rate, bins, []

    def fit(self, rows: DataFrame, label: str = "label") -> HistogramBoost:
        ensure_checkpoints(rows.sparkSession)
        rows = rows.where(F.col(label).isNotNull())
        self.cuts = thresholds(rows, self.features, self.bins)
        self.stumps = []
        if not any(self.cuts):
            return self
        value = lambda f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(float("-inf")))
        bin_of = lambda f, ts: sum(((value(f) > t).cast("int") for t in ts), F.lit(0))
        named = [bin_of(f, ts).cast("int").alias(f"b{i}") for i, (f, ts) in enumerate(zip(self.features, self.cuts))]
        binned = rows.select(F.col(label).cast("int").alias("y"), F.array(*named).alias("bins"))
        patterns = binned.groupBy("y", "bins").agg(F.count(F.lit(1)).cast("double").alias("w")).checkpoint()
        recent: list[tuple[int, int, int, int, float]] = []  # feature, bins on the left, sides, weight: not yet in w
        for _ in range(self.rounds):
            hist = self._histogram(patterns, recent)
            total = hist[0].sum()
            if total <= 0:
                break
            stump, wrong = _best(hist / total, self.features, self.cuts)
            if stump is None or wrong >= 0.5:
                break
            alpha = self.rate * math.log((1 - wrong) / wrong) if wrong > 0 else 1.0
            self.stumps.append(stump._replace(alpha=alpha))
            if wrong <= 0:
                break
            f = self.features.index(stump.feature)
            recent.append((f, self.cuts[f].index(stump.threshold), stump.left, stump.right, alpha))
            if len(recent) == 25:  # stumps so far need not be weighed again
                patterns, recent = patterns.withColumn("w", self._weight(recent) / total).checkpoint(), []
        return self

    @staticmethod
    def _weight(recent):
        w = F.col("w")
        for f, upto, left, right, alpha in recent:
            said = F.when(F.col("bins")[f] <= upto, left).otherwise(right)
            w = w * F.when(said != F.col("y"), math.exp(alpha)).otherwise(1.0)
        return w

    def _histogram(self, patterns: DataFrame, recent) -> np.ndarray:
        n_features, n_bins = len(self.features), max(map(len, self.cuts)) + 1

        def sums(batches):
            out = np.zeros((n_features, n_bins, 2))
            for b in batches:
                if not b.num_rows:
                    continue
                y, w = b.column(0).to_numpy(), b.column(2).to_numpy().copy()
                bins = b.column(1).flatten().to_numpy().reshape(-1, n_features)
                for f, upto, left, right, alpha in recent:
                    w[np.where(bins[:, f] <= upto, left, right) != y] *= math.exp(alpha)
                for f in range(n_features):
                    out[f] += np.bincount(bins[:, f] * 2 + y, weights=w, minlength=2 * n_bins).reshape(n_bins, 2)
            k = np.flatnonzero(out)
            yield pa.RecordBatch.from_pydict({"k": k, "v": out.ravel()[k]})

        out = np.zeros(n_features * n_bins * 2)
        for r in patterns.select("y", "bins", "w").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out.reshape(n_features, n_bins, 2)

    def transform(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        """rows with the probability of label 1: a logistic curve of the weighted mean vote, 0.5 without stumps."""
        vote, total = F.lit(0.0), sum(s.alpha for s in self.stumps)
        by: dict[str, list[Stump]] = {}
        for s in self.stumps:
            by.setdefault(s.feature, []).append(s)
        names = []
        for f, stumps in by.items():  # a feature's stumps together are one step function of its value
            cuts = sorted({s.threshold for s in stumps})
            step = lambda x: sum(s.alpha * (2 * (s.left if x <= s.threshold else s.right) - 1) for s in stumps)  # noqa: B023, E731
            value = F.col(f).cast("double")
            x = F.lit(step(math.inf))
            for t in reversed(cuts):
                x = F.when(value <= t, step(t)).otherwise(x)
            names.append(F.when(value.isNull() | F.isnan(value), step(-math.inf)).otherwise(x))
        for x in names:
            vote = vote + x
        return rows.withColumn(unused([c for c in rows.columns if c != out], out), 1.0 / (1.0 + F.exp(-vote / (total or 1.0))))
