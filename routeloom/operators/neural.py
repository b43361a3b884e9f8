"""A small neural router with a loss that weighs each row by the cost of its error, fitted by Spark.

Every step is one aggregation: each task runs its rows forward and back and gives one gradient, Spark adds the gradients,
and the driver, which holds only the parameters, takes an Adam step. All rows take part in every step, so the result
doesn't depend on how rows are dealt, but for the rounding of sums.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.sources.scratch import ensure_checkpoints


def initial(sizes: list[int], seed: int = 42) -> list[np.ndarray]:
    """Weights and biases of the layers, uniform within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    return [rng.uniform(-1, 1, shape) / np.sqrt(n) for n, m in zip(sizes, sizes[1:]) for shape in ((n, m), (m,))]


def forward(params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Inputs of each layer and, last, the logits; hidden layers are rectified."""
    out = [x]
    for i in range(0, len(params), 2):
        x = x @ params[i] + params[i + 1]
        if i + 2 < len(params):
            x = np.maximum(x, 0)
        out.append(x)
    out[-1] = out[-1][:, 0]
    return out


def loss_and_gradient(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, positive: float, cost: float) -> tuple[float, list[np.ndarray]]:
    """Summed over the rows: weight * (cross entropy, label 1 `positive` times, + cost * probability of label 1 where the
    label is 0, the price of revising for nothing)."""
    layers = forward(params, x)
    z = layers[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    soft = np.logaddexp(0, z)
    each = positive * y * (soft - z) + (1 - y) * (soft + cost * p)
    dz = weight * (positive * y * (p - 1) + (1 - y) * (p + cost * p * (1 - p)))
    grads, back = [], dz[:, None]
    for i in range(len(params) - 2, -1, -2):
        grads = [layers[i // 2].T @ back, back.sum(0), *grads]
        if i:
            back = (back @ params[i].T) * (layers[i // 2] > 0)
    return float(weight @ each), grads


class NeuralRouter:
    """Probability that revising helps, for numeric features.

    Nulls and NaN become the feature's mean; features are scaled. `weight`, if given, is a column with what an error on
    that row costs (null: 1). Label 1 counts n_0 / n_1 times, so that both labels weigh the same. Rows without a label
    take no part in fitting; without rows of both labels every probability is the label's share, 0.5 without any.
    """

    def __init__(self, features: list[str], hidden: tuple[int, ...] = (64, 32), steps: int = 60, rate: float = 0.02, decay: float = 1e-4, cost: float = 0.0, seed: int = 42):
        self.features, self.hidden, self.steps, self.rate, self.decay, self.cost, self.seed = features, hidden, steps, rate, decay, cost, seed
        self.params, self.mean, self.sd, self.share, self.losses = None, None, None, 0.5, []

    def _inputs(self):
        value = [F.col(f).cast("double") for f in self.features]
        filled = [F.coalesce(F.when(~F.isnan(v), v), F.lit(float(m))) for v, m in zip(value, self.mean)]
        return F.array(*[(v - float(m)) / float(s) for v, m, s in zip(filled, self.mean, self.sd)])

    def fit(self, rows: DataFrame, label: str = "label", weight: str | None = None) -> NeuralRouter:
        ensure_checkpoints(rows.sparkSession)
        rows = rows.where(F.col(label).isNotNull())
        value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        s = rows.agg(F.count(F.lit(1)), F.sum((F.col(label) == 1).cast("long")), *[x for f in self.features for x in (F.avg(value(f)), F.stddev_pop(value(f)))]).first()
        n, ones = s[0], s[1] or 0
        self.mean, self.sd = np.array([m or 0.0 for m in s[2::2]]), np.array([d or 1.0 for d in s[3::2]])
        self.share, self.losses = ones / n if n else 0.5, []
        if not 0 < ones < n:
            self.params = None
            return self
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
        x = rows.select(self._inputs().alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")).checkpoint()
        whole = x.agg(F.sum("w")).first()[0] or 1.0
        positive = (n - ones) / ones
        sizes = [len(self.features), *self.hidden, 1]
        params = initial(sizes, self.seed)
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, self.steps + 1):
            loss, grads = self._gradient(x, params, positive)
            self.losses.append(loss / whole)
            for i, g in enumerate(grads):
                g = g / whole + self.decay * params[i]
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - self.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.params = params
        return self

    def _gradient(self, x: DataFrame, params: list[np.ndarray], positive: float) -> tuple[float, list[np.ndarray]]:
        cost, d = self.cost, len(self.features)
        size = 1 + sum(p.size for p in params)

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    loss, grads = loss_and_gradient(params, part.column(0).flatten().to_numpy().reshape(-1, d), part.column(1).to_numpy(), part.column(2).to_numpy(), positive, cost)
                    total += np.concatenate([[loss], *(g.ravel() for g in grads)])
            yield pa.RecordBatch.from_pydict({"k": np.arange(size), "v": total})

        got = np.zeros(size)
        for r in x.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            got[r.k] = r.v
        grads, at = [], 1
        for p in params:
            grads.append(got[at : at + p.size].reshape(p.shape))
            at += p.size
        return float(got[0]), grads

    def transform(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        if self.params is None:
            return rows.withColumn(out, F.lit(float(self.share)))
        params = self.params

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            z = forward(params, np.array(x.tolist()))[-1] if len(x) else np.zeros(0)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return rows.withColumn(out, score(self._inputs()))

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON row, by Spark's writer."""
        state = {"features": self.features, "share": self.share, "mean": list(self.mean), "sd": list(self.sd), "params": None if self.params is None else [p.tolist() for p in self.params]}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeuralRouter:
        state = json.loads(spark.read.text(path).first().value)
        out = cls(state["features"])
        out.share, out.mean, out.sd = state["share"], np.array(state["mean"]), np.array(state["sd"])
        out.params = None if state["params"] is None else [np.array(p) for p in state["params"]]
        return out


def decide(scored: DataFrame, threshold: float, cheap: str, dear: str, score: str = "probability", out: str = "action") -> DataFrame:
    """Batch routing by a fitted score: the dear action from the threshold on; without a score the cheap one."""
    return scored.withColumn(out, F.when(F.col(score) >= threshold, dear).otherwise(cheap))
