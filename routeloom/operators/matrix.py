"""Fitted feature matrix: numeric columns by prefix and one-hot categories, as a pyspark.ml stage that saves and loads."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from routeloom.operators.statistics import exact_quantiles

#: Distinct values that a category may have.
MOST_VALUES = 1000


def number(c: Column) -> Column:
    """A value as double; null and what isn't a number count as 0."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


class _Shared(Params):
    prefixes = Param(Params._dummy(), "prefixes", "starts of the names of numeric columns", TypeConverters.toListString)
    categories = Param(Params._dummy(), "categories", "columns that become one-hot", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)


class FeatureMatrix(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the sorted names of numeric columns with one of the prefixes, their medians, and the sorted values of each
    category. Medians are exact, found by counts over bins; infinite values take part in them, NaN doesn't. A column of
    NaN alone has the median 0. Null categories are the empty text; more than MOST_VALUES values raise ValueError."""

    @keyword_only
    def __init__(self, *, prefixes: list[str] | None = None, categories: list[str] | None = None, outputCol: str = "features"):
        super().__init__()
        self._setDefault(prefixes=["feat_", "hfeat_"], categories=["regime", "action_name"], outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> FeatureMatrixModel:
        prefixes = tuple(self.getOrDefault(self.prefixes))
        columns = sorted(c for c in rows.columns if c.startswith(prefixes))
        x = rows.select(*[number(F.col(c)).alias(c) for c in columns])
        median = lambda c: exact_quantiles(x, c, [0.5])[0]
        with ThreadPoolExecutor(4) as pool:
            medians = dict(zip(columns, pool.map(inheritable_thread_target(rows.sparkSession)(median), columns)))
        values = {}
        for c in self.getOrDefault(self.categories):
            if c in rows.columns:
                got = rows.select(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")).distinct().limit(MOST_VALUES + 1).collect()
                if len(got) > MOST_VALUES:
                    raise ValueError(f"{c} has more than {MOST_VALUES} values")
                values[c] = sorted(r.v for r in got)
        state = {"medians": {c: 0.0 if m is None else m for c, m in medians.items()}, "values": values}
        return FeatureMatrixModel(state=json.dumps(state), outputCol=self.getOrDefault(self.outputCol))


class FeatureMatrixModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector of the learned columns, in the order of `names`. NaN, infinite values and columns that the rows lack
    get the median, values of a category that weren't seen get zeros; columns that weren't learned are left alone."""

    state = Param(Params._dummy(), "state", "medians and values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = '{"medians": {}, "values": {}}', outputCol: str = "features"):
        super().__init__()
        self._setDefault(state='{"medians": {}, "values": {}}', outputCol="features")
        self._set(**self._input_kwargs)

    @property
    def medians(self) -> dict[str, float]:
        return json.loads(self.getOrDefault(self.state))["medians"]

    @property
    def values(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.state))["values"]

    @property
    def names(self) -> list[str]:
        short = lambda c: "action" if c == "action_name" else c
        return [*self.medians, *(f"cat_{short(c)}__{v}" for c, vs in self.values.items() for v in vs)]

    def columns(self, rows: DataFrame) -> list[Column]:
        """The features one by one, under their names."""
        out = []
        for c, m in self.medians.items():
            v = number(F.col(f"`{c}`")) if c in rows.columns else F.lit(float(m))
            out.append(F.when(F.isnan(v) | (F.abs(v) == float("inf")), float(m)).otherwise(v))
        for c, vs in self.values.items():
            now = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
            out += [F.coalesce((now == v).cast("double"), F.lit(0.0)) for v in vs]
        return [x.alias(n) for x, n in zip(out, self.names)]

    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(*self.columns(rows)).cast("array<double>")))


def targets(kind: str, correct: str = "correct", gain: str = "gain_vs_cheapest", cost: str = "action_cost", price: float = 0.0) -> Column:
    """Label of a candidate row: "success" or "gain" (1 or 0), or "utility", correctness less price times cost."""
    if kind == "success":
        return number(F.col(correct)).cast("int")
    if kind == "gain":
        return (number(F.col(gain)) > 0).cast("int")
    if kind == "utility":
        return number(F.col(correct)) - price * number(F.col(cost))
    raise ValueError(f"unknown target {kind}")
