"""Forests and boosted trees over bins against pyspark.ml's on the same bins."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from routeloom.operators import forests, learned


def labelled(spark, n, seed=3):
    """Three features of at most 20 values each, so that every value has its bin here and in pyspark.ml."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, [20, 11, 3], (n, 3))
    y = (x[:, 0] + 3 * x[:, 1] * (x[:, 2] - 1) > 12) ^ (rng.random(n) < 0.15)
    d = spark.createDataFrame([(i, *map(float, r), float(k), 1.5 if k else 0.75) for i, (r, k) in enumerate(zip(x.tolist(), y.tolist()))], "id int, a double, b double, c double, label double, weight double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(d).cache()


def told(rows):
    return np.array([r[0] for r in rows.orderBy("id").select("probability").collect()])


def theirs(estimator, d):
    return told(estimator.fit(d).transform(d).withColumn("probability", vector_to_array("probability")[1]))


WEIGHTS = {0: 0.75, 1: 1.5}


def test_a_whole_tree_is_that_of_pyspark(spark):
    d = labelled(spark, 3000)
    own = forests.BinnedForest(["a", "b", "c"], 1, 5, least=2, weights=WEIGHTS, bootstrap=False).fit(d)
    assert np.allclose(told(own.transform(d)), theirs(DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=2, weightCol="weight"), d))


@pytest.mark.parametrize(("block", "cells"), [(65_536, 100_000), (100, 0)])
def test_boosting_is_that_of_pyspark(spark, monkeypatch, block, cells):
    """In one block and in many, with two levels a job and with one."""
    monkeypatch.setattr(forests, "BLOCK", block)
    monkeypatch.setattr(forests, "CELLS", cells)
    d = labelled(spark, 3000)
    own = forests.BinnedBoosting(["a", "b", "c"], 12, 0.3, 3, weights=WEIGHTS).fit(d)
    assert np.allclose(told(own.transform(d)), theirs(GBTClassifier(maxIter=12, stepSize=0.3, maxDepth=3, weightCol="weight"), d))


@pytest.mark.parametrize("some", ["all", "sqrt"])
def test_a_forest_is_near_that_of_pyspark(spark, monkeypatch, some):
    monkeypatch.setattr(forests, "BLOCK", 300)
    d = labelled(spark, 3000)
    own = forests.BinnedForest(["a", "b", "c"], 60, 5, None if some == "all" else 2, 2, WEIGHTS)
    got = told(own.fit(d).transform(d))
    want = theirs(RandomForestClassifier(numTrees=60, maxDepth=5, minInstancesPerNode=2, featureSubsetStrategy=some, weightCol="weight", seed=42), d)
    assert np.abs(got - want).mean() < 0.03 and np.corrcoef(got, want)[0, 1] > 0.98
    assert np.array_equal(got, told(own.fit(d).transform(d)))


def test_bootstraps_draw_rows_not_patterns(spark):
    """A pattern of n rows is drawn about n times in each tree, not 0, n or 2 n times."""
    d = spark.range(8000).selectExpr("id", "cast(id % 2 AS double) AS a", "cast(id % 2 = id % 4 AS double) AS label")
    own = forests.BinnedForest(["a"], 40, 1)
    block = own._blocks(d, "label").collect()[0]
    drawn = np.array([own._drawn(t, block) for t in range(40)])
    assert block[2].tolist() == [2000] * 4 and 20 < drawn.std() < 70 and abs(drawn.mean() - 2000) < 30


def test_bins(spark):
    inf, nan = math.inf, math.nan
    rows = [(float(i), float(i == 7), 0.0 if i < 900 else i / 1000, float(i % 3), None, nan if i % 2 else 5.0, -inf if i < 10 else inf if i > 990 else float(i % 2)) for i in range(1000)]
    d = spark.createDataFrame(rows, "a double, rare double, skewed double, few double, none double, gaps double, ends double")
    got = dict(zip(d.columns, forests.bin_starts(d, d.columns)))
    assert len(got["a"][0]) == 31 and max(np.diff([0.0, *got["a"][0], 1000.0])) < 33
    assert got["rare"] == ([1.0], 0.0) and got["few"] == ([1.0, 2.0], 1.0) and got["none"] == ([], 0.0) and got["gaps"] == ([], 5.0)
    assert got["skewed"][0][0] == np.nextafter(0, 1) and len(got["skewed"][0]) > 2 and got["ends"][0][:2] == [0.0, 1.0]
    own = forests.BinnedForest(d.columns, 5, 3)
    fitted = own.fit(d.withColumn("label", (F.col("rare") > 0).cast("double")))
    odd = spark.createDataFrame([(None, 1.0, nan, 9.0, 3.0, None, -inf)], d.schema)
    assert 0 <= fitted.transform(odd).first().probability <= 1 and fitted.transform(d).count() == 1000


def test_models_without_rows_or_features_to_split(spark):
    d = spark.range(50).selectExpr("id", "1D AS a", "cast(id % 5 = 0 AS double) AS label")
    for make in (lambda: forests.BinnedForest(["a"], 30, 3), lambda: forests.BinnedBoosting(["a"], 3, 0.1, 3)):
        assert {r.probability for r in make().fit(d.limit(0)).transform(d).collect()} == {0.5}
        assert len({r.probability for r in make().fit(d).transform(d).collect()}) == 1


@pytest.mark.parametrize("name", ["random_forest", "bagging", "boosting"])
def test_ensembles_grow_over_patterns(spark, monkeypatch, name):
    """Twenty times the rows, the same work: trees meet each pattern once, with its count, and pyspark.ml isn't asked."""
    model = learned.MODELS[name]()
    small = model.copy({model.numTrees: 5} if model.hasParam("numTrees") else {model.maxIter: 4})
    monkeypatch.setitem(learned.MODELS, name, lambda: small)
    seen, blocks = [], forests._Binned._blocks
    monkeypatch.setattr(forests._Binned, "_blocks", lambda *a: seen.append(blocks(*a)) or seen[-1])
    d = spark.range(20_000).selectExpr("id", "id % 7 AS x", "CASE WHEN id % 11 > 0 THEN id % 5 END AS z", "cast(id % 3 = 0 AS int) AS y")
    got = learned.out_of_fold(d, name, "id", ["x", "z"], "y")
    assert got.count() == 20_000 and got.where("probability between 0 and 1").count() == 20_000 and got.columns == ["id", "fold", "label", "probability"]
    sizes = [[(len(b[1]), int(b[2].sum())) for b in s.collect()] for s in seen]
    assert len(sizes) == 3 and all(len(s) == 1 and s[0][0] <= 2 * 7 * 5 and s[0][1] > 12_000 for s in sizes)
