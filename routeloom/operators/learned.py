"""Learned routers on pyspark.ml: models, out-of-fold predictions, calibration, thresholds, parameter search, boosting."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from routeloom.operators.forests import BinnedBoosting, BinnedForest, fit_all
from routeloom.operators.outcomes import ratio
from routeloom.operators.texts import spread
from routeloom.sources.scratch import ensure_checkpoints

#: Sizes are those of the reference's hybrid registry.
MODELS = {
    "logistic": lambda: LogisticRegression(regParam=0.01, weightCol="weight"),
    "tree": lambda: DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=2, weightCol="weight", seed=42),
    "random_forest": lambda: RandomForestClassifier(numTrees=300, maxDepth=8, minInstancesPerNode=2, weightCol="weight", seed=42),
    "bagging": lambda: RandomForestClassifier(numTrees=200, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="all", weightCol="weight", seed=42),
    "boosting": lambda: GBTClassifier(maxIter=200, stepSize=0.05, maxDepth=3, weightCol="weight", seed=42),
}


def make_model(name: str, features: list[str]) -> Pipeline:
    """Imputed, scaled features and a model; unknown names raise KeyError."""
    filled = [f"{f}__filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), MODELS[name](),
    ])


def make_binned(name: str, features: list[str], counts: dict[float, int]) -> BinnedForest | BinnedBoosting | None:
    """The ensemble of that name over bins, with classes weighed as by class_weights; None if the model isn't one."""
    model, n = MODELS[name](), sum(counts.values())
    weights = {int(c): n / (2 * k) for c, k in counts.items() if c in (0.0, 1.0)}
    if isinstance(model, RandomForestClassifier):
        some = None if model.getFeatureSubsetStrategy() == "all" else math.ceil(math.sqrt(len(features)))
        return BinnedForest(features, model.getNumTrees(), model.getMaxDepth(), some, model.getMinInstancesPerNode(), weights, model.getSeed(), model.getMaxBins())
    if isinstance(model, GBTClassifier):
        return BinnedBoosting(features, model.getMaxIter(), model.getStepSize(), model.getMaxDepth(), model.getMinInstancesPerNode(), weights, model.getMaxBins())
    return None


def class_weights(counts: dict[float, int]) -> Column:
    """Weight n / (2 n_class) of `label` for counts by class; 1 for a class without rows."""
    n = sum(counts.values())
    weight = lambda c: F.lit(n / (2 * counts[c]) if counts.get(c) else 1.0)
    return F.when(F.col("label") == 1, weight(1.0)).otherwise(weight(0.0))


def out_of_fold(rows: DataFrame, name: str, key: str, features: list[str], label: str, folds: int = 3) -> DataFrame:
    """(key, fold, label, probability): each fold scored by a model of the others, whose rows alone weigh the classes;
    folds by hash of the key. With only one class in the training folds the probability is that class. Rows are dealt over
    all cores, and sorted for pyspark.ml, whose passes have as many tasks as the rows have partitions and which draws samples
    by place. Ensembles grow over bins instead: their rows are written once, and their passes are few."""
    ensure_checkpoints(rows.sparkSession)
    x = rows.select(key, F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    x = spread(x, key)
    x = x.sortWithinPartitions(key) if make_binned(name, features, {}) is None else x.checkpoint()
    counts = {(r.fold, r.label): r.n for r in x.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}

    own: list[dict[float, int]] = [{} for _ in range(folds)]
    for k in range(folds):
        for (fold, c), n in counts.items():
            if fold != k:
                own[k][c] = own[k].get(c, 0) + n
    train, test = [x.where(F.col("fold") != k) for k in range(folds)], [x.where(F.col("fold") == k) for k in range(folds)]
    binned = {k: m for k in range(folds) if len(own[k]) > 1 and (m := make_binned(name, features, own[k])) is not None}
    fit_all(list(binned.values()), [train[k] for k in binned])

    def scored(k: int) -> DataFrame:
        if len(own[k]) < 2:
            return test[k].select(key, "fold", "label", F.lit(float(next(iter(own[k]), 0.0))).alias("probability"))
        if k in binned:
            return binned[k].transform(test[k]).select(key, "fold", "label", "probability")
        fitted = make_model(name, features).fit(train[k].withColumn("weight", class_weights(own[k])))
        return fitted.transform(test[k]).select(key, "fold", "label", vector_to_array("probability")[1].alias("probability"))

    with ThreadPoolExecutor(folds) as pool:  # folds are fitted side by side
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(scored), range(folds)))


def constant_score(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """test with `probability`, the training rows' share of label 1 (0.5 without rows), and `majority`, their commonest
    label (the least of equals, null without rows)."""
    share = train.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.5)).alias("probability"))
    most = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))["l"].alias("majority"))
    p, m = share.first()[0], most.first()[0]
    return test.withColumns({"probability": F.lit(p), "majority": F.lit(m)})


class Calibrator:
    """Maps scores to probabilities: "none" clips them, "sigmoid" fits a logistic curve, "isotonic" a rising step line
    that is flat beyond the scores seen. Fitted on rows (score, label)."""

    def __init__(self, method: str = "none"):
        if method not in ("none", "sigmoid", "isotonic"):
            raise ValueError(f"unknown calibration method {method}")
        self.method, self.model = method, None

    def fit(self, rows: DataFrame, score: str, label: str) -> Calibrator:
        # equal scores are one row with its weight, so that the isotonic fit sees no more rows than scores
        x = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.avg(F.col(label).cast("double")).alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
        if self.method == "sigmoid":
            both = x.select("score", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("mean")).alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("mean"))).alias("w")))).alias("e")).select("score", "e.*").where("w > 0")
            vector = VectorAssembler(inputCols=["score"], outputCol="v").transform(both)
            self.model = LogisticRegression(featuresCol="v", weightCol="w", regParam=1.0 / max(rows.count(), 1), standardization=False).fit(vector)
        elif self.method == "isotonic":
            self.model = IsotonicRegression(featuresCol="score", labelCol="mean", weightCol="n").fit(x)
        return self

    def transform(self, rows: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        if self.method == "none":
            return rows.withColumn(out, F.greatest(F.least(F.col(score).cast("double"), F.lit(1.0)), F.lit(0.0)))
        if self.method == "sigmoid":
            b, w = float(self.model.intercept), float(self.model.coefficients[0])
            return rows.withColumn(out, 1.0 / (1.0 + F.exp(-(b + w * F.col(score)))))
        return self.model.setFeaturesCol("__score").setPredictionCol(out).transform(rows.withColumn("__score", F.col(score).cast("double"))).drop("__score")


THRESHOLDS = [round(0.05 * t, 2) for t in range(1, 20)]


def threshold_scores(rows: DataFrame, score: str, label: str, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, n, accuracy, f1, revise_rate, avg_cost) of labels predicted by score >= threshold: one pass of sums."""
    t = thresholds or THRESHOLDS
    up, y = lambda x: F.col(score) >= x, F.col(label) == 1
    n = F.count(F.lit(1))
    sums = [F.struct(F.lit(float(x)).alias("threshold"), n.alias("n"), F.count_if(up(x) & y).alias("tp"), F.count_if(up(x) & ~y).alias("fp"), F.count_if(~up(x) & y).alias("fn")) for x in t]
    g = rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rate = ratio(tp + fp, F.col("n"))
    return g.select("threshold", "n", ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), ratio(tp, tp + 0.5 * (fp + fn)).alias("f1"), rate.alias("revise_rate"), (1.0 + rate).alias("avg_cost"))


def best_threshold(rows: DataFrame, score: str, label: str, metric: str = "accuracy", thresholds: list[float] | None = None) -> float:
    """The least threshold of the greatest accuracy or f1."""
    r = threshold_scores(rows, score, label, thresholds).orderBy(F.desc(metric), "threshold").first()
    return r.threshold


def holdout(rows: DataFrame, key: str, test_regime: str | None, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with `split`: the named regime is test, of the others about `validation` go to validation by hash of the key."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    pool = F.when(h < validation, "validation").otherwise("train")
    return rows.withColumn("split", pool if test_regime is None else F.when(F.col("regime") == test_regime, "test").otherwise(pool))


def grid_search(train: DataFrame, validation: DataFrame, make, grid: dict[str, list], label: str = "label") -> tuple[object, dict, list[dict]]:
    """(best fitted model, its settings, all results) over every combination of the grid: make(**settings) gives an
    estimator with a `probability` column; score is ROC area + PR area - Brier score on the validation rows. The first of
    equals wins."""
    keys = sorted(grid)
    best, results = (None, {}, -math.inf), []
    for values in product(*(grid[k] for k in keys)):
        settings = dict(zip(keys, values))
        model = make(**settings).fit(train)
        p = model.transform(validation)
        area = lambda m: BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label, metricName=m).evaluate(p)
        brier = p.agg(F.avg((vector_to_array("probability")[1] - F.col(label)) ** 2)).first()[0]
        score = area("areaUnderROC") + area("areaUnderPR") - brier
        results.append({"score": score, **settings})
        if score > best[2]:
            best = (model, settings, score)
    return best[0], best[1], results


class Boosted:
    """Decision stumps boosted by their weighted errors (AdaBoost for two classes), as Spark jobs over weighted rows.

    fit takes rows with `features` and `label`; each round writes the next weights as an expression of the stumps so far,
    so no table of weights is kept. Ends early at a stump without error, or one no better than chance.
    """

    def __init__(self, rounds: int = 200, rate: float = 0.05, depth: int = 1):
        self.rounds, self.rate, self.depth, self.stumps = rounds, rate, depth, []

    def _votes(self, rows: DataFrame) -> DataFrame:
        """rows with `margin`, the stumps' weighted votes (-1 or 1) over the sum of their weights."""
        x, total = rows.withColumn("margin", F.lit(0.0)), 0.0
        for alpha, model in self.stumps:
            x = model.transform(x).withColumn("margin", F.col("margin") + alpha * (2 * F.col("prediction") - 1)).drop("rawPrediction", "probability", "prediction")
            total += alpha
        return x.withColumn("margin", F.col("margin") / (total or 1.0))

    def fit(self, rows: DataFrame) -> Boosted:
        ensure_checkpoints(rows.sparkSession)
        self.stumps = []
        x = rows.withColumn("weight", F.lit(1.0))
        for _ in range(self.rounds):
            scale = x.agg(F.sum("weight")).first()[0]
            x = x.withColumn("weight", F.col("weight") / scale)
            model = DecisionTreeClassifier(maxDepth=self.depth, weightCol="weight", seed=42).fit(x)
            hit = model.transform(x)
            wrong = (F.col("prediction") != F.col("label")).cast("double")
            error = hit.agg(F.sum(F.col("weight") * wrong)).first()[0] or 0.0
            if error >= 0.5:
                break
            alpha = self.rate * math.log((1 - error) / max(error, 1e-12))
            self.stumps.append((alpha, model))
            if error <= 0:
                break
            x = hit.withColumn("weight", F.col("weight") * F.exp(alpha * wrong)).drop("rawPrediction", "probability", "prediction")
            if len(self.stumps) % 10 == 0:
                x = x.checkpoint()  # stumps so far need not be run again
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with `probability_1`, a logistic curve of the margin."""
        return self._votes(rows).withColumn("probability_1", 1.0 / (1.0 + F.exp(-2.0 * F.col("margin")))).drop("margin")
