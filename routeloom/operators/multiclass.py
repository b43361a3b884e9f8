"""Routers that choose among many actions: models, predictions out of fold, their report, and regret against the labels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from routeloom.operators.outcomes import ratio
from routeloom.operators.prefix import unused
from routeloom.sources.scratch import ensure_checkpoints

# Sizes of the five models.
MODELS = {
    "tree": lambda: DecisionTreeClassifier(maxDepth=8, weightCol="weight", seed=42),
    "bagging": lambda: RandomForestClassifier(numTrees=15, maxDepth=6, featureSubsetStrategy="all", weightCol="weight", seed=42),
    "random_forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=10, weightCol="weight", seed=42),
    "boosting": lambda rounds=80: OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=4, seed=42)),
    "logistic": lambda: LogisticRegression(maxIter=200, weightCol="weight"),
}


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n); null labels are a label."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, kind, precision, recall, f1, support): a row of kind "class" for each label that is true or predicted, then
    "macro" (the plain mean over these) and "weighted" (by support), and "accuracy" and "balanced" (the mean recall of true
    labels) in recall. A ratio over nothing is 0. Rows without a true label are left out. Rows are counted once; the
    rest is arithmetic on one row a pair of labels."""
    pairs = confusion(rows.where(F.col(truth).isNotNull()), truth, predicted)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*").where("label is not null")
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    precision, recall = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    classes = g.select("label", F.lit("class").alias("kind"), precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support", "hit")
    whole, none = F.sum("support"), F.lit(None).cast("double")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), whole)
    mean_of_true = F.avg(F.when(F.col("support") > 0, F.col("recall")))
    row = lambda kind, p, r, f: F.struct(F.lit(None).cast("string").alias("label"), F.lit(kind).alias("kind"), p.alias("precision"), r.alias("recall"), f.alias("f1"), whole.alias("support"))
    totals = classes.agg(F.array(
        row("macro", F.avg("precision"), F.avg("recall"), F.avg("f1")), row("weighted", weighted("precision"), weighted("recall"), weighted("f1")),
        row("accuracy", none, ratio(F.sum("hit"), whole), none), row("balanced", none, mean_of_true, none)).alias("t")).select(F.explode("t").alias("t")).select("t.*").where("support is not null")
    return classes.drop("hit").withColumn("label", F.col("label").cast("string")).union(totals)


def policy_regret(wide: DataFrame, policies: dict[str, Column], actions: list[str], prices: list[float]) -> DataFrame:
    """(policy, n, mean_accuracy, mean_cost, mean_regret_accuracy, and mean_utility_<i> and mean_regret_utility_<i> for the
    i-th price) of policies given as columns that name an action, over rows with correct_<action> and cost_<action>.

    Utility is correctness less price times cost; regret is what the row's best action has over the chosen one. Rows in
    which the chosen action has no outcome don't count for that policy. One aggregation for all policies and prices.
    """
    outcome = lambda kind, a: F.coalesce(*[F.when(a == x, F.col(f"{kind}_{x}")) for x in actions]).cast("double")
    utility = lambda p, x: F.col(f"correct_{x}") - F.lit(p) * F.col(f"cost_{x}")
    best = {"right": F.greatest(*[F.col(f"correct_{x}") for x in actions], F.lit(None).cast("int"))} | {f"u{i}": F.greatest(*[utility(p, x) for x in actions], F.lit(None).cast("double")) for i, p in enumerate(prices)}
    chosen = F.array(*[F.struct(F.lit(k).alias("policy"), outcome("correct", a).alias("correct"), outcome("cost", a).alias("cost")) for k, a in policies.items()])
    x = wide.select(*[v.alias(k) for k, v in best.items()], F.explode(chosen).alias("c")).select(*best, "c.*").where("correct is not null and cost is not null")
    got = lambda p: F.col("correct") - F.lit(p) * F.col("cost")
    return x.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("mean_accuracy"), F.avg("cost").alias("mean_cost"), F.avg(F.col("right") - F.col("correct")).alias("mean_regret_accuracy"),
        *[y for i, p in enumerate(prices) for y in (F.avg(got(p)).alias(f"mean_utility_{i}"), F.avg(F.col(f"u{i}") - got(p)).alias(f"mean_regret_utility_{i}"))])


def out_of_fold(rows: DataFrame, name: str, key: str, features: list[str], label: str, folds: int = 3, make=None) -> DataFrame:
    """(key, fold, truth, predicted): labels of each fold predicted by a model of the others, which weighs its own labels
    evenly. Labels are strings, of which there should be few; folds go by hash of the key. Rows without a label take no
    part. Where the other folds have one label that is the prediction, where none, null. `make` replaces MODELS[name]."""
    ensure_checkpoints(rows.sparkSession)
    at = unused([key, *features], "fold")
    x = rows.where(F.col(label).isNotNull()).select(key, F.col(label).cast("string").alias("truth"), *[F.col(f).cast("double").alias(f) for f in features]).withColumn(at, F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    x = x.checkpoint()  # else each pass of each model makes the rows anew, and one task those of all folds
    counts: dict[int, dict[str, int]] = {k: {} for k in range(folds)}
    for r in x.groupBy(at, "truth").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r[at]][r.truth] = r.n

    def scored(k: int) -> DataFrame:
        own: dict[str, int] = {}
        for f, c in counts.items():
            for y, n in c.items():
                own[y] = own.get(y, 0) + n * (f != k)
        labels = sorted(y for y, n in own.items() if n)
        test = x.where(F.col(at) == k)
        if len(labels) < 2:
            return test.select(key, F.col(at).alias("fold"), "truth", F.lit(labels[0] if labels else None).cast("string").alias("predicted"))
        n = sum(own.values())
        number, weight = F.lit(None).cast("double"), F.lit(1.0)
        for i, y in enumerate(labels):
            number, weight = F.when(F.col("truth") == y, float(i)).otherwise(number), F.when(F.col("truth") == y, n / (len(labels) * own[y])).otherwise(weight)
        filled = [f"filled_{i}" for i in range(len(features))]
        steps = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), (make or MODELS[name])()])
        train = x.where(F.col(at) != k).select("*", number.alias("label"), weight.alias("weight"))
        said = F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1)
        return steps.fit(train).transform(test).select(key, F.col(at).alias("fold"), "truth", said.alias("predicted"))

    with ThreadPoolExecutor(folds) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(scored), range(folds)))
