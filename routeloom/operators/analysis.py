"""Analysis tables: group contrasts, allocation summaries, gain tables, dataset checks, token-router grids, splits of trees."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from routeloom.operators.outcomes import ratio
from routeloom.operators.prefix import running


def feature_differences(rates: DataFrame, focus: str, baseline: str) -> DataFrame:
    """(feature, focus_rate, baseline_rate, difference) from (group, feature, rate); absent groups count 0."""
    pick = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("rate"))), F.lit(0.0))
    g = rates.groupBy("feature").agg(pick(focus).alias("focus_rate"), pick(baseline).alias("baseline_rate"))
    return g.withColumn("difference", F.col("focus_rate") - F.col("baseline_rate"))


def univariate_summary(rows: DataFrame, features: dict[str, Column], classes: Column) -> DataFrame:
    """(feature, class, n, mean, effect): mean of each feature by class; effect is the greatest less the least class mean."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("v")) for k, v in features.items()]))
    g = rows.select(classes.alias("class"), pairs.alias("p")).groupBy("p.feature", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("p.v").alias("mean"))
    w = W.partitionBy("feature")
    return g.withColumn("effect", F.max("mean").over(w) - F.min("mean").over(w))


def level_distribution(levels: DataFrame, level: str, n_levels: int) -> DataFrame:
    """(level, n, fraction) for every level from 0, also those never chosen."""
    counts = [F.struct(F.lit(i).alias("level"), F.count_if(F.col(level) == i).alias("n")) for i in range(n_levels)]
    g = levels.agg(F.count(F.lit(1)).alias("total"), F.array(*counts).alias("c")).select("total", F.explode("c").alias("c"))
    return g.select("c.level", "c.n", ratio(F.col("c.n"), F.col("total")).alias("fraction"))


def gain_table(k1: Column, k2: Column, k3: Column) -> list[Column]:
    """Columns of success with one to three samples: marginal gains and flags of where the gain is."""
    return [
        k1.alias("success_k1"), k2.alias("success_k2"), k3.alias("success_k3"), (k2 - k1).alias("gain_1_to_2"), (k3 - k2).alias("gain_2_to_3"),
        (k3 > k1).alias("needs_more"), ((k1 == 1) & (k2 == 1) & (k3 == 1)).alias("always_right"), (F.greatest(k1, k2, k3) == 0).alias("never_right"),
    ]


def dataset_checks(rows: DataFrame, key: str, required: list[str], split: str) -> DataFrame:
    """(n, distinct_keys, duplicate_keys, nulls, leaked_keys): a leaked key is in more than one split."""
    nulls = sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls"), (F.min(split) != F.max(split)).alias("leaked"))
    return g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum("nulls").alias("nulls"), F.count_if("leaked").alias("leaked_keys"))


def compare_datasets(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(only_a, only_b, both, differing) of two tables with the same key; nulls are equal to each other."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    left, right = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    return j.agg(F.count_if(left & ~right).alias("only_a"), F.count_if(right & ~left).alias("only_b"), F.count_if(left & right).alias("both"), F.count_if(left & right & differs).alias("differing"))


def token_grid(rows: DataFrame, tokens: str, cheap: Column, dear: Column, lows: list[float | None], highs: list[float | None]) -> DataFrame:
    """(low, high, n, accuracy, revise_rate) for all pairs with low <= high, None being no bound: one pass of conditional sums."""
    out = []
    for lo in lows:
        for hi in highs:
            if lo is None and hi is None or lo is not None and hi is not None and lo > hi:
                continue
            rev = (F.col(tokens) <= lo if lo is not None else F.lit(False)) | (F.col(tokens) >= hi if hi is not None else F.lit(False))
            out.append(F.struct(F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.when(rev, dear).otherwise(cheap)).alias("right"), F.count_if(rev).alias("revised")))
    g = rows.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return g.select("low", "high", "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), ratio(F.col("revised"), F.col("n")).alias("revise_rate"))


def nearest_rate(grid: DataFrame, target: float) -> DataFrame:
    """The setting whose revise rate is nearest the target, then the most accurate, then the cheapest."""
    return grid.orderBy(F.abs(F.col("revise_rate") - target), F.desc("accuracy"), "revise_rate", "low", "high").limit(1)


def best_gini_split(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, threshold, impurity) of the least weighted Gini impurity over midpoints between distinct values.

    Rows are summed by value first; running sums go over ranges of a feature's distinct values, so continuous features are
    no task's alone. Null and NaN values are left out.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    g = rows.select(pairs.alias("p"), F.col(label).alias("y")).where("p.v is not null and not isnan(p.v)").groupBy("p.feature", "p.v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    x = running(g, ["feature"], ["v"], {"nl": "n", "pl": "pos"}, ("next", "v"))
    whole = x.groupBy("feature").agg(F.sum("n").alias("nt"), F.sum("pos").alias("pt"))
    x = x.join(whole, "feature").where("next is not null")
    part = lambda n, p: n - (p * p + (n - p) * (n - p)) / n
    x = x.withColumn("impurity", (part(F.col("nl"), F.col("pl")) + part(F.col("nt") - F.col("nl"), F.col("pt") - F.col("pl"))) / F.col("nt"))
    best = F.min(F.struct(F.round("impurity", 12).alias("impurity"), F.col("feature"), ((F.col("v") + F.col("next")) / 2).alias("threshold")))
    return x.agg(best.alias("b")).where("b is not null").select("b.feature", "b.threshold", "b.impurity")


def budgeted_escalation(rows: DataFrame, instance: str, key: str) -> DataFrame:
    """(instance, key, samples) for rows (instance, key, score, want, budget): one sample each, then by falling score (ties
    by key) `want` more where they still fit; one that doesn't fit is passed over and later ones are tried. Instances are
    solved side by side; each streams through in order, and a task holds only the budget left."""
    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(f"{instance} {kinds[instance]}, {key} {kinds[key]}, samples int")
    arrow = to_arrow_schema(schema)

    def run(batches):
        current, left, begun = None, 0, False
        for b in batches:
            samples = []
            for i, want, budget, n in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                if not begun or i != current:
                    current, left, begun = i, int(budget) - n, True
                take = int(want) if want is not None and want <= left else 0
                left -= take
                samples.append(1 + take)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(samples, pa.int32())], schema=arrow)

    sizes = rows.groupBy(F.col(instance).alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    score = F.when(~F.isnan(F.col("score").cast("double")), F.col("score"))
    x = rows.join(sizes, F.col(instance).eqNullSafe(F.col("__i"))).select(instance, key, F.col(instance).alias("__i"), "want", "budget", "__n", score.alias("__score"))
    ordered = x.repartition(F.col(instance)).sortWithinPartitions(instance, F.desc_nulls_last("__score"), F.asc_nulls_last(key))
    return ordered.mapInArrow(run, schema)
