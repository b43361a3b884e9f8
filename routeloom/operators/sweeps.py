"""Parameter sweeps: one pass over the rows for all settings, then the choice of an operating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.operators.outcomes import ratio


def sweep_thresholds(rows: DataFrame, confidence: Column, cheap: Column, dear: Column, thresholds: list[float], by: list[str]) -> DataFrame:
    """(by, threshold, n, accuracy, avg_cost, revise_rate): revise iff confidence is below the threshold.

    Rows are first summed by the number of thresholds they pass, so the sweep multiplies small sums, not rows.
    """
    cuts = sorted(thresholds)
    level = sum((confidence >= t).cast("int") for t in cuts)  # thresholds that don't revise the row
    g = rows.groupBy(*by, level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(cheap).alias("c"), F.sum(dear).alias("d"))
    wide = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])).alias("t")
    x = g.select(*by, "level", "n", "c", "d", wide).withColumn("revise", F.col("level") <= F.col("t.i"))
    return x.groupBy(*by, F.col("t.threshold").alias("threshold")).agg(
        F.sum("n").alias("n"),
        ratio(F.sum(F.when(F.col("revise"), F.col("d")).otherwise(F.col("c"))), F.sum("n")).alias("accuracy"),
        (1.0 + ratio(F.sum(F.when(F.col("revise"), F.col("n")).otherwise(0)), F.sum("n"))).alias("avg_cost"),
        ratio(F.sum(F.when(F.col("revise"), F.col("n")).otherwise(0)), F.sum("n")).alias("revise_rate"),
    )


def operating_point(sweep: DataFrame, by: list[str], target_cost: float) -> DataFrame:
    """Per group: among settings within the target cost the best accuracy, then the least cost; without any, the nearest cost."""
    ok = F.col("avg_cost") <= target_cost + 1e-9
    order = [F.when(ok, 0).otherwise(1), F.when(ok, -F.col("accuracy")).otherwise(F.abs(F.col("avg_cost") - target_cost)), "avg_cost", "threshold"]
    return sweep.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def budget_curve(rows: DataFrame, gain: Column, cheap: Column, targets: list[float], by: list[str], key: str) -> DataFrame:
    """(by, target, k, accuracy, avg_cost): revise the k rows of greatest label gain, k = half-even round of n (target - 1).

    This is an oracle curve: it ranks by labels. Only the number of rows of each gain matters, so rows are summed first.
    """
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(cheap).alias("base"), F.count_if(gain == 1).alias("up"), F.count_if(gain == 0).alias("flat"))
    t = F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("target")
    x = g.select(*by, "n", "base", "up", "flat", t)
    x = x.withColumn("k", F.greatest(F.least(F.bround(F.col("n") * (F.col("target") - 1)), F.col("n")), F.lit(0)).cast("long"))
    won = F.least("k", "up") - F.greatest(F.col("k") - F.col("up") - F.col("flat"), F.lit(0))
    return x.select(*by, "target", "k", ratio(F.col("base") + won, F.col("n")).alias("accuracy"), (1.0 + ratio(F.col("k"), F.col("n"))).alias("avg_cost"))


def cost_ratio_sensitivity(metrics: DataFrame, ratios: list[float]) -> DataFrame:
    """Route metrics under other prices of the costly action: avg_cost = 1 - revise_rate + revise_rate * ratio."""
    r = F.explode(F.array(*[F.lit(float(x)) for x in ratios])).alias("cost_ratio")
    return metrics.select("*", r).withColumn("avg_cost", (1.0 - F.col("revise_rate")) + F.col("revise_rate") * F.col("cost_ratio"))


def nearest_point(curve: DataFrame, by: list[str], cost: str, targets: list[float]) -> DataFrame:
    """For every target the row of the curve whose cost is nearest, the cheaper one on ties."""
    t = curve.select("*", F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("target_cost"))
    w = W.partitionBy(*by, "target_cost").orderBy(F.abs(F.col(cost) - F.col("target_cost")), cost)
    return t.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
