"""Outcome tables: labels, oracles, votes, disagreement, pairwise wins, and route metrics.

Outcomes are long (question, action, correct, cost) or wide rows with one pair of columns for each action. All
operators are joins, groupings and conditional sums; ties always end on a name or an ordinal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.operators.prefix import running, unused


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty group."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def route_metrics(rows: DataFrame, routes: dict[str, Column], cheap: Column, dear: Column, by: list[str], cheap_cost: float = 1.0, dear_cost: float = 2.0) -> DataFrame:
    """(by, route, n, accuracy, avg_cost, revise_rate) for routes given as boolean "take the costly action" columns."""
    flags = F.array(*[F.struct(F.lit(k).alias("route"), v.cast("int").alias("revise")) for k, v in routes.items()])
    long = rows.select(*by, cheap.alias("__c"), dear.alias("__d"), F.explode(flags).alias("r")).select(*by, "__c", "__d", "r.route", "r.revise")
    n, revised = F.count(F.lit(1)), F.sum("revise")
    return long.groupBy(*by, "route").agg(
        n.alias("n"),
        ratio(F.sum(F.when(F.col("revise") == 1, F.col("__d")).otherwise(F.col("__c"))), n).alias("accuracy"),
        (F.lit(cheap_cost) + (dear_cost - cheap_cost) * ratio(revised, n)).alias("avg_cost"),
        ratio(revised, n).alias("revise_rate"),
    )


def best_action(long: DataFrame, key: str, score: Column, cost: str = "cost", name: str = "action") -> DataFrame:
    """One row per key: the action of the highest score, then least cost, then first name. Aggregated, not sorted."""
    pick = F.min(F.struct((-score).alias("s"), F.col(cost).alias("c"), F.col(name).alias("a")))
    return long.groupBy(key).agg(pick.alias("b")).select(key, F.col("b.a").alias("best_action"), F.col("b.c").alias("best_cost"), (-F.col("b.s")).alias("best_score"))


def majority_vote(votes: DataFrame, key: str, answer: str, position: str, keep_empty: bool = True, ties: str = "first") -> DataFrame:
    """(key, winner, n_winner, n_votes, tie, ambiguous): plurality of answers; ties go to the first seen or, with
    ties="least", to the lexicographically smallest. Empty answers vote only if keep_empty; an empty winner is ambiguous."""
    v = votes.select(key, F.coalesce(F.col(answer), F.lit("")).alias("a"), F.col(position).alias("p"))
    v = v if keep_empty else v.where("a <> ''")
    counts = v.groupBy(key, "a").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    order = F.struct((-F.col("n")).alias("n"), F.col("p" if ties == "first" else "a").alias("t"), F.col("a").alias("a"))
    g = counts.groupBy(key).agg(F.min(order).alias("w"), F.sum("n").alias("n_votes"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    return g.select(
        key, F.col("w.a").alias("winner"), (-F.col("w.n")).alias("n_winner"), "n_votes",
        (F.size(F.filter("ns", lambda x: x == F.col("ns")[0])) > 1).alias("tie"), (F.col("w.a") == "").alias("ambiguous"),
    )


def oracle_labels(long: DataFrame, key: str = "question_id", action: str = "action") -> DataFrame:
    """(key, any_correct, n_correct, best_accuracy_action, cheapest_action, label): label is the cheapest correct action,
    or the cheapest of all when none is correct; ties by name."""
    cheapest = F.min(F.struct("cost", action))
    right = F.min(F.when(F.col("correct") == 1, F.struct("cost", action)))
    g = long.groupBy(key).agg(F.max("correct").alias("any_correct"), F.sum("correct").alias("n_correct"), cheapest.alias("c"), right.alias("r"))
    return g.select(key, "any_correct", "n_correct", F.col(f"c.{action}").alias("cheapest_action"), F.coalesce(F.col(f"r.{action}"), F.col(f"c.{action}")).alias("label"))


def pivot_outcomes(long: DataFrame, key: str, actions: list[str], action: str = "action") -> DataFrame:
    """Wide rows, one correct_ and one cost_ column for each listed action; missing ones are null."""
    cols = [F.max(F.when(F.col(action) == a, F.col(c))).alias(f"{c}_{a}") for a in actions for c in ("correct", "cost")]
    return long.groupBy(key).agg(*cols)


def pairwise_wins(wide: DataFrame, actions: list[str]) -> DataFrame:
    """(a, b, wins, disagree, n): questions where a is right and b wrong, for every ordered pair of listed actions.
    Sums over the wide row take the place of a self-join."""
    sums = []
    for a in actions:
        for b in actions:
            if a != b:
                x, y = F.col(f"correct_{a}"), F.col(f"correct_{b}")
                sums.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if((x == 1) & (y == 0)).alias("wins"), F.count_if(x != y).alias("disagree"), F.count_if(x.isNotNull() & y.isNotNull()).alias("n")))
    return wide.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def disagreement(wide: DataFrame, actions: list[str]) -> DataFrame:
    """(n, all_same, all_wrong, all_right, oracle_correct) over wide rows."""
    flags = F.array(*[F.coalesce(F.col(f"correct_{a}"), F.lit(0)) for a in actions])
    d = wide.select(flags.alias("f"))
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(F.array_distinct("f")) == 1).alias("all_same"),
        F.count_if(F.array_max("f") == 0).alias("all_wrong"), F.count_if(F.array_min("f") == 1).alias("all_right"), F.count_if(F.array_max("f") == 1).alias("oracle_correct"),
    )


def outcome_groups(rg: Column, dpr: Column) -> Column:
    """both, reasoning_only, revise_only (revise helps) or none."""
    return F.when((rg == 1) & (dpr == 1), "both").when(rg == 1, "reasoning_only").when(dpr == 1, "revise_only").otherwise("none")


def binary_metrics(rows: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate from counts; 0 where a denominator is 0."""
    tp, fp = F.count_if((truth == 1) & (predicted == 1)), F.count_if((truth == 0) & (predicted == 1))
    tn, fn = F.count_if((truth == 0) & (predicted == 0)), F.count_if((truth == 1) & (predicted == 0))
    return rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn")).select(
        *by, "tp", "fp", "tn", "fn",
        *[ratio(a, b).alias(k) for k, a, b in (
            ("accuracy", F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), ("precision", F.col("tp"), F.col("tp") + F.col("fp")),
            ("recall", F.col("tp"), F.col("tp") + F.col("fn")), ("f1", 2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), ("fpr", F.col("fp"), F.col("fp") + F.col("tn")))],
    )


def group_feature_rates(rows: DataFrame, group: Column, features: dict[str, Column], groups: list[str]) -> DataFrame:
    """(group, feature, n, rate) for every listed group and feature, groups without rows included with rate 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in features.items()]))
    found = rows.select(group.alias("group"), pairs.alias("p")).groupBy("group", "p.feature").agg(F.count(F.lit(1)).alias("n"), F.sum("p.value").alias("s"))
    spark = rows.sparkSession
    every = spark.createDataFrame([(g, f) for g in groups for f in features], "group string, feature string")
    return F.broadcast(every).join(found, ["group", "feature"], "left").select("group", "feature", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("s", F.lit(0.0)), F.col("n")).alias("rate"))


def signal_firing(rows: DataFrame, signals: dict[str, Column], wrong: Column) -> DataFrame:
    """(signal, fires, fraction, fires_on_wrong) for every signal, silent ones included."""
    aggs = [F.struct(F.lit(k).alias("signal"), F.count_if(v).alias("fires"), ratio(F.count_if(v), F.count(F.lit(1))).alias("fraction"), F.count_if(v & wrong).alias("fires_on_wrong")) for k, v in signals.items()]
    return rows.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def stratified_split(rows: DataFrame, key: str, strata: list[str], train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with `split`: in each stratum, by hash order of the key, floor(train n) (at least 1) train, floor(validation n)
    (at least 1 from three rows on) validation, the rest test. Places are counted over ranges of that order, so a stratum
    may hold all rows. Rows with the same key follow each other, in no set order."""
    names = [unused(rows.columns, n) for n in ("hash_", "one_", "place_", "size_")]
    h, one, place, size = names
    x = rows.withColumn(h, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn(one, F.lit(1).cast("long"))
    sizes = x.groupBy(*[F.col(c).alias(f"{size}{i}") for i, c in enumerate(strata)]).agg(F.count(F.lit(1)).alias(size))
    same = F.lit(True)
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"{size}{i}"))
    rows = running(x, strata, [h, key], {place: one}).join(sizes, same).select(*rows.columns, place, size)
    at, n = F.col(place), F.col(size)
    first = F.greatest(F.floor(train * n), F.lit(1))
    second = F.when(n >= 3, F.greatest(F.floor(validation * n), F.lit(1))).otherwise(0)
    return rows.withColumn("split", F.when(at <= first, "train").when(at <= first + second, "validation").otherwise("test")).drop(place, size)


def union_regimes(regimes: dict[str, DataFrame]) -> DataFrame:
    """All regimes' rows with a `regime` column; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("regime", F.lit(k)) for k, d in regimes.items()])
