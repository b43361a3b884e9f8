"""Simulated allocation: utility curves of queries over compute levels, noise on them, allocations and their summaries.

A table has a row per query: an instance, the query's key, `curve` (utility by level) and, where asked for, a difficulty.
Costs by level are a list. Instances are solved side by side; every summary is a grouping.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from routeloom.operators.allocation import knapsack
from routeloom.operators.outcomes import ratio
from routeloom.operators.texts import dealt, partitions_for

#: Share, range of the first level and range of the whole gain, by difficulty.
DIFFICULTIES = {"easy": (0.35, (0.45, 0.7), (0.15, 0.4)), "medium": (0.4, (0.2, 0.45), (0.2, 0.45)), "hard": (0.25, (0.02, 0.22), (0.35, 0.65))}
#: Presets of noise, by name.
NOISE = {"none": 0.0, "low": 0.05, "medium": 0.1, "high": 0.2}


def uniform(*key: Column | int) -> Column:
    """A number in 0..1 by hash of the key, the same wherever the row is computed."""
    h = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key])
    return (F.shiftrightunsigned(h, 11)).cast("double") / float(1 << 53)


def rising(values: Column) -> Column:
    """An array's running maximum, kept in 0..1."""
    at = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.least(F.greatest(at(acc), x), F.lit(1.0)))))


def _summed(start: Column, steps: list[Column]) -> Column:
    out, now = [start], start
    for s in steps:
        now = F.least(now + s, F.lit(1.0))
        out.append(now)
    return F.array(*out)


def curves(queries: DataFrame, key: str, levels: int, family: str = "mixed_difficulty", seed: int = 42) -> DataFrame:
    """queries with `curve` and `difficulty`: rising utilities of each level. "monotone" has random steps, "concave"
    falling ones, "mixed_difficulty" an easy, medium or hard shape; difficulty is n/a for the first two.

    Numbers come from a hash of seed and key, not from a generator's sequence, so that tables of any size can be made
    side by side; equal seeds give equal tables.
    """
    if levels < 2:
        raise ValueError("a curve has two levels at least")
    n, u = levels - 1, lambda k: uniform(F.col(key), seed, k)
    between = lambda k, lo, hi: lo + (hi - lo) * u(k)
    if family == "monotone":
        return queries.withColumns({"curve": _summed(between(0, 0.0, 0.2), [between(i, 0.03, 0.25) for i in range(1, levels)]), "difficulty": F.lit("n/a")})
    if family == "concave":
        steps = F.sort_array(F.array(*[between(i, 0.01, 0.25) for i in range(1, levels)]), asc=False)
        return queries.withColumns({"curve": _summed(between(0, 0.0, 0.2), [steps[i] for i in range(n)]), "difficulty": F.lit("n/a")})
    if family != "mixed_difficulty":
        raise ValueError(f"unknown curve family {family}")
    line = [i / max(n - 1, 1) for i in range(n)]
    shapes = {"easy": [math.exp(-2 * x) for x in line], "medium": [1.0] * n, "hard": [0.4 + 1.2 * x for x in line]}
    label, curve, upto = F.lit("hard"), None, 1.0
    for name, (share, first, gain) in reversed(DIFFICULTIES.items()):
        steps = [between(1, *gain) * (w / sum(shapes[name])) * between(2 + i, 0.9, 1.1) for i, w in enumerate(shapes[name])]
        made = _summed(between(0, *first), steps)
        curve = made if curve is None else F.when(F.col("difficulty") == name, made).otherwise(curve)
        label = F.when(u(-1) < upto, name).otherwise(label)
        upto -= share
    return queries.withColumn("difficulty", label).withColumn("curve", curve)


def noisy(table: DataFrame, key: str, deviation: float, seed: int = 42, monotone: bool = True, out: str = "estimate") -> DataFrame:
    """table with its curves plus Gaussian noise (by hash of seed, key and level), kept in 0..1 and, if monotone, made to
    rise; a deviation of 0 gives the curves themselves."""
    if deviation < 0:
        raise ValueError("the deviation can't be negative")

    def normal(i):
        a = F.greatest(uniform(F.col(key), F.lit(seed), i, F.lit(0)), F.lit(2.0**-53))
        return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * uniform(F.col(key), F.lit(seed), i, F.lit(1)))

    moved = F.transform("curve", lambda x, i: F.least(F.greatest(x + deviation * normal(i), F.lit(0.0)), F.lit(1.0)))
    return table.withColumn(out, rising(moved) if monotone else moved)


def _check(costs: list[int]) -> None:
    if not costs or any(c < 0 for c in costs) or any(a > b for a, b in zip(costs, costs[1:])):
        raise ValueError("costs must be a rising list of non-negative integers")


def equal_levels(table: DataFrame, instance: str, key: str, costs: list[int], curve: str = "curve") -> DataFrame:
    """(instance, key, level) for rows with `budget`: the dearest level within budget div n for every query, then single
    upgrades of greatest gain (ties: cheapest, then first key) while they fit and gain. An instance whose budget doesn't
    pay for the cheapest level gets level -1. A task holds one instance's curves."""
    _check(costs)
    kinds = dict(table.dtypes)
    schema = StructType.fromDDL(f"{instance} {kinds[instance]}, {key} {kinds[key]}, level int")
    arrow = to_arrow_schema(schema)

    def solve(rows: list[tuple]) -> list[int]:
        n, budget = len(rows), int(rows[0][1] or 0)  # a null budget pays for nothing
        if n * costs[0] > budget:
            return [-1] * n
        base = max((k for k, c in enumerate(costs) if c <= budget // n), default=0)
        levels, left = [base] * n, budget - n * costs[base]

        def step(i):
            k = levels[i]
            while k + 1 < len(costs):  # a level that costs no more isn't an upgrade, and blocks those above
                extra = costs[k + 1] - costs[k]
                return (-(rows[i][2][k + 1] - rows[i][2][k]), extra, i) if extra > 0 else None
            return None

        heap = [s for s in map(step, range(n)) if s]
        heapq.heapify(heap)
        while heap and left > 0:
            gain, extra, i = heapq.heappop(heap)
            if gain >= 0:
                break
            if extra > left:  # it never fits again
                continue
            levels[i] += 1
            left -= extra
            if s := step(i):
                heapq.heappush(heap, s)
        return levels

    def run(batches):
        current, rows, done, begun = None, [], [], False

        def flush():
            done.extend((current, r[0], k) for r, k in zip(rows, solve(rows)))
            rows.clear()

        for b in batches:
            for i, *row in zip(*(c.to_pylist() for c in b.columns)):
                if begun and i != current:
                    flush()
                current, begun = i, True
                rows.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
                done.clear()
        if rows:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)

    x = table.select(instance, key, "budget", F.col(curve).alias("curve"))
    return dealt(x, instance).sortWithinPartitions(instance, key).mapInArrow(run, schema)


def knapsack_levels(table: DataFrame, instance: str, key: str, costs: list[int], curve: str = "curve") -> DataFrame:
    """(instance, key, level) of the greatest total utility within each instance's budget; level -1 where infeasible."""
    _check(costs)
    options = F.posexplode(F.arrays_zip(F.col(curve).alias("u"), F.array(*[F.lit(float(c)) for c in costs]).alias("c")))
    long = table.select(F.col(instance), F.col(key).alias("prompt_id"), F.col("budget").cast("double").alias("budget"), options.alias("at", "o"))
    long = long.select(instance, "prompt_id", F.lpad(F.col("at").cast("string"), 4, "0").alias("action_name"), F.col("o.c").alias("action_cost"), F.col("o.u").alias("final_utility"), "budget")
    got = knapsack(long, instance, 1)
    return got.select(instance, F.col("prompt_id").alias(key), F.when(F.col("feasible"), F.col("action_name").cast("int")).otherwise(-1).alias("level"))


ALLOCATORS = {"equal": equal_levels, "mckp": knapsack_levels}


def allocate(name: str, table: DataFrame, instance: str, key: str, costs: list[int], curve: str = "curve") -> DataFrame:
    """Levels by the named allocator: equal, mckp, or robust_equalized (mckp on curves drawn to their mean by 0.35)."""
    if name == "robust_equalized":
        mean = F.aggregate(curve, F.lit(0.0), lambda a, x: a + x) / F.size(curve)
        table = table.withColumn("drawn", rising(F.transform(curve, lambda x: F.least(F.greatest(0.65 * x + 0.35 * mean, F.lit(0.0)), F.lit(1.0)))))
        return knapsack_levels(table, instance, key, costs, "drawn")
    if name not in ALLOCATORS:
        raise ValueError(f"unknown allocator {name}")
    return ALLOCATORS[name](table, instance, key, costs, curve)


def scored(table: DataFrame, costs: list[int], level: str = "level", curve: str = "curve") -> DataFrame:
    """table with `cost` and `utility` of each row's level, null for level -1."""
    ok = F.col(level) >= 0
    at = F.col(level) + 1
    return table.withColumns({"cost": F.when(ok, F.try_element_at(F.array(*[F.lit(c) for c in costs]), at)), "utility": F.when(ok, F.try_element_at(F.col(curve), at))})


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, total_cost, total_utility, average_cost, average_utility) of scored rows."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n"), F.sum("cost").alias("total_cost"), F.sum("utility").alias("total_utility"), ratio(F.sum("cost"), n).alias("average_cost"), ratio(F.sum("utility"), n).alias("average_utility"))


def by_difficulty(rows: DataFrame, n_levels: int, order: tuple = ("easy", "medium", "hard")) -> DataFrame:
    """(difficulty, level, n, fraction, num_queries, average_cost, average_utility) of scored rows for every listed
    difficulty and level; those without rows have zeros."""
    g = rows.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("num"), F.avg("cost").alias("cost"), F.avg("utility").alias("utility"),
        F.array(*[F.count_if(F.col("level") == k) for k in range(n_levels)]).alias("counts"))
    every = rows.sparkSession.createDataFrame([(d, k) for d in order for k in range(n_levels)], "difficulty string, level int")
    j = F.broadcast(every).join(g, "difficulty", "left")
    n = F.coalesce(F.try_element_at("counts", F.col("level") + 1), F.lit(0))
    zero = F.lit(0.0)
    return j.select("difficulty", "level", n.alias("n"), ratio(n, F.col("num")).alias("fraction"), F.coalesce("num", F.lit(0)).alias("num_queries"), F.coalesce("cost", zero).alias("average_cost"), F.coalesce("utility", zero).alias("average_utility"))


def _runs(table: DataFrame, instance: str, key: str, costs: list[int], allocators: list[str], curve: str) -> DataFrame:
    """(instance, budget, allocator, feasible, total_cost, true_utility, estimated_utility): an instance and budget is one
    problem, and all problems of an allocator are one job. Curves meet their levels in a merge join over partitions_for
    their rows: Spark takes the exploded table for as small as its file, and would broadcast it whole."""
    problem = F.struct(F.col(instance).alias("instance"), F.col("budget").alias("budget"))
    t = table.withColumn("problem", F.to_json(problem))
    out, both, n = None, ["problem", key], partitions_for(t)
    for name in allocators:
        levels = allocate(name, t, "problem", key, costs, curve)
        s = scored(t.repartition(n, *both).join(levels.repartition(n, *both).hint("merge"), both), costs)
        s = s.withColumn("estimated", F.when(F.col("level") >= 0, F.try_element_at(F.col(curve), F.col("level") + 1)))
        g = s.groupBy(instance, "budget").agg((F.min("level") >= 0).alias("feasible"), F.sum("cost").alias("total_cost"), F.sum("utility").alias("true_utility"), F.sum("estimated").alias("estimated_utility")).withColumn("allocator", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


def comparison(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, equal_utility, mckp_utility, gap, relative): relative is null where the equal utility is 0."""
    value = lambda a: F.max(F.when(F.col("allocator") == a, F.col("true_utility")))
    g = runs.groupBy(*by).agg(value("equal").alias("equal_utility"), value("mckp").alias("mckp_utility")).where("equal_utility is not null and mckp_utility is not null")
    gap = F.col("mckp_utility") - F.col("equal_utility")
    return g.withColumns({"gap": gap, "relative": F.when(F.abs("equal_utility") > 1e-12, gap / F.col("equal_utility"))})


def budget_sweep(table: DataFrame, instance: str, key: str, costs: list[int], budgets: list[int], allocators: list[str] = ("equal", "mckp")) -> DataFrame:
    """Runs of every instance, budget and allocator; see comparison for the gaps."""
    if not budgets or not allocators:
        raise ValueError("a sweep needs budgets and allocators")
    t = table.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    return _runs(t, instance, key, costs, list(allocators), "curve")


def noise_sweep(table: DataFrame, instance: str, key: str, costs: list[int], noise: dict[str, float] | None = None, allocators: list[str] = ("equal", "mckp"), seed: int = 42) -> DataFrame:
    """Runs that allocate on noisy curves and are scored on the true ones, for rows with `budget`: as budget_sweep, with
    noise_name, noise_std and degradation, the loss of true utility against the same allocator without noise."""
    out = None
    for i, (name, deviation) in enumerate((NOISE if noise is None else noise).items()):
        runs = _runs(noisy(table, key, deviation, seed + i), instance, key, costs, list(allocators), "estimate").withColumns({"noise_name": F.lit(name), "noise_std": F.lit(float(deviation))})
        out = runs if out is None else out.unionByName(runs)
    base = out.where("noise_std = 0").groupBy(instance, "budget", "allocator").agg(F.max("true_utility").alias("base"))
    return out.join(base, [instance, "budget", "allocator"], "left").withColumn("degradation", F.col("base") - F.col("true_utility")).drop("base")


def seed_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means and population deviations of comparisons over seeds, and the share of seeds in which the knapsack wins."""
    n = F.count(F.lit(1))
    both = [f(c).alias(f"{k}_{name}") for name, c in (("equal_utility", "equal_utility"), ("mckp_utility", "mckp_utility"), ("utility_gap", "gap")) for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy(*by).agg(n.alias("n_seeds"), *both, ratio(F.count_if(F.col("gap") > 0), n).alias("fraction_mckp_beats_equal"))


def key_findings(budgets: DataFrame, noise: DataFrame, small: float = 0.5, gap: str = "mean_utility_gap") -> DataFrame:
    """One row: the budget of the greatest gap (the first of equals), the first with a small one, the mean gap, and the
    first noise level at which nothing is gained; null where there is none."""
    peak = F.max_by(F.struct("budget", F.col(gap).alias("gap")), F.struct(F.col(gap), -F.col("budget")))
    b = budgets.agg(peak.alias("p"), F.min(F.when(F.col(gap) <= small, F.col("budget"))).alias("budget_where_gap_becomes_small"), F.avg(gap).alias("average_gap"))
    first = F.min(F.when(F.col(gap) <= 0, F.struct("noise_std", "noise_name", F.col(gap).alias("gap"))))
    n = noise.agg(first.alias("f")).withColumn("one", F.lit(1))
    return b.withColumn("one", F.lit(1)).join(n, "one").select(
        F.col("p.budget").alias("budget_where_gap_peaks"), F.col("p.gap").alias("peak_gap"), "budget_where_gap_becomes_small", "average_gap",
        F.col("f.noise_name").alias("noise_without_gain"), F.col("f.noise_std").alias("noise_std_without_gain"))


def gain_summary(gains: DataFrame) -> DataFrame:
    """One row of shares over success_k1..k3 and marginal gains: some gain, diminishing returns, none."""
    n = F.count(F.lit(1))
    flags = {
        "fraction_positive_gain": F.col("success_k3") > F.col("success_k1"), "fraction_diminishing_returns": F.col("gain_1_to_2") >= F.col("gain_2_to_3"),
        "fraction_no_gain": (F.col("success_k1") == F.col("success_k2")) & (F.col("success_k2") == F.col("success_k3")),
    }
    return gains.agg(n.alias("total_queries"), *[ratio(F.count_if(c), n).alias(k) for k, c in flags.items()])


def samples_for_budget(baseline: Column, budget: Column, queries: Column, cap: Column) -> Column:
    """Samples a query: one for the greedy baseline, else the cap or the budget's share; null if the budget is too small."""
    share = F.least(F.greatest(cap, F.lit(1)), F.floor(budget / queries))
    return F.when((queries > 0) & (budget >= queries), F.when(baseline == "greedy", 1).otherwise(share)).cast("int")
