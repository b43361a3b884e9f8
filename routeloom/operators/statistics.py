"""Resampling statistics and exact quantiles from counts by distinct value."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resamples, as published intervals have them, and cells of a block of draws.
DRAWS, BLOCK = 10_000, 1 << 22
#: Distinct differences that a group may have for multinomial draws in one row; Poisson draws serve for more.
DISTINCT = 65_536


def paired_bootstrap(rows: DataFrame, by: str | list[str], key: str, difference: str, draws: int = DRAWS, seed: int = 42, distinct: int = DISTINCT) -> DataFrame:
    """(by, n, mean_diff, ci_low, ci_high, p_value, significant) of paired differences of any value.

    A resample is a multinomial draw over the distinct differences with their counts, so rows are summed by value first
    and a group is one row with its distinct values. In groups with more than `distinct` of them each value gets Poisson
    draws of its count instead, which add up to vectors over the draws, by blocks of a hash of the value: no task holds a
    group, and results don't depend on how rows are dealt. Null and NaN differences count for nothing; a group of them
    alone has n 0 and nulls. p is 1 if all differences are 0. With outcomes in place of differences this is the interval
    of their mean.
    """
    by = [by] if isinstance(by, str) else by
    value = F.col(difference).cast("double")
    counts = rows.select(*by, F.when(~F.isnan(value), value).alias("v")).groupBy(*by, "v").agg(F.count("v").alias("c"))
    sizes = counts.groupBy(*[F.col(b).alias(f"size_{i}") for i, b in enumerate(by)]).agg(F.count("v").alias("size"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"size_{i}"))
    sized = counts.join(sizes, same).select(*by, "v", "c", "size")
    counts, many = sized.where(F.col("size") <= distinct).select(*by, "v", "c"), sized.where(F.col("size") > distinct)
    groups = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("c") > 0, F.struct("v", "c")))).alias("pairs"))
    kinds = dict(rows.dtypes)

    def one(pairs):
        values, c = np.array([p["v"] for p in pairs], float), np.array([p["c"] for p in pairs], np.int64)
        n = int(c.sum())
        if not n:
            return 0, None, None, None, None, None
        rng = np.random.default_rng([seed, n, *c[:8].tolist()])
        step = max(1, BLOCK // len(values))
        means = np.concatenate([rng.multinomial(n, c / n, size=min(step, draws - at)) @ values / n for at in range(0, draws, step)])
        low, high = np.percentile(means, [2.5, 97.5])
        below = (means <= 0).mean()
        p = 1.0 if not values.any() else min(1.0, 2 * min(below, 1 - below))
        return n, float(values @ c / n), low, high, p, bool(low > 0 or high < 0)

    def run(batches):
        for pdf in batches:
            out = [(*g, *one(pairs)) for *g, pairs in zip(*(pdf[b] for b in by), pdf["pairs"])]
            yield pd.DataFrame(out, columns=[*by, "n", "mean_diff", "ci_low", "ci_high", "p_value", "significant"])

    few = groups.mapInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n long, mean_diff double, ci_low double, ci_high double, p_value double, significant boolean")
    return few.union(_poisson(many, by, kinds, draws, seed, distinct))


def _poisson(values: DataFrame, by: list[str], kinds: dict[str, str], draws: int, seed: int, distinct: int) -> DataFrame:
    """paired_bootstrap of groups (by, v, c, size) with many distinct values."""
    x = values.where("c > 0").withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / distinct)).cast("int"))
    x = x.withColumn("group_hash", F.xxhash64(*by)).repartition(*by, "block").sortWithinPartitions(*by, "block", "v")
    keys = ", ".join(f"{b} {kinds[b]}" for b in by)

    width = len(by)

    def drawn(batches):
        """For each block its sums of weights and of weighted values in each draw; a block's values come in order."""
        now, rng, key, weight, total = None, None, None, None, None

        def out():
            columns = [pa.array([k.as_py()] * draws, k.type) for k in key]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(draws)), pa.array(weight), pa.array(total)], [*by, "draw", "w", "t"])

        for b in batches:
            block, values, counts, hashes = (b.column(width + i).to_numpy() for i in range(4))
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (hashes[1:] != hashes[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if now != (hashes[lo], block[lo]):
                    if now is not None:
                        yield out()
                    now, key, weight, total = (hashes[lo], block[lo]), [b.column(i)[lo] for i in range(width)], np.zeros(draws), np.zeros(draws)
                    rng = np.random.default_rng([seed, int(hashes[lo]) & (2**63 - 1), int(block[lo])])
                for v, c in zip(values[lo:hi].tolist(), counts[lo:hi].tolist()):
                    w = rng.poisson(c, draws)
                    weight += w
                    total += v * w
        if now is not None:
            yield out()

    sums = x.select(*by, "block", "v", "c", "group_hash").mapInArrow(drawn, keys + ", draw long, w double, t double")
    means = sums.groupBy(*by, "draw").agg((F.sum("t") / F.sum("w")).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", [0.025, 0.975]).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("below"))
    true = values.groupBy(*[F.col(b).alias(f"of_{i}") for i, b in enumerate(by)]).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_diff"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"of_{i}"))
    low, high = F.col("q")[0], F.col("q")[1]
    return ends.join(true, same).select(*by, "n", "mean_diff", low.alias("ci_low"), high.alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(F.col("below"), 1 - F.col("below"))).alias("p_value"), ((low > 0) | (high < 0)).alias("significant"))


def regime_comparisons(rows: DataFrame, by: str, cheap: str, dear: str, policies: list[str], draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """paired_bootstrap of four comparisons in each group: best policy, oracle and always revising against the cheap
    route, and best policy against the oracle. policies are boolean columns; the best has the greatest mean, the first of equals."""
    c, d = F.col(cheap).cast("double"), F.col(dear).cast("double")
    x, chosen = rows, c
    if policies:
        right = [F.when(F.col(p), d).otherwise(c) for p in policies]
        means = rows.groupBy(by).agg(F.array(*[F.avg(r) for r in right]).alias("__means"))
        x = rows.join(means.select(by, F.array_position("__means", F.array_max("__means")).cast("int").alias("__best")), by)
        chosen = F.element_at(F.array(*right), F.col("__best"))
    oracle = F.when((c == 0) & (d == 1), d).otherwise(c)
    pairs = {"adaptive_best_policy_vs_always_reasoning": chosen - c, "oracle_vs_always_reasoning": oracle - c, "adaptive_best_policy_vs_oracle": chosen - oracle, "always_revise_vs_always_reasoning": d - c}
    long = x.select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("comparison"), v.alias("diff")) for k, v in pairs.items()])).alias("p")).select(by, "p.*")
    return paired_bootstrap(long, [by, "comparison"], by, "diff", draws, seed)


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], bins: int = 4096) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, of a numeric column without its nulls.

    All ranks are found in one descent: each lies in a range of values, the rows of all these ranges are counted over
    equal bins in one aggregation, and ranges shrink to a bin until they hold one value. Infinite values are counted
    apart. No task sees more than the bins of a round. None for an empty table.
    """
    v = F.col(column).cast("double")
    base = rows.select(v.alias("v")).where("v is not null and not isnan(v)")
    finite = base.where(F.abs("v") < float("inf"))
    s = base.agg(F.count("v").alias("n"), F.count_if(F.col("v") == float("-inf")).alias("low"), F.count_if(F.abs("v") < float("inf")).alias("mid"), F.min(F.when(F.abs("v") < float("inf"), F.col("v"))).alias("lo"), F.max(F.when(F.abs("v") < float("inf"), F.col("v"))).alias("hi")).first()
    if not s.n:
        return [None] * len(shares)
    places = [q * (s.n - 1) for q in shares]
    wanted = sorted({r for p in places for r in (int(p), min(int(p) + 1, s.n - 1))})
    found = {r: float("-inf") if r < s.low else float("inf") for r in wanted if not s.low <= r < s.low + s.mid}
    ranges = {r: (s.lo, s.hi, s.low) for r in wanted if r not in found}  # least value, greatest, rows below
    while ranges:
        found |= {r: lo for r, (lo, hi, _) in ranges.items() if lo == hi}
        ranges = {r: x for r, x in ranges.items() if r not in found}
        open_ = sorted(set(ranges.values()))
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (lo, hi, _) in enumerate(open_):
            inside, half = F.col("v").between(lo, hi), hi / 2 - lo / 2
            width = half / bins * 2
            # halves, so that the range of the greatest doubles doesn't overflow; neighbours have no width between them
            b = F.least(F.floor((F.col("v") / 2 - lo / 2) / (width / 2)), F.lit(bins - 1)) if width > 0 and lo + width > lo else F.when(F.col("v") > lo, 1).otherwise(0)
            which, bin_ = F.when(inside, i).otherwise(which), F.when(inside, b.cast("long")).otherwise(bin_)
        if not open_:
            break
        counts: dict[int, list] = {}
        for r in finite.select("v", which.alias("i"), bin_.alias("b")).where("i is not null").groupBy("i", "b").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counts.setdefault(r.i, []).append((r.lo, r.hi, r.n))
        for r, x in ranges.items():
            before = x[2]
            for lo, hi, n in sorted(counts[open_.index(x)]):
                if before + n > r:
                    ranges[r] = (lo, hi, before)
                    break
                before += n
    out = []
    for p in places:
        low, high = found[int(p)], found[min(int(p) + 1, s.n - 1)]
        out.append(low if p == int(p) or low == high else low + (high - low) * (p - int(p)))
    return out


def z_blend(rows: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    """rows with `z_score`, a weighted sum of population z-scores; the one row of statistics becomes literals."""
    names = [(f"m{i}", f"s{i}") for i in range(len(columns))]
    stats = rows.agg(*[x for (m, s), c in zip(names, columns) for x in (F.avg(c).alias(m), F.stddev_pop(c).alias(s))]).first()
    z = F.lit(0.0)
    for (m, s), c, w in zip(names, columns, weights):
        if stats[s]:
            z = z + w * (F.col(c) - stats[m]) / stats[s]
    return rows.withColumn("z_score", z)
