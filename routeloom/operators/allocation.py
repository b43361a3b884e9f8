"""Budgeted allocation of actions to prompts.

Instances (a group of prompts that share a budget) are solved side by side, one task's group each; they are bounded
by what one instance holds. Selections without a shared sequence (argmax, Lagrangian) are plain aggregations over all
prompts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from routeloom.operators.texts import dealt
from routeloom.sources.scratch import ensure_checkpoints


def argmax_per_prompt(c: DataFrame, price: float = 0.0) -> DataFrame:
    """(prompt_id, action_name, action_cost, final_utility): best utility less price times cost, then least cost, then last name."""
    pick = F.max(F.struct((F.col("final_utility") - price * F.col("action_cost")).alias("v"), (-F.col("action_cost")).alias("nc"), F.col("action_name"), F.col("final_utility")))
    return c.groupBy("prompt_id").agg(pick.alias("m")).select("prompt_id", "m.action_name", (-F.col("m.nc")).alias("action_cost"), "m.final_utility")


def utility_hulls(c: DataFrame) -> DataFrame:
    """(prompt_id, hull): of each prompt's candidates, those that are best at some price of cost, by rising cost, as
    structs (action_cost, final_utility, action_name, slope), slope being the gain per cost over the one before, null at first.

    One aggregation by prompt, whose rows are its actions; rows without a cost or utility are left out. Of candidates
    with equal cost and utility the last name counts, of a straight run the ends.
    """
    point = F.struct(F.col("action_cost").cast("double").alias("action_cost"), (-F.col("final_utility").cast("double")).alias("loss"), "action_name")
    rows = c.where("action_cost is not null and final_utility is not null").groupBy("prompt_id").agg(F.collect_list(point).alias("points"))
    points = F.array_sort("points", lambda x, y: F.when(x["action_cost"] != y["action_cost"], F.signum(x["action_cost"] - y["action_cost"])).when(x["loss"] != y["loss"], F.signum(x["loss"] - y["loss"])).when(x["action_name"] > y["action_name"], -1.0).when(x["action_name"] < y["action_name"], 1.0).otherwise(0.0).cast("int"))
    kind = f"array<struct<action_cost:double,final_utility:double,action_name:{dict(c.dtypes)['action_name']},slope:double>>"

    def add(hull, p):
        """Points that the new one leaves on the hull are those reached more steeply than it is from them."""
        up = -p["loss"]
        slope = lambda h: (up - h["final_utility"]) / (p["action_cost"] - h["action_cost"])
        kept = F.filter(hull, lambda h: h["slope"].isNull() | (h["slope"] > slope(h)))
        last = F.element_at(hull, -1)
        joined = F.transform(F.array(kept), lambda k: F.concat(k, F.array(F.struct(p["action_cost"].alias("action_cost"), up.alias("final_utility"), p["action_name"].alias("action_name"), slope(F.element_at(k, -1)).alias("slope")))))[0]
        return F.when(up > last["final_utility"], joined).otherwise(hull)

    first = F.col("points")[0]
    start = F.array(F.struct(first["action_cost"].alias("action_cost"), (-first["loss"]).alias("final_utility"), first["action_name"].alias("action_name"), F.lit(None).cast("double").alias("slope"))).cast(kind)
    return rows.select("prompt_id", points.alias("points")).select("prompt_id", F.aggregate(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), start, add).alias("hull"))


def _steps(hulls: DataFrame) -> DataFrame:
    """(prompt_id, place, slope, cost, gain, h): one row for each hull point after the first, with what it adds, and a hash."""
    x = hulls.where(F.size("hull") > 1).select("prompt_id", "hull", F.explode(F.sequence(F.lit(1), F.size("hull") - 1)).alias("place"))
    now, before = F.get(F.col("hull"), F.col("place")), F.get(F.col("hull"), F.col("place") - 1)
    return x.select(
        "prompt_id", "place", now["slope"].alias("slope"), (now["action_cost"] - before["action_cost"]).alias("cost"), (now["final_utility"] - before["final_utility"]).alias("gain"),
        F.xxhash64("prompt_id").cast("double").alias("h"))


def _picked(hulls: DataFrame, taken) -> DataFrame:
    """(prompt_id, action_name, action_cost, final_utility): each prompt's last hull point up to which all steps are taken."""
    kept = F.filter("hull", lambda x: x["slope"].isNull() | taken(x["slope"]))
    return hulls.select("prompt_id", F.element_at(kept, -1).alias("p")).select("prompt_id", "p.action_name", "p.action_cost", "p.final_utility")


def lambda_search(c: DataFrame, budget: float, rounds: int = 24, top: float = 50.0) -> tuple[DataFrame, bool]:
    """Bisects the price of cost in [0, top]: (choices of the last price within the budget, whether there was one).

    The prices that so many rounds can visit are a grid, and spending falls with the price, so the bisection ends at the
    grid's least price within the budget. A step of a prompt's hull is bought while its slope is above the price; steps
    are added up by grid cell, coarse cells first, then those of the one where the budget breaks. Candidates are
    aggregated once; without a feasible price the choices of the highest one tried are given.
    """
    ensure_checkpoints(c.sparkSession)
    hulls = utility_hulls(c).checkpoint()
    cells = 1 << rounds
    step = top / cells
    # a step is bought at the prices step * 1 .. step * cell
    cell = F.least(F.greatest(F.ceil(F.col("slope") / step) - 1, F.lit(0)), F.lit(cells - 1)).cast("long")
    steps = _steps(hulls).select(cell.alias("cell"), "cost").where("cell > 0")
    spent = hulls.agg(F.sum(F.col("hull")[0]["action_cost"])).first()[0] or 0.0
    low, width = 0, cells
    while width > 1:  # the least price index in (low, low + width) from which on spending is within the budget, else the last
        part = max(1, width >> 12)
        sums = steps.where(f"cell >= {low} and cell < {low + width}").groupBy(F.floor((F.col("cell") - low) / part).cast("long").alias("k")).agg(F.sum("cost").alias("cost")).orderBy(F.desc("k")).collect()
        for r in sums:
            if spent + r.cost > budget:
                low, width = low + r.k * part, part
                break
            spent += r.cost
        else:
            width = 0
    # cells above `low` are affordable, cell `low` isn't: the least price is low + 1 if any price below the top is
    best = low + 1 if width else 1
    feasible = best < cells and spent <= budget
    price = step * best if feasible else top
    return _picked(hulls, lambda s: s > price), feasible


#: Steps around the break that are collected, at most, and prompts there that are solved exactly.
AROUND, CORE = 10_000, 24


def _zoom(steps: DataFrame, by: str, room: float, most: int = AROUND) -> tuple[DataFrame, float, float | None, float]:
    """Goes down the column `by` while the steps' costs fit in the room: (steps where it breaks, few or of one value; the
    least value above; the room left there). Sums are over 4,096 equal ranges, which shrink to the one where it breaks."""
    above = None
    while True:
        ends = steps.agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if not ends.n or ends.n <= most or ends.lo == ends.hi:
            return steps, above, room, ends.n
        width = (ends.hi - ends.lo) / 4096
        k = F.least(F.floor((F.col(by) - ends.lo) / width), F.lit(4095)) if width > 0 else F.when(F.col(by) > ends.lo, 1).otherwise(0)
        sums = steps.groupBy(k.alias("k")).agg(F.sum("cost").alias("cost"), F.min(by).alias("lo"), F.max(by).alias("hi")).orderBy(F.desc("k")).collect()
        for r in sums:
            if r.cost > room:
                steps = steps.where((F.col(by) >= r.lo) & (F.col(by) <= r.hi))
                break
            room, above = room - r.cost, r.lo
        else:
            return steps.limit(0), above, room, 0


def global_budget(c: DataFrame, budget: float) -> tuple[DataFrame, dict]:
    """One budget over all prompts, however many: (choices, report).

    Steps of all prompts' hulls are bought by falling slope, as the linear relaxation does, until the first that is too
    dear; where that is, is found by sums over ranges of slopes, and of a hash among steps of one slope. The CORE prompts
    nearest to the break then are solved exactly, all their candidates, with what is left. The report has total_cost,
    total_utility, bound (no choice of actions is worth more) and gap, their difference, and `feasible`: if the cheapest
    actions are too dear, these are the choices. A prompt without a candidate that has cost and utility isn't there.
    """
    ensure_checkpoints(c.sparkSession)
    hulls = utility_hulls(c).checkpoint()
    base = hulls.agg(F.sum(F.col("hull")[0]["action_cost"]).alias("cost"), F.sum(F.col("hull")[0]["final_utility"]).alias("utility")).first()
    cost, utility = base.cost or 0.0, base.utility or 0.0
    if cost > budget:
        return _picked(hulls, lambda s: F.lit(False)), {"total_cost": cost, "total_utility": utility, "bound": utility, "gap": 0.0, "feasible": False}
    steps, room = _steps(hulls), budget - cost
    at, slope_above, room, n = _zoom(steps, "slope", room)
    hash_above, one = None, None
    if n > AROUND:  # many steps of one slope
        one = at.first().slope
        at, hash_above, room, n = _zoom(at, "h", room)
    rows = sorted(at.limit(AROUND).collect(), key=lambda r: (-r.slope, -r.h, str(r.prompt_id)))
    bought, left, broke = [], room, None
    for r in rows:
        if r.cost > left:
            broke = r
            break
        bought.append(r)
        left -= r.cost
    sure = F.lit(False)
    if slope_above is not None:
        sure = sure | (F.col("slope") >= slope_above)
    if hash_above is not None:
        sure = sure | ((F.col("slope") == one) & (F.col("h") >= hash_above))
    # prompts with a step around the break: how far they have come
    count = {}
    for r in bought:
        count[r.prompt_id] = max(count.get(r.prompt_id, 0), r.place)
    kind = dict(hulls.dtypes)["prompt_id"]
    session = c.sparkSession
    levels = session.createDataFrame([(k, v) for k, v in count.items()], f"prompt_id {kind}, reached int")
    core = {}
    at_break = len(bought)
    for i in sorted(range(len(rows)), key=lambda i: abs(i - at_break)):
        if len(core) < CORE:
            core.setdefault(rows[i].prompt_id)
    sure_level = steps.where(sure).groupBy("prompt_id").agg(F.max("place").alias("sure"))
    state = hulls.join(sure_level, "prompt_id", "left").join(F.broadcast(levels), "prompt_id", "left")
    state = state.select("prompt_id", F.get(F.col("hull"), F.greatest(F.coalesce("sure", F.lit(0)), F.coalesce("reached", F.lit(0)))).alias("p")).select("prompt_id", "p.action_name", "p.action_cost", "p.final_utility").checkpoint()
    sums = state.agg(F.sum("action_cost").alias("cost"), F.sum("final_utility").alias("utility")).first()
    total, worth = sums.cost or 0.0, sums.utility or 0.0
    bound = worth + (broke.slope * (budget - total) if broke is not None else 0.0)
    if core and broke is not None:
        mine = session.createDataFrame([(k,) for k in core], f"prompt_id {kind}")
        now = state.join(F.broadcast(mine), "prompt_id").collect()
        options = {}
        for r in c.where("action_cost is not null and final_utility is not null").join(F.broadcast(mine), "prompt_id").select("prompt_id", "action_name", F.col("action_cost").cast("double"), F.col("final_utility").cast("double")).collect():
            options.setdefault(r.prompt_id, []).append((r.action_cost, r.final_utility, r.action_name))
        spare = budget - total + sum(r.action_cost for r in now)
        best = _frontier(options, spare)
        if best and best[1] > sum(r.final_utility for r in now) + 1e-12:
            total, worth = total + best[0] - sum(r.action_cost for r in now), worth + best[1] - sum(r.final_utility for r in now)
            new = session.createDataFrame([(p, n, x, u) for p, (x, u, n) in best[2].items()], "prompt_id " + kind + f", action_name {dict(c.dtypes)['action_name']}, action_cost double, final_utility double")
            state = state.join(F.broadcast(mine), "prompt_id", "left_anti").union(new)
    return state, {"total_cost": total, "total_utility": worth, "bound": max(bound, worth), "gap": max(bound - worth, 0.0), "feasible": True}


def _frontier(options: dict, budget: float, most: int = 20_000):
    """(cost, utility, choices) of the best choice of one option for each of a few prompts within the budget, by merging
    lists of choices that nothing beats; lists above `most` are thinned, which can cost utility but never the budget."""
    states = [(0.0, 0.0, None)]
    for p, rows in options.items():
        merged = sorted(((x + r[0], u + r[1], (back, p, r)) for x, u, back in states for r in rows if x + r[0] <= budget + 1e-9), key=lambda s: (s[0], -s[1]))
        states, top = [], -float("inf")
        for s in merged:
            if s[1] > top:
                states.append(s)
                top = s[1]
        if len(states) > most:
            states = states[:: len(states) // most + 1] + [states[-1]]
    if not states:
        return None
    x, u, back = max(states, key=lambda s: (s[1], -s[0]))
    chosen = {}
    while back is not None:
        back, p, r = back
        chosen[p] = r
    return x, u, chosen


_CHOSEN = "{0} {1}, prompt_id {2}, action_name string, action_cost double, final_utility double, total_cost double, feasible boolean"


def _grouped(c: DataFrame, instance: str, solve) -> DataFrame:
    """Runs solve(rows by prompt, budget) on every instance; rows are (action_name, cost, utility, row number).

    Instances are sorted within partitions and stream through in Arrow batches, so a task holds one instance and many
    small ones share a batch's cost. Rows whose instance or prompt is null are one instance or prompt; rows without a cost
    or utility are left out, and a prompt that has no others isn't in the result; a null budget counts as 0.
    """
    kinds = dict(c.dtypes)
    schema = StructType.fromDDL(_CHOSEN.format(instance, kinds[instance], kinds["prompt_id"]))
    arrow = to_arrow_schema(schema)

    def solved(key, rows):
        prompts: dict[int | str, list[tuple]] = {}
        for i, (p, a, cost, u, _) in enumerate(rows):
            prompts.setdefault(p, []).append((a, cost, u, i))
        picked, total, feasible = solve(prompts, float(rows[0][4]))
        return [(key, *rows[i][:4], float(total), bool(feasible)) for i in picked]

    def run(batches):
        key, rows, done = None, [], []
        for b in batches:
            for k, *row in zip(*(col.to_pylist() for col in b.columns)):
                if rows and k != key:
                    done += solved(key, rows)
                    rows = []
                key = k
                rows.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), arrow.types)], schema=arrow)
                done = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*solved(key, rows)), arrow.types)], schema=arrow)

    x = c.select(instance, "prompt_id", "action_name", F.col("action_cost").cast("double"), F.col("final_utility").cast("double"), F.coalesce(F.col("budget").cast("double"), F.lit(0.0)).alias("budget"))
    x = x.where("action_cost is not null and final_utility is not null")
    return dealt(x, instance).sortWithinPartitions(instance, "prompt_id", "action_cost", "action_name").mapInArrow(run, schema)


def _cheapest(rows: list[tuple]) -> tuple:
    return min(rows, key=lambda r: (r[1], r[0]))


def greedy_upgrade(c: DataFrame, instance: str) -> DataFrame:
    """Cheapest action each, then upgrades by falling gain per cost while the budget lasts. Every upgrade is priced from
    the cheapest action, so upgrading a prompt twice counts both in total_cost."""

    def solve(prompts: dict[int | str, list[tuple]], budget: float):
        at = {p: _cheapest(rows) for p, rows in prompts.items()}
        total = sum(r[1] for r in at.values())
        steps = [
            (-(r[2] - at[p][2]) / (r[1] - at[p][1]), r[1] - at[p][1], str(p), r[0], p, r)
            for p, rows in prompts.items() for r in rows if r[1] > at[p][1] and r[2] > at[p][2]
        ]
        for _, cost, _, _, p, r in sorted(steps, key=lambda x: x[:4]):
            if total + cost <= budget and r[2] > at[p][2]:
                total, at[p] = total + cost, r
        return [r[3] for r in at.values()], total, total <= budget

    return _grouped(c, instance, solve)


def knapsack(c: DataFrame, instance: str, scale: int = 100) -> DataFrame:
    """Exact multiple-choice knapsack: greatest total utility within the budget, then least cost. An infeasible instance
    takes every prompt's cheapest action and says so. A row of the table is as long as the budget, or the dearest choice of
    all; some log2(prompts) rows are held, as the choices are found by computing halves anew."""

    def solve(prompts: dict[int | str, list[tuple]], budget: float):
        names = list(prompts)
        order = {p: sorted(range(len(rows)), key=lambda k: rows[k][0]) for p, rows in prompts.items()}
        spend = {p: [max(0, round(r[1] * scale)) for r in rows] for p, rows in prompts.items()}
        limit = min(max(0, round(budget * scale)), sum(map(max, spend.values())))

        def ahead(best: np.ndarray, lo: int, hi: int) -> np.ndarray:
            for p in names[lo:hi]:
                new = np.full(limit + 1, -np.inf)
                for k in order[p]:
                    cost = spend[p][k]
                    if cost <= limit:
                        np.maximum(new[cost:], best[: limit + 1 - cost] + prompts[p][k][2], out=new[cost:])
                best = new
            return best

        def trace(best: np.ndarray, lo: int, hi: int, left: int) -> int:
            """Picks the options of the prompts from lo to hi that spend `left` after `best`; what was spent before them."""
            if hi - lo > 1:
                mid = (lo + hi) // 2
                return trace(best, lo, mid, trace(ahead(best, lo, mid), mid, hi, left))
            p, pick, top = names[lo], None, -np.inf
            for k in order[p]:
                cost = spend[p][k]
                if cost <= left and best[left - cost] + prompts[p][k][2] > top:
                    pick, top = k, best[left - cost] + prompts[p][k][2]
            out.append(prompts[p][pick][3])
            return left - spend[p][pick]

        start = np.full(limit + 1, -np.inf)
        start[0] = 0.0
        best = ahead(start, 0, len(names))
        if not np.isfinite(best).any():
            pick = [_cheapest(rows) for rows in prompts.values()]
            return [r[3] for r in pick], sum(r[1] for r in pick), False
        out: list[int] = []
        left = int(np.argmax(best))
        trace(start, 0, len(names), left)
        return out, left / scale, True

    return _grouped(c, instance, solve)


def equal_shares(prompts: DataFrame, instance: str, order: str) -> DataFrame:
    """prompts with `share`: budget div n each, and one more for the first budget mod n."""
    w = W.partitionBy(instance)
    n = F.count(F.lit(1)).over(w)
    b = F.col("budget").cast("long")
    share = F.floor(b / n) + (F.row_number().over(w.orderBy(order)) <= b % n).cast("int")
    return prompts.withColumn("share", share)


def smooth_curve(curve: str, strength: float = 0.5):
    """A utility curve shrunk to its mean by `strength`, kept in 0..1 and made to rise, level by level."""
    mean = F.aggregate(curve, F.lit(0.0), lambda a, x: a + x) / F.size(curve)
    shrunk = F.transform(curve, lambda x: F.least(F.greatest((1 - strength) * x + strength * mean, F.lit(0.0)), F.lit(1.0)))
    start = F.array().cast("array<double>")
    return F.aggregate(shrunk, start, lambda a, x: F.concat(a, F.array(F.greatest(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)), x))))


def candidate_rows(wide: DataFrame, key: str, actions: dict[str, tuple[str, str]]) -> DataFrame:
    """Long candidate rows from wide ones, actions given as name: (correct column, cost column), with the 0-based rank
    by (cost, name) and the gain over the cheapest action; a prompt's actions stay in one array, so nothing is shuffled.
    Actions without a cost in a row are left out."""
    item = lambda a, ok, cost: F.when(F.col(cost).isNotNull(), F.struct(F.col(cost).cast("double").alias("action_cost"), F.lit(a).alias("action_name"), F.col(ok).alias("correct")))
    items = F.sort_array(F.array_compact(F.array(*[item(a, ok, cost) for a, (ok, cost) in actions.items()])))
    x = wide.select(key, items.alias("i")).select(key, F.col("i")[0]["correct"].alias("base"), F.posexplode("i").alias("cost_rank", "c"))
    return x.select(F.col(key).alias("prompt_id"), "c.action_name", "c.action_cost", "c.correct", "cost_rank", (F.col("c.correct") - F.col("base")).alias("gain_vs_cheapest"))
