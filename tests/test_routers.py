"""Hulls and global budgets, running sums, boosting, neural and multi-class routers against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import answers
from routeloom.operators import allocation, analysis, boosting, candidates, features, matrix, multiclass, neural, outcomes, policies, prefix, simulated, statistics


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- boxed answers


def last_box(text):
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return ""
    depth, out = 1, ""
    for ch in text[at + 7 :]:
        depth += (ch == "{") - (ch == "}")
        if not depth:
            return out.strip()
        out += ch
    return ""


def test_boxed_at_any_depth(spark):
    rng = random.Random(3)
    texts = [None, "", r"\boxed{", r"\boxed{}", r"\boxed{ {a} {b{c{d{e}}}} } then }", r"\boxed{1} and \boxed{2", r"\boxed{x}\boxed{ y }", "{}}{", r"\boxed {1}", r"\boxed{" * 40 + "x" + "}" * 40, r"\boxed{" + "{" * 500 + "7" + "}" * 501, "\\boxed{\n\t é \u3000}"]
    texts += ["".join(rng.choice(["{", "}", "\\boxed{", "a", " "]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts.append("\\boxed{" + "{ab}" * 50_000 + "}")
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in d.select("i", answers.boxed(F.col("t")).alias("x")).collect()}
    assert all(got[i] == last_box(t) for i, t in enumerate(texts))


# ---------------------------------------------------------------- allocation

C = "prompt_id string, action_name string, action_cost double, final_utility double"


def literal_bisection(rows, budget, rounds=24, top=50.0):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    pick = lambda lam: {p: max(x, key=lambda r: (r[3] - lam * r[2], -r[2], r[1])) for p, x in by.items()}
    lo, hi, best = 0.0, top, None
    for _ in range(rounds):
        mid = (lo + hi) / 2
        if sum(r[2] for r in pick(mid).values()) <= budget:
            best, hi = mid, mid
        else:
            lo = mid
    return {p: r[1] for p, r in pick(hi if best is None else best).items()}, best is not None


def random_candidates(rng, prompts, most=6):
    return [(f"p{p}", f"a{a}", float(rng.randint(0, 12)), rng.randint(0, 40) / 40 + rng.random() * 1e-3) for p in range(prompts) for a in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed", range(4))
def test_lambda_search_is_the_bisection(spark, seed):
    rng = random.Random(seed)
    rows = random_candidates(rng, 60)
    rows += [("q", "a", 2.0, 0.5), ("q", "b", 2.0, 0.5), ("r", "a", 1.0, 0.9), ("r", "b", 3.0, 0.1)]
    c = spark.createDataFrame([*rows, ("q", "n", None, 9.0), ("q", "m", 1.0, None)], C)
    for budget in (0.0, 100.0, 180.0, 260.0, 400.0, 10_000.0):
        chosen, feasible = allocation.lambda_search(c, budget)
        assert ({r.prompt_id: r.action_name for r in chosen.collect()}, feasible) == literal_bisection(rows, budget)


def test_lambda_search_scans_once(spark):
    c = spark.createDataFrame(random_candidates(random.Random(9), 20), C)
    assert plan_of(allocation.utility_hulls(c)).count("Exchange hashpartitioning") == 1


def best_total(rows, budget):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    states = {0.0: 0.0}
    for x in by.values():
        new = {}
        for cost, u in states.items():
            for r in x:
                if cost + r[2] <= budget and u + r[3] > new.get(cost + r[2], -1):
                    new[cost + r[2]] = u + r[3]
        states = new
    return max(states.values(), default=None)


@pytest.mark.parametrize("seed", range(3))
def test_global_budget_gap(spark, seed):
    rng = random.Random(seed)
    rows = random_candidates(rng, 40)
    c = spark.createDataFrame(rows, C)
    cost = {(r[0], r[1]): r for r in rows}
    for budget in (60.0, 130.0, 200.0, 1000.0):
        chosen, report = allocation.global_budget(c, budget)
        got = [cost[r.prompt_id, r.action_name] for r in chosen.collect()]
        best = best_total(rows, budget)
        if best is None:
            assert not report["feasible"] and len(got) == 40
            continue
        assert len(got) == 40 and len({r[0] for r in got}) == 40 and sum(r[2] for r in got) <= budget + 1e-9
        assert abs(sum(r[2] for r in got) - report["total_cost"]) < 1e-9 and abs(sum(r[3] for r in got) - report["total_utility"]) < 1e-9
        assert report["total_utility"] <= best + 1e-9 <= report["bound"] + 2e-9 and best - report["total_utility"] <= report["gap"] + 1e-9
        assert report["gap"] < 0.3


def test_global_budget_of_many_equal_steps(spark):
    """More steps of one slope than are collected: the hash of the prompt parts them."""
    c = spark.range(30_000).selectExpr("explode(array(struct(id AS prompt_id, 'a' AS action_name, 1.0D AS action_cost, 0.1D AS final_utility), struct(id AS prompt_id, 'b' AS action_name, 2.0D AS action_cost, 0.6D AS final_utility))) AS r").select("r.*")
    chosen, report = allocation.global_budget(c, 47_000.0)
    n = {r.action_name: r["count"] for r in chosen.groupBy("action_name").count().collect()}
    assert n == {"a": 13_000, "b": 17_000} and report["gap"] < 1e-9 and report["total_cost"] == 47_000


def test_instances_with_nulls(spark):
    rows = [("i", None, "a", 1.0, 0.1), ("i", None, "b", 2.0, 0.9), ("i", "p", "a", 1.0, 0.2), ("i", "p", "z", None, 5.0), ("i", "o", "z", 1.0, None), (None, "p", "a", 1.0, 0.2)]
    c = spark.createDataFrame([(*r, 3.0 if r[0] else None) for r in rows], "instance string, prompt_id string, action_name string, action_cost double, final_utility double, budget double")
    for solve in (allocation.greedy_upgrade, allocation.knapsack):
        got = {(r.instance, r.prompt_id): (r.action_name, r.feasible) for r in solve(c, "instance").collect()}
        assert got == {("i", None): ("b", True), ("i", "p"): ("a", True), (None, "p"): ("a", False)}
    curves = spark.createDataFrame([("i", 1, [0.1, 0.9], None)], "i string, k int, curve array<double>, budget int")
    assert [r.level for r in simulated.equal_levels(curves, "i", "k", [1, 2]).collect()] == [-1]


def test_knapsack_of_many_prompts(spark):
    """The choices of the plain table, ties included."""
    rng = random.Random(4)
    rows = [(p, f"a{a}", float(rng.randint(0, 5)), rng.randint(0, 8) / 8) for p in range(90) for a in range(3)]
    c = spark.createDataFrame([("i", *r, 150.0) for r in rows], "instance string, prompt_id int, action_name string, action_cost double, final_utility double, budget double")
    got = {r.prompt_id: r.action_name for r in allocation.knapsack(c, "instance", 1).collect()}
    best, took = np.full(151, -np.inf), []
    best[0] = 0
    for p in range(90):
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1]))
        new, who = np.full(151, -np.inf), [None] * 151
        for r in sorted(mine, key=lambda r: r[1]):
            for x in range(int(r[2]), 151):
                if best[x - int(r[2])] + r[3] > new[x]:
                    new[x], who[x] = best[x - int(r[2])] + r[3], r
        best = new
        took.append(who)
    left, want = int(np.argmax(best)), {}
    for p in reversed(range(90)):
        want[p] = took[p][left][1]
        left -= int(took[p][left][2])
    assert got == want


def test_overrides_and_runners_up(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "k int, g string, case_key int")
    cases = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "k int, g string")
    assert sorted(map(repr, candidates.with_override(rows, cases, "k", "g").collect())) == sorted(["Row(k=1, g='y', case_key=0)", "Row(k=2, g='b', case_key=0)", "Row(k=None, g='c', case_key=0)"])
    runs = spark.createDataFrame([("r", n, a, o) for n, a, o in (("m", 0.5, 2), ("n", 0.5, 1), ("o", 0.1, 0))] + [("s", "m", 0.3, 1)], "by string, name string, accuracy double, o int")
    got = {r["by"]: tuple(r)[1:] for r in candidates.runner_up(runs, "by", "name", "o").collect()}
    assert got == {"r": ("n", 0.5, "m", 0.5, 0.0), "s": ("m", 0.3, None, None, None)}
    assert "collect_list" not in plan_of(candidates.runner_up(runs, "by", "name", "o"))


# ---------------------------------------------------------------- running sums, quantiles, bootstrap


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), i, rng.randint(-3, 9)) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, v int, range_ int").repartition(7)
    got = prefix.running(d, ["g"], ["v"], {"s": "range_"}, ("next", "v"))
    assert got.columns == ["g", "v", "range_", "s", "next"]
    want, last = {}, {}
    for g, v, x in sorted(rows, key=lambda r: r[1]):
        want[g] = want.get(g, []) + [[v, x, (want[g][-1][2] if g in want else 0) + x, None]]
        if len(want[g]) > 1:
            want[g][-2][3] = v
    assert sorted(map(repr, ((r.g, r.v, r.range_, r.s, r["next"]) for r in got.collect()))) == sorted(repr((g, *x)) for g, xs in want.items() for x in xs)
    assert prefix.running(d.limit(0), ["g"], ["v"], {"s": "range_"}).count() == 0


def test_gini_split_of_a_continuous_feature(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(4000)
    y = ((x > 0.4) ^ (rng.random(4000) < 0.2)).astype(int)
    d = spark.createDataFrame([(float(a), int(b), None if i % 50 else 1.0) for i, (a, b) in enumerate(zip(x, y))] + [(None, 1, 2.0), (float("nan"), 0, 1.0)], "x double, y int, z double")
    r = analysis.best_gini_split(d, ["z", "x"], "y").first()
    order = np.argsort(x)
    s, t = x[order], y[order]
    n, p = np.arange(1, 4000), np.cumsum(t)[:-1]
    part = lambda n, p: n - (p * p + (n - p) ** 2) / n
    impurity = (part(n, p) + part(4000 - n, t.sum() - p)) / 4000
    k = int(impurity.round(12).argmin())
    assert r.feature == "x" and abs(r.threshold - (s[k] + s[k + 1]) / 2) < 1e-12 and abs(r.impurity - impurity[k]) < 1e-9
    assert "SinglePartition" not in plan_of(analysis.best_gini_split(d, ["x"], "y")).replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "", 1)


def test_split_of_one_stratum(spark):
    d = spark.range(2000).selectExpr("id", "'s' AS s", "1 AS place_", "2 AS hash_")
    got = outcomes.stratified_split(d, "id", ["s"])
    assert got.columns == [*d.columns, "split"] and Counter(r.split for r in got.collect()) == {"train": 1400, "validation": 300, "test": 300}
    small = spark.createDataFrame([(i, k) for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10), (None, 3)) for i in range(n)], "i int, k string")
    by = Counter((r.k, r.split) for r in outcomes.stratified_split(small, "i", ["k"]).collect())
    assert by == {("a", "train"): 1, ("b", "train"): 1, ("b", "test"): 1, ("c", "train"): 2, ("c", "validation"): 1, ("d", "train"): 7, ("d", "validation"): 1, ("d", "test"): 2, (None, "train"): 2, (None, "validation"): 1}


def test_quantiles_with_infinities(spark):
    x = [float("-inf")] * 3 + [1e308, -1e308, 5e-324, 0.0, 2.0, 2.0, 7.5] + [float("inf")] * 2
    d = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "v double")
    for q in range(12):
        assert statistics.exact_quantiles(d, "v", [q / 11], bins=4) == [sorted(x)[q]]
    assert statistics.exact_quantiles(d, "v", [q / 11 for q in range(12)], bins=4) == sorted(x)


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal(3000) + 0.02
    rows = [("g", float(v)) for v in x] + [(None, float(v)) for v in x[:1500]] + [("few", 1.0), ("few", 0.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in statistics.paired_bootstrap(d.repartition(5), "g", "g", "v", draws=2000, distinct=500).collect()}
    again = {r.g: r for r in statistics.paired_bootstrap(d.repartition(2), "g", "g", "v", draws=2000, distinct=500).collect()}
    assert set(got) == {"g", None, "few"} and got["few"].n == 2
    for g, v in (("g", x), (None, x[:1500])):
        error = v.std() / math.sqrt(len(v))
        assert got[g].n == len(v) and abs(got[g].mean_diff - v.mean()) < 1e-12
        assert abs(got[g].ci_low - (v.mean() - 1.96 * error)) < 0.15 * error and abs(got[g].ci_high - (v.mean() + 1.96 * error)) < 0.15 * error
        assert abs(got[g].ci_low - again[g].ci_low) < 1e-9 and got[g].p_value == again[g].p_value


# ---------------------------------------------------------------- learned routers


def plain_boost(x, y, cuts, rounds, rate):
    w, out = np.ones(len(y)) / len(y), []
    for _ in range(rounds):
        best = None
        for f, ts in enumerate(cuts):
            for t in ts:
                low = x[:, f] <= t
                sides = [np.array([w[m & (y == k)].sum() for k in (0, 1)]) for m in (low, ~low)]
                impurity = sum(s.sum() - (s * s).sum() / s.sum() for s in sides if s.sum() > 0)
                if best is None or impurity < best[0] - 1e-12:
                    said = np.where(low, int(sides[0][1] > sides[0][0]), int(sides[1][1] > sides[1][0]))
                    best = (impurity, f, t, said)
        wrong = w[best[3] != y].sum()
        if wrong >= 0.5:
            break
        alpha = rate * math.log((1 - wrong) / wrong) if wrong > 0 else 1.0
        out.append((best[1], best[2], alpha))
        if wrong <= 0:
            break
        w = w * np.exp(alpha * (best[3] != y))
        w /= w.sum()
    return out


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)).round(1)
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.6) ^ (rng.random(n) < 0.05)).astype(int)
    return x, y


def test_histogram_boost(spark):
    x, y = labelled(1500, 3)
    d = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, c double, label int").repartition(4)
    model = boosting.HistogramBoost(["a", "b", "c"], rounds=30, rate=0.5, bins=16).fit(d)
    want = plain_boost(x, y, model.cuts, 30, 0.5)
    assert [("abc".index(s.feature), s.threshold) for s in model.stumps] == [w[:2] for w in want] and np.allclose([s.alpha for s in model.stumps], [w[2] for w in want])
    tx, ty = labelled(1500, 4)
    t = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(tx, ty)], "a double, b double, c double, label int")
    right = model.transform(t).agg(F.avg(((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.8
    odd = spark.createDataFrame([(None, 1.0, 0.0), (float("nan"), 1.0, 0.0)], "a double, b double, c double")
    assert len({r.probability for r in model.transform(odd).collect()}) == 1
    one = d.where("label = 1")
    assert boosting.HistogramBoost(["a"], rounds=3).fit(d.limit(0)).stumps == [] and len(boosting.HistogramBoost(["a"], rounds=3).fit(one).stumps) == 1


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    x, y, w = rng.standard_normal((20, 3)), rng.integers(0, 2, 20).astype(float), rng.random(20) + 0.5
    params = neural.initial([3, 5, 4, 1], 2)
    _, grads = neural.loss_and_gradient(params, x, y, w, 1.7, 0.6)
    for p, g in zip(params, grads):
        for at in itertools.islice(np.ndindex(p.shape), 12):
            old, step = p[at], 1e-6
            p[at] = old + step
            up = neural.loss_and_gradient(params, x, y, w, 1.7, 0.6)[0]
            p[at] = old - step
            down = neural.loss_and_gradient(params, x, y, w, 1.7, 0.6)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_neural_router(spark, tmp_path):
    x, y = labelled(1200, 5)
    rows = [(i, *map(float, r), int(k), 1.0 + i % 3) for i, (r, k) in enumerate(zip(x, y))] + [(9001, None, float("nan"), 0.0, 1, None), (9002, 0.0, 0.0, 0.0, None, 1.0)]
    d = spark.createDataFrame(rows, "i int, a double, b double, c double, label int, w double")
    fit = lambda parts, **more: neural.NeuralRouter(["a", "b", "c"], hidden=(16, 8), steps=40, rate=0.05, **more).fit(d.repartition(parts), weight="w")
    model, again = fit(3), fit(8)
    got = {r.i: r.probability for r in model.transform(d).collect()}
    assert all(abs(got[r.i] - r.probability) < 1e-6 for r in again.transform(d).collect())
    assert model.losses[-1] < 0.7 * model.losses[0]
    tx, ty = labelled(1000, 6)
    t = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(tx, ty)], "a double, b double, c double, label int")
    share = lambda m, c: m.transform(t).agg(F.avg(c)).first()[0]
    assert share(model, ((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("double")) > 0.85
    assert share(fit(4, cost=4.0), F.col("probability")) < share(model, F.col("probability")) - 0.02  # needless revisions cost
    model.save(spark, f"{tmp_path}/model")
    loaded = neural.NeuralRouter.load(spark, f"{tmp_path}/model")
    assert {r.i: r.probability for r in loaded.transform(d).collect()} == got
    routed = neural.decide(spark.createDataFrame([(0.7,), (0.2,), (None,)], "probability double"), 0.5, "cheap", "dear")
    assert [r.action for r in routed.collect()] == ["dear", "cheap", "cheap"]
    assert neural.NeuralRouter(["a"]).fit(d.where("label = 1")).transform(t).first().probability == 1.0
    assert neural.NeuralRouter(["a"]).fit(d.limit(0)).transform(t).first().probability == 0.5


def test_class_report(spark):
    rng = random.Random(8)
    pairs = [(rng.choice("aabc"), rng.choice("abcd")) for _ in range(300)] + [("b", None), (None, "a")]
    got = {(r.label, r.kind): r for r in multiclass.class_report(spark.createDataFrame(pairs, "t string, p string"), "t", "p").collect()}
    known = [x for x in pairs if x[0] is not None]
    f1s = {}
    for c in "abcd":
        hit, said, is_ = sum(t == p == c for t, p in known), sum(p == c for _, p in known), sum(t == c for t, _ in known)
        r = got[c, "class"]
        f1s[c] = (2 * hit / (said + is_), is_)
        assert abs(r.precision - hit / said) < 1e-12 and abs(r.recall - (hit / is_ if is_ else 0)) < 1e-12 and abs(r.f1 - f1s[c][0]) < 1e-12 and r.support == is_
    assert abs(got[None, "macro"].f1 - sum(f for f, _ in f1s.values()) / 4) < 1e-12
    assert abs(got[None, "weighted"].f1 - sum(f * n for f, n in f1s.values()) / len(known)) < 1e-12
    assert abs(got[None, "accuracy"].recall - sum(t == p for t, p in known) / len(known)) < 1e-12
    assert multiclass.class_report(spark.createDataFrame([], "t string, p string"), "t", "p").count() == 0


@pytest.mark.parametrize("name", sorted(multiclass.MODELS))
def test_multiclass_models(spark, name):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((360, 2))
    y = np.where(x[:, 0] > 0.5, "up", np.where(x[:, 1] > 0, "left", "right"))
    rows = [(i, float(a), float(b), str(k)) for i, ((a, b), k) in enumerate(zip(x, y))] + [(999, 0.0, 0.0, None)]
    d = spark.createDataFrame(rows, "i int, a double, b double, k string")
    make = (lambda: multiclass.MODELS[name](3)) if name == "boosting" else None
    got = multiclass.out_of_fold(d, name, "i", ["a", "b"], "k", make=make).collect()
    assert len(got) == 360 and sum(r.truth == r.predicted for r in got) > 0.8 * 360
    if name == "tree":
        few = multiclass.out_of_fold(d.where("k = 'up'"), name, "i", ["a", "b"], "k").collect()
        assert {r.predicted for r in few} == {"up"} and multiclass.out_of_fold(d.limit(0), name, "i", ["a"], "k").count() == 0


def test_setting_sweep(spark):
    rng = random.Random(12)
    names = list(policies.VIOLATION_WEIGHTS)
    rows = [(*[rng.choice([True, False, False, None]) for _ in names], rng.randint(0, 1), rng.randint(0, 1)) for _ in range(500)]
    d = spark.createDataFrame(rows, ", ".join(f"{k} boolean" for k in names) + ", rg int, dpr int").select(F.struct(*names).alias("v"), "rg", "dpr")
    settings = [{"setting": f"s{i}", "threshold": rng.randint(0, 6), **{k: rng.randint(0, 3) for k in names if rng.random() < 0.7}} for i in range(7)]
    got = {r.setting: r for r in policies.setting_sweep(d, "v", F.col("rg"), F.col("dpr"), settings).collect()}
    for x in settings:
        revised = [sum(x.get(k, 0) * bool(b) for k, b in zip(names, r)) >= x["threshold"] for r in rows]
        right = sum(r[-1] if on else r[-2] for r, on in zip(rows, revised))
        r = got[x["setting"]]
        assert r.n == 500 and r.revise_trigger_count == sum(revised) and abs(r.accuracy - right / 500) < 1e-12 and abs(r.avg_cost - 1 - sum(revised) / 500) < 1e-12
        assert abs(r.distance_to_oracle - (right - sum(max(r[-2:]) for r in rows)) / 500) < 1e-12 and r.nontrivial_selectivity == (0 < sum(revised) < 500)
        assert r.matches_or_beats_reasoning_greedy == (right >= sum(r[-2] for r in rows)) and r.uses_less_cost_than_always_revise == (sum(revised) < 500)
    none = policies.setting_sweep(d.limit(0), "v", F.col("rg"), F.col("dpr"), settings[:2]).collect()
    assert [(r.n, r.accuracy) for r in none] == [(0, None)] * 2


def test_policy_regret(spark):
    d = spark.createDataFrame([(1, 1, 1.0, 0, 2.0, "x"), (2, 0, 1.0, 1, 2.0, "y"), (3, None, None, 1, 2.0, "x")], "q int, correct_x int, cost_x double, correct_y int, cost_y double, pick string")
    got = {r.policy: r for r in multiclass.policy_regret(d, {"pick": F.col("pick"), "y": F.lit("y")}, ["x", "y"], [0.1]).collect()}
    assert (got["pick"].n, got["pick"].mean_accuracy, got["pick"].mean_regret_accuracy) == (2, 1.0, 0.0)
    assert got["y"].n == 3 and abs(got["y"].mean_regret_accuracy - 1 / 3) < 1e-12 and abs(got["y"].mean_regret_utility_0 - (0.9 + 0.2) / 3) < 1e-9


def test_checkers_of_candidates(spark):
    rows = [("Ann has 9 apples and gave away 4. How many apples are left?", "5"), ("Ann has 9 apples and gave away 4. How many apples are left?", "9"), ("How many boxes?", "2.5"), ("How many boxes?", None), (None, "3"), ("How much is it?", "12000000")]
    d = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "q string, a string, id int, role string")
    got = policies.with_checkers(d, "q", "a")
    assert got.columns == [*d.columns, "checkers"]
    by = {r.id: r.checkers for r in got.collect()}
    assert all(r.role == "x" for r in got.collect())
    assert by[1].plain.flagged and by[2].plain.signals == ["non_integer_count"] and by[3].plain.signals == ["numeric_type_mismatch"]
    for c in by.values():
        assert all(x.flagged == bool(x.signals) and set(c.plain.signals) <= set(x.signals) for x in (c.role, c.calibrated, c.unified))
    assert "missing_required_number" in by[0].role.signals  # an answer alone uses none of the question's numbers
    x = spark.createDataFrame([(1, True), (1, False), (0, True), (0, None), (0, False), (None, True)], "ok int, flag boolean")
    r = policies.signal_tradeoff(x, {"f": F.col("flag"), "never": F.lit(False)}, F.col("ok"))
    by = {r.variant: tuple(r)[1:] for r in r.collect()}
    assert by["f"] == (1 / 3, 0.5, 1 / 3 - 0.5, (1 / 3 + 0.5) / 2, 2) and by["never"] == (0.0, 0.0, 0.0, 0.5, 0)


def test_feature_matrix(spark, tmp_path):
    rows = [("r1", "b", "1.5", 2, True), ("r2", "a", "nan", None, False), (None, "b", "x", 5, True), ("r1", None, "inf", 1, None), ("r1", "a", "4", 2, True)]
    d = spark.createDataFrame(rows, "regime string, action_name string, feat_z string, hfeat_a int, feat_b boolean").withColumn("other", F.lit(1))
    model = matrix.FeatureMatrix().fit(d)
    assert model.medians == {"feat_b": 0.0, "feat_z": 2.75, "hfeat_a": 2.0} and model.values == {"regime": ["", "r1", "r2"], "action_name": ["", "a", "b"]}
    assert model.names == ["feat_b", "feat_z", "hfeat_a", "cat_regime__", "cat_regime__r1", "cat_regime__r2", "cat_action__", "cat_action__a", "cat_action__b"]
    got = [list(r.features) for r in model.transform(d).collect()]
    assert got[0] == [0, 1.5, 2, 0, 1, 0, 0, 0, 1] and got[1] == [0, 2.75, 0, 0, 0, 1, 0, 1, 0] and got[2] == [0, 0, 5, 1, 0, 0, 0, 0, 1] and got[3] == [0, 2.75, 1, 0, 1, 0, 1, 0, 0]
    model.save(f"{tmp_path}/model")
    loaded = matrix.FeatureMatrixModel.load(f"{tmp_path}/model")
    assert loaded.names == model.names and [list(r.features) for r in loaded.transform(d).collect()] == got
    new = spark.createDataFrame([("r9", "c", "7", 1)], "regime string, action_name string, feat_z string, feat_new int")
    assert list(loaded.transform(new).first().features) == [0, 7, 2, 0, 0, 0, 0, 0, 0]  # unseen values, a missing column
    est = matrix.FeatureMatrix(prefixes=["feat_"], categories=["regime"], outputCol="x")
    est.save(f"{tmp_path}/estimator")
    assert matrix.FeatureMatrix.load(f"{tmp_path}/estimator").fit(d).names == ["feat_b", "feat_z", "cat_regime__", "cat_regime__r1", "cat_regime__r2"]
    none = matrix.FeatureMatrix().fit(d.limit(0))
    assert none.values == {"regime": [], "action_name": []} and none.transform(d).first().features.size == 3
    t = spark.createDataFrame([(1, 0.5, 2.0), (0, -1.0, None)], "correct int, gain_vs_cheapest double, action_cost double")
    assert [[r[0] for r in t.select(matrix.targets(k, price=0.25)).collect()] for k in ("success", "gain", "utility")] == [[1, 0], [1, 0], [0.5, 0.0]]


def test_numeric_features(spark):
    rows = [(1, "Ann has 9 apples and gave away 4. How many apples are left?", "She had 9 and gave 4 away, so 9 - 4 = 5.\nFinal answer: 5", "5"), (2, None, None, None), (3, "What is 50% of $8?", "Maybe 4, not sure", "4")]
    d = spark.createDataFrame(rows, "id int, q string, t string, a string").withColumn("role", F.lit("x"))
    got = {r.id: r.asDict() for r in features.numeric_features(d, "id", "q", "t", "a").collect()}
    names = [k for k in got[1] if k != "id"]
    starts = ("q_", "tq_", "cons_", "role_", "calibrated_", "self_", "cal_", "step_", "fp_", "unified_", "v6_", "v7_")
    assert all(k.startswith(starts) for k in names) and all(any(k.startswith(x) for k in names) for x in starts) and len(names) >= 60
    assert all(isinstance(v, float) for r in got.values() for k, v in r.items() if k != "id")
    one = got[1]
    assert one["q_num_numeric_mentions"] == 2 and one["tq_asks_remaining_or_left"] == 1 and one["fp_first_pass_parse_success"] == 1 and one["step_presence_of_equation_like_patterns"] == 1
    assert got[2]["q_question_length_chars"] == 0 and got[2]["fp_first_pass_empty_or_malformed_flag"] == 1 and got[3]["q_has_percent_symbol"] == 1 and got[3]["fp_first_pass_has_uncertainty_phrase"] == 1
    for k in ("v6", "v7"):
        assert one[f"{k}_revise_recommended"] in (0, 1) and one[f"{k}_answer_error_score"] >= 0
