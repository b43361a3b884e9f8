"""Matching, candidates, simulated allocation, statistics and learned scores against literal or brute-force versions."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from routeloom.functions import matching
from routeloom.functions import text as T
from routeloom.operators import allocation, candidates, learned, simulated, statistics
from routeloom.sources import readers


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_option_letter(spark):
    cases = {
        r"so \boxed{\text c}": "C", "Answer: b\nor (D)": "B", "final answer. D": "D", "(a) or (B)": "A", "text\nb.\n": "B", "  ": "", None: "", "nothing here": "", "We choose xyz, rules": "C",
        r"(A) then \boxed{D}": "D", "answer: because": "A", "C\nzzz\nzzz": "C", "B\nz\nz\nz\nz\nz\n" + "z" * 80: "",
    }
    assert column(spark, list(cases), matching.option_letter) == list(cases.values())


def test_matches(spark):
    rows = [("1,234.50", "$1234.5.", True), ("7", "007", True), ("-0", "0", False), ("1", "", False), ("abc", "ABC", True), ("1", None, False), (".5", "0.50", True), ("+3", "3", True), ("10", "100", False)]
    d = spark.createDataFrame(rows, "g string, p string, w boolean")
    assert all(r.m == r.w for r in d.select("w", matching.answers_match(F.col("g"), F.col("p"), "numeric").alias("m")).collect())
    m = spark.createDataFrame([("A", " a ", True), ("A", "B", False), ("", "", False), ("AB", "AB", False)], "g string, p string, w boolean")
    assert all(r.m == r.w for r in m.select("w", matching.answers_match(F.col("g"), F.col("p"), "mcq").alias("m")).collect())
    f = spark.createDataFrame([(r"\frac{1}{2}", r"$\dfrac{1}{2}$", True), ("", "", False), ("x", "y", False)], "g string, p string, w boolean")
    assert all(r.m == r.w for r in f.select("w", matching.answers_match(F.col("g"), F.col("p"), "math").alias("m")).collect())
    e = spark.createDataFrame([(" Yes\t", "yes", True), ("a", "b", False), (None, "", True)], "g string, p string, w boolean")
    assert all(r.m == r.w for r in e.select("w", matching.exact_match(F.col("g"), F.col("p")).alias("m")).collect())
    with pytest.raises(ValueError):
        matching.answers_match(F.col("g"), F.col("p"), "other")


def test_output_signals(spark):
    texts = ["1 and 2", "5 then 5.0", "no number", None, "9 " + "z" * 400 + " 4"]
    assert column(spark, texts, matching.tail_disagreement) == [True, False, False, False, False]
    assert column(spark, ["Final answer: 4\nso 5", "Final answer: 4\n4.0", ""], matching.final_mismatch) == [True, False, False]
    assert column(spark, ["Quota reached", "RATE LIMIT", "no permission", None], matching.access_error) == ["quota", "rate_limit", "model_access", "unknown"]
    assert column(spark, ["How many are Left?", "a box holds", "paper", "twice", ""], matching.pattern_bucket) == ["remaining_target", "capacity_ceiling", "rate_total", "ratio_transform", "other"]
    c = spark.createDataFrame([(True, False, 0, False), (False, True, 9, True)], "p boolean, u boolean, n int, m boolean").select(matching.first_confidence(F.col("p"), F.col("u"), F.col("n"), F.col("m")).alias("c")).collect()
    assert [round(r.c, 6) for r in c] == [1.0, round(0.25 * 0.55 * 0.15 * 0.4, 6)]


def test_cues_by_look_up_are_those_of_the_patterns(spark):
    rng = random.Random(4)
    words = ["left", "Over", "LEFTOVER", "in", "all", "total", "how", "much", "more", "than", "a", "piece", "per", "day", "gave", "away", "use", "up", "as", "well", "ſold", "top", "of", "on", "plus", "éleft", "left_", "cents", "combined", "with", "eac̈h", "less", "fewer", "KelvinKeep", "İn"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "-", ", ", ". "]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    x, p = T.with_parts(d, "t")
    flags = [(T.has_cue(p["text"], p["words"], w) == T.has_word(p["text"], w)).alias(k) for k, w in T.WORDS.items() if k != "uncertainty"]
    assert all(all(r) for r in x.select(*flags).collect())
    verbs = x.select((F.size(F.array_intersect(p["words"], F.array(*map(F.lit, T.WORDS["operation"].split("|"))))) > 0).alias("a"), T.has_word(p["text"], T.WORDS["operation"]).alias("b")).collect()
    assert all(r.a == r.b for r in verbs)


def test_string_prompt_ids(spark):
    rows = [("i", f"gsm8k_test_{p}", a, c, u, 3.0) for p in range(3) for a, c, u in (("x", 1.0, 0.1 * p), ("y", 2.0, 0.5))]
    c = spark.createDataFrame(rows, "instance string, prompt_id string, action_name string, action_cost double, final_utility double, budget double")
    for f in (allocation.greedy_upgrade, lambda d, i: allocation.knapsack(d, i, 1)):
        assert sorted(r.prompt_id for r in f(c, "instance").collect()) == [f"gsm8k_test_{p}" for p in range(3)]


def test_bootstrap_of_any_difference(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.choice([0.5, -0.25, 0.0], 300).tolist(), "b": [None, float("nan")], "c": [0.0] * 5, "d": rng.standard_normal(200).tolist()}
    d = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "g string, i int, v double")
    got = {r.g: r for r in statistics.paired_bootstrap(d, "g", "i", "v").collect()}
    for k in ("a", "d"):
        x = np.array(values[k])
        means = x[rng.integers(0, len(x), (10_000, len(x)))].mean(1)
        assert got[k].n == len(x) and abs(got[k].mean_diff - x.mean()) < 1e-12
        assert abs(got[k].ci_low - np.percentile(means, 2.5)) < 0.02 and abs(got[k].ci_high - np.percentile(means, 97.5)) < 0.02
    assert got["b"].n == 0 and got["b"].mean_diff is None and got["c"].p_value == 1.0 and not got["c"].significant


def test_regime_comparisons(spark):
    rows = [("r", i, int(i % 3 == 0), int(i % 2 == 0), i % 2 == 0, i % 5 == 0) for i in range(300)]
    d = spark.createDataFrame(rows, "regime string, q int, rg int, dpr int, v6 boolean, v7 boolean")
    got = {r.comparison: r for r in statistics.regime_comparisons(d, "regime", "rg", "dpr", ["v6", "v7"], draws=500).collect()}
    rg, dpr = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    v6 = np.where([r[4] for r in rows], dpr, rg)
    assert len(got) == 4 and abs(got["adaptive_best_policy_vs_always_reasoning"].mean_diff - (v6 - rg).mean()) < 1e-12
    assert abs(got["oracle_vs_always_reasoning"].mean_diff - (np.maximum(rg, dpr) - rg).mean()) < 1e-12 and abs(got["always_revise_vs_always_reasoning"].mean_diff - (dpr - rg).mean()) < 1e-12


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 9, 500).astype(float), rng.standard_normal(2000) * 1e6, np.array([3.0]), np.repeat([1.0, 1.0 + 2**-52], 50), np.append(rng.random(300), 1e12)):
        d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        assert np.allclose(statistics.exact_quantiles(d, "v", [0, 0.1, 0.5, 0.9, 1], bins=16), np.quantile(x, [0, 0.1, 0.5, 0.9, 1]), rtol=1e-15, atol=0)
    assert statistics.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_numbered_and_questions(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"p{i}.jsonl").write_text("".join(json.dumps({"question": f"{i}-{k}", "answer": f"x #### {k},000"}) + "\n" for k in range(3)))
    got = readers.questions(spark, str(tmp_path), multi_line=False, dataset="gsm8k").collect()
    assert [r.ord for r in got] == list(range(12)) and {r.id for r in got} == {f"gsm8k_test_{k}" for k in range(12)} and all(r.answer.endswith("000") for r in got)
    raw = ["['a', \"it's\", 'c\\'d']", "[]", "nonsense", None, '["x", "y"]', "['open"]
    assert column(spark, raw, readers.choices) == [["a", "it's", "c'd"], [], [], [], ["x", "y"], []]
    up = spark.createDataFrame([("q1", None, "1"), (None, "q2", "2"), ("q3", "", None)], "Question string, prompt string, ANSWER string")
    assert sorted((r.question, r.answer) for r in readers.normalized_rows(up, "up").collect()) == [("q1", "1"), ("q2", "2")]


def test_equal_levels_is_literal(spark):
    rng = random.Random(7)
    costs, rows = [1, 2, 2, 5], []
    for i in range(30):
        budget = rng.randint(0, 22)
        rows += [(i, q, sorted(rng.randint(0, 10) / 10 for _ in costs) if rng.random() < 0.7 else [rng.random() for _ in costs], budget) for q in range(rng.randint(1, 5))]
    got = {(r.i, r.q): r.level for r in simulated.equal_levels(spark.createDataFrame(rows, "i int, q int, curve array<double>, budget int"), "i", "q", costs).collect()}
    for i in range(30):
        own = [r for r in rows if r[0] == i]
        n, budget = len(own), own[0][3]
        if n > budget:
            assert all(got[i, r[1]] == -1 for r in own)
            continue
        levels = [max(k for k, c in enumerate(costs) if c <= budget // n)] * n
        left = budget - n * costs[levels[0]]
        while True:
            steps = [(own[q][2][k + 1] - own[q][2][k], -(costs[k + 1] - costs[k]), -q) for q, k in enumerate(levels) if k + 1 < len(costs) and 0 < costs[k + 1] - costs[k] <= left]
            if not steps or max(steps)[0] <= 0:
                break
            _, extra, q = max(steps)
            levels[-q] += 1
            left += extra
        assert [got[i, r[1]] for r in own] == levels
    with pytest.raises(ValueError):
        simulated.equal_levels(spark.createDataFrame(rows, "i int, q int, curve array<double>, budget int"), "i", "q", [2, 1])


def test_sweeps_and_noise(spark):
    q = spark.range(12).select(F.col("id").alias("q"), (F.col("id") % 2).alias("i"))
    for family in ("monotone", "concave", "mixed_difficulty"):
        rows = simulated.curves(q, "q", 4, family).collect()
        assert all(len(r.curve) == 4 and list(r.curve) == sorted(r.curve) and 0 <= r.curve[0] and r.curve[-1] <= 1 for r in rows)
        if family == "concave":
            assert all(np.diff(r.curve)[0] >= np.diff(r.curve)[-1] - 1e-12 for r in rows)
    many = simulated.curves(spark.range(4000).withColumnRenamed("id", "q"), "q", 3).groupBy("difficulty").count().collect()
    assert {r.difficulty: round(r["count"] / 4000, 1) for r in many} in ({"easy": 0.3, "medium": 0.4, "hard": 0.2}, {"easy": 0.4, "medium": 0.4, "hard": 0.2}, {"easy": 0.4, "medium": 0.4, "hard": 0.3}, {"easy": 0.3, "medium": 0.4, "hard": 0.3})
    t = simulated.curves(q, "q", 4)
    same = simulated.noisy(t, "q", 0.0).collect()
    assert all(np.allclose(r.curve, r.estimate) for r in same)
    moved = [r.estimate for r in simulated.noisy(simulated.curves(spark.range(3000).withColumnRenamed("id", "q"), "q", 2).withColumn("curve", F.array(F.lit(0.5), F.lit(0.5))), "q", 0.1, monotone=False).collect()]
    assert abs(np.mean(moved) - 0.5) < 0.01 and abs(np.std(moved) - 0.1) < 0.01
    gaps = simulated.comparison(simulated.budget_sweep(t, "i", "q", [0, 1, 2, 3], [3, 9]), ["i", "budget"]).collect()
    assert len(gaps) == 4 and all(r.gap > -1e-9 for r in gaps)
    noise = simulated.noise_sweep(t.withColumn("budget", F.lit(8)), "i", "q", [0, 1, 2, 3], {"none": 0.0, "high": 0.3}).collect()
    assert len(noise) == 8 and all(r.degradation == 0 for r in noise if r.noise_name == "none") and all(r.degradation >= -1e-9 for r in noise if r.allocator == "mckp")
    with pytest.raises(ValueError):
        simulated.allocate("other", t, "i", "q", [0, 1, 2, 3])


def test_candidate_helpers(spark):
    with pytest.raises(ValueError):
        candidates.apply_families(spark.range(1).toDF("prompt_id"), ["nonsense"])
    rows = spark.createDataFrame([("p", "a", "r1"), ("p", "b", None)], "k string, t string, regime string")
    assert candidates.keep_rows(rows, ["r1"]).count() == 1 and candidates.keep_rows(rows).count() == 2
    texts = candidates.first_text(spark.createDataFrame([("x", " ")], "k string, t string"), "k", "t", spark.createDataFrame([("x", "second"), ("y", "only")], "k string, t string"))
    assert {r.k: r.text for r in texts.collect()} == {"x": "second", "y": "only"}
    empty = rows.limit(0).selectExpr("k AS prompt_id", "t AS action_name", "0 AS correct", "0.0 AS action_cost", "0.0 AS final_utility")
    a = candidates.chosen_actions(empty, empty)[0].first()
    assert (a.num_prompts, a.final_accuracy) == (0, 0.0)
    s = spark.createDataFrame([(1, True, True, False, 0.2, 1.5, 0.8), (2, True, True, True, 0.3, 1.6, 0.8), (3, True, True, True, 0.3, 1.5, 0.7)], "id int, matches_or_beats_reasoning_greedy boolean, uses_less_cost_than_always_revise boolean, nontrivial_selectivity boolean, distance_to_oracle double, avg_cost double, accuracy double")
    assert candidates.best_setting(s).first().id == 3


def test_calibration_thresholds_and_search(spark):
    rng = np.random.default_rng(3)
    p = rng.random(800)
    y = (rng.random(800) < p**2).astype(int)
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p.round(2), y)], "score double, label int")
    iso = learned.Calibrator("isotonic").fit(d, "score", "label").transform(d, "score").select("score", "calibrated").distinct().orderBy("score").collect()
    values = [r.calibrated for r in iso]
    assert values == sorted(values) and abs(np.mean([(v - r.score**2) ** 2 for v, r in zip(values, iso)])) < 0.02
    sig = learned.Calibrator("sigmoid").fit(d, "score", "label").transform(d, "score").agg(F.avg("calibrated")).first()[0]
    assert abs(sig - y.mean()) < 0.05
    assert learned.Calibrator().transform(spark.createDataFrame([(1.5,), (-1.0,)], "score double"), "score").agg(F.sum("calibrated")).first()[0] == 1.0
    with pytest.raises(ValueError):
        learned.Calibrator("other")
    best = max(learned.THRESHOLDS, key=lambda t: (((p.round(2) >= t) == y).mean(), -t))
    assert learned.best_threshold(d, "score", "label") == best
    v = VectorAssembler(inputCols=["score"], outputCol="features").transform(d.withColumn("label", F.col("label").cast("double")))
    model, settings, results = learned.grid_search(v, v, lambda maxDepth: learned.DecisionTreeClassifier(maxDepth=maxDepth, seed=1), {"maxDepth": [1, 3]})
    assert model is not None and len(results) == 2 and settings["maxDepth"] == max(results, key=lambda r: r["score"])["maxDepth"]


def test_boosted_stumps(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, 2))
    y = ((x[:, 0] > 0.4) & (x[:, 1] > 0.3)).astype(float)
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double"))
    m = learned.Boosted(rounds=6, rate=1.0).fit(d)
    got = m.transform(d).select("label", "probability_1").collect()
    assert len(m.stumps) >= 2 and np.mean([(r.probability_1 >= 0.5) == r.label for r in got]) > 0.93


def test_constant_and_holdout(spark):
    d = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 2) for i in range(300)], "k int, regime string, label int")
    s = {r.k: r.split for r in learned.holdout(d, "k", "b").collect()}
    assert all(s[i] == "test" for i in range(0, 300, 3)) and 20 < sum(v == "validation" for v in s.values()) < 60
    c = learned.constant_score(d, d.limit(1), "label").first()
    assert c.probability == 0.5 and c.majority == 0
    empty = learned.constant_score(d.limit(0), d.limit(1), "label").first()
    assert empty.probability == 0.5 and empty.majority is None
