"""The engine's queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.functions import answers as A
from routeloom.functions import consistency as C
from routeloom.functions import text as T
from routeloom.operators import allocation, analysis, learned, outcomes, policies, routing, statistics, sweeps
from routeloom.operators.texts import once_per_text
from routeloom.plans import inputs as I
from routeloom.sources import writers
from routeloom.streaming.metrics import windowed_outcomes

THRESHOLDS = [i / 20 for i in range(21)]
TARGETS = [1 + i / 10 for i in range(11)]
RATIOS = [1.5, 2.0, 3.0, 5.0]
ACTIONS = [f"a{i}" for i in range(1, 8)]


def _routes(o: DataFrame) -> dict:
    return {
        "reasoning_greedy": F.lit(False), "direct_plus_revise": F.lit(True), "unified_rule": routing.escalation(F.col("error"), F.col("confidence")) != "none",
        "confidence_threshold": F.col("confidence") < 0.5, "oracle": (F.col("rg") == 0) & (F.col("dpr") == 1),
    }


def policy_comparison(s, d):
    o = I.outcomes(s, d)
    return outcomes.route_metrics(o, _routes(o), F.col("rg"), F.col("dpr"), ["regime"])


def confidence_sweep(s, d):
    return sweeps.sweep_thresholds(I.outcomes(s, d), F.col("confidence"), F.col("rg"), F.col("dpr"), THRESHOLDS, ["regime"])


def operating_point(s, d):
    return sweeps.operating_point(confidence_sweep(s, d), ["regime"], 1.2)


def budget_curve(s, d):
    return sweeps.budget_curve(I.outcomes(s, d), F.col("dpr") - F.col("rg"), F.col("rg"), TARGETS, ["regime"], "question_id")


def cost_ratio_sensitivity(s, d):
    return sweeps.cost_ratio_sensitivity(policy_comparison(s, d), RATIOS)


def nearest_point(s, d):
    return sweeps.nearest_point(budget_curve(s, d).drop("k"), ["regime"], "avg_cost", [1.14, 1.46])


def outcome_breakdown(s, d):
    o = I.outcomes(s, d).withColumn("g", outcomes.outcome_groups(F.col("rg"), F.col("dpr")))
    counts = [F.count_if(F.col("g") == g).alias(g) for g in ("both", "reasoning_only", "revise_only", "none")]
    return o.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *counts)


def policy_efficiency(s, d):
    p = policy_comparison(s, d)
    base = {k: F.max(F.when(F.col("route") == r, F.col("accuracy"))).over(W.partitionBy("regime")) for k, r in (("rg", "reasoning_greedy"), ("orc", "oracle"))}
    p = p.withColumn("rg", base["rg"]).withColumn("orc", base["orc"])
    gain = F.col("accuracy") - F.col("rg")
    return p.select("regime", "route", gain.alias("gain"), F.try_divide(gain, F.col("avg_cost") - 1).alias("gain_per_cost"), F.try_divide(gain, F.col("orc") - F.col("rg")).alias("recovered"), (F.col("orc") - F.col("accuracy")).alias("oracle_gap"))


def policy_ranking(s, d):
    w = W.partitionBy("regime").orderBy(F.desc("accuracy"), "avg_cost", "route")
    return policy_comparison(s, d).select("regime", "route", F.row_number().over(w).alias("place"))


def escalation_decisions(s, d):
    o = I.outcomes(s, d)
    e = routing.escalation(F.col("error"), F.col("confidence"))
    return o.select("question_id", e.alias("escalation"), F.when(e == "none", "reasoning_greedy").otherwise("direct_plus_revise").alias("action"))


def token_router(s, d):
    o = I.outcomes(s, d)
    low, high = statistics.exact_quantiles(o, "tokens", [0.1, 0.9])
    out = {"low": routing.token_router(F.col("tokens"), low, None), "high": routing.token_router(F.col("tokens"), None, high), "both": routing.token_router(F.col("tokens"), low, high)}
    return outcomes.route_metrics(o, out, F.col("rg"), F.col("dpr"), ["regime"])


def ranked_escalation(s, d):
    o = I.outcomes(s, d)
    r = routing.ranked_escalation(o, "instance", "question_id", F.col("error") + F.col("tokens"), 50.0, F.lit(5), 2)
    return r.select("question_id", "instance", "escalate")


def weighted_signals(s, d):
    l = I.read(s, d, "lineitem")
    sig = {k: F.col("l_partkey") % (i + 3) == 0 for i, k in enumerate(routing.CONSTRAINT_WEIGHTS)}
    score, names = routing.weighted_score(sig, routing.CONSTRAINT_WEIGHTS)
    x = l.select("l_partkey").distinct().select("l_partkey", score.alias("score"), F.size(names).alias("n_signals"))
    return x.withColumn("action", routing.revise_if(F.col("score")))


def question_features(s, d):
    x, parts = T.with_parts(I.read(s, d, "documents").select("doc_id", "text"), "text")
    return x.select("doc_id", *[c.alias(k) for k, c in T.query_features(F.col("text"), parts).items()])


def target_features(s, d):
    x, parts = T.with_parts(I.read(s, d, "documents").select("doc_id", "text"), "text")
    return x.select("doc_id", *[c.alias(k) for k, c in T.target_features(F.col("text"), parts).items()])


def first_pass_features(s, d):
    c = I.read(s, d, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", *[x.alias(k) for k, x in T.first_pass_features(F.col("text")).items()])


def question_hardness(s, d):
    return I.read(s, d, "documents").select("doc_id", F.round(T.hardness_score(F.col("text")), 4).alias("hardness"), F.round(T.difficulty_score(F.col("text")), 6).alias("difficulty"))


def _answer_text(s, d):
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    o = I.read(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("We use "), F.col("o_custkey").cast("string"), F.lit(" of them.\nSo the "), F.when(F.col("o_orderkey") % 2 == 0, "final answer is $").otherwise("sum is "), price, F.lit(".")).alias("text"), price.alias("price"), (F.col("o_orderkey") % 10).alias("k"))


def numeric_answers(s, d):
    return _answer_text(s, d).select("question_id", A.numeric_answer(F.col("text")).alias("answer"))


def choice_answers(s, d):
    letter = F.element_at(F.split(F.lit("A,B,C,D,E,F,G,H,I,J"), ","), (F.col("k") + 1).cast("int"))
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("First (A), then.\nAnswer: ("), letter, F.lit(")"))).when(F.col("k") % 3 == 1, F.concat(F.lit("Not (A) but ("), F.lower(letter), F.lit(") it is"))).otherwise(F.concat(F.lit("so it must be "), letter))
    return _answer_text(s, d).select("question_id", A.choice_letter(text).alias("letter"))


def boolean_answers(s, d):
    text = F.when(F.col("k") % 4 == 0, "Yes.").when(F.col("k") % 4 == 1, "no, it is TRUE").when(F.col("k") % 4 == 2, "that is false").otherwise("nothing here")
    return _answer_text(s, d).select("question_id", A.boolean_answer(text).alias("answer"))


def text_answers(s, d):
    return I.read(s, d, "documents").select("doc_id", A.text_answer(F.col("text")).alias("answer"))


def calibration(s, d):
    t = _answer_text(s, d)
    answer = F.when(F.col("k") < 6, F.col("price")).when(F.col("k") < 8, F.concat(F.col("price"), F.lit(" and 2"))).otherwise("none")
    text = F.concat("text", F.when(F.col("k") % 2 == 0, " 1 2 3 4").otherwise(""))
    return t.select("question_id", *[c.alias(k) for k, c in A.calibration(text, answer).items()])


def majority_vote_first(s, d):
    return outcomes.majority_vote(I.answers(s, d), "question_id", "answer", "position")


def majority_vote_least(s, d):
    return outcomes.majority_vote(I.answers(s, d), "question_id", "answer", "position", keep_empty=False, ties="least")


def oracle_labels(s, d):
    return outcomes.oracle_labels(I.candidates(s, d), "prompt_id")


def best_utility(s, d):
    return outcomes.best_action(I.candidates(s, d), "prompt_id", 20 * F.col("correct") - F.col("cost"))


def pivot_outcomes(s, d):
    return outcomes.pivot_outcomes(I.candidates(s, d), "prompt_id", ACTIONS)


def pairwise_wins(s, d):
    return outcomes.pairwise_wins(pivot_outcomes(s, d), ACTIONS)


def disagreement(s, d):
    return outcomes.disagreement(pivot_outcomes(s, d), ACTIONS)


def label_distribution(s, d):
    return oracle_labels(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("any_correct").alias("n_correct"))


def binary_metrics(s, d):
    o = I.outcomes(s, d)
    truth = ((F.col("rg") == 0) & (F.col("dpr") == 1)).cast("int")
    return outcomes.binary_metrics(o, truth, (F.col("confidence") < 0.4).cast("int"), ["regime"])


def group_feature_rates(s, d):
    o = I.outcomes(s, d)
    f = {"low_confidence": F.col("confidence") < 0.5, "high_error": F.col("error") >= 0.34, "long": F.col("tokens") > 150}
    return outcomes.group_feature_rates(o, outcomes.outcome_groups(F.col("rg"), F.col("dpr")), f, ["both", "reasoning_only", "revise_only", "none", "unknown"])


def signal_firing(s, d):
    o = I.outcomes(s, d)
    return outcomes.signal_firing(o, {"low_confidence": F.col("confidence") < 0.1, "high_error": F.col("error") > 0.9, "never": F.lit(False)}, F.col("rg") == 0)


def stratified_split(s, d):
    o = I.outcomes(s, d)
    return outcomes.stratified_split(o, "question_id", ["regime", "instance"]).select("question_id", "split")


def assembled(s, d):
    c = I.read(s, d, "documents").select("doc_id", "source", "n_chars")
    l = I.read(s, d, "labels").select(F.col("doc_id").alias("k"), "quality")
    j = c.join(l, F.col("doc_id") == F.col("k"), "left")
    return j.select("doc_id", "source", "n_chars", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), F.col("k").isNotNull().alias("oracle_label_available"))


def missed_revise(s, d):
    o = I.outcomes(s, d)
    caught = o.where("confidence < 0.3").select("question_id").union(o.where("error > 0.7").select("question_id"))
    return o.where("rg = 0 and dpr = 1").join(caught, "question_id", "left_anti").select("question_id", "regime")


def regime_union(s, d):
    o = I.outcomes(s, d).select("question_id", "rg", "dpr")
    u = outcomes.union_regimes({"easy": o.where("question_id % 2 = 0"), "hard": o.where("question_id % 2 = 1").drop("dpr")})
    return u.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.sum("rg").alias("rg"), F.sum("dpr").alias("dpr"), F.count_if(F.col("dpr").isNull()).alias("missing"))


def argmax_actions(s, d):
    return allocation.argmax_per_prompt(I.candidates(s, d), 0.01)


def candidate_rows(s, d):
    return allocation.candidate_rows(pivot_outcomes(s, d), "prompt_id", {a: (f"correct_{a}", f"cost_{a}") for a in ACTIONS})


def candidate_utility(s, d):
    c = I.candidates(s, d)
    revise = F.col("action").isin("a3", "a4")
    adj = routing.heuristic_adjustment(F.col("final_utility"), F.col("cost") / 50, F.lit(0.6), F.col("correct") == 1, revise, F.col("action") == "a1")
    u = routing.utility("heuristic_adjusted", F.col("final_utility"), F.col("action_cost"), F.lit(1.0), adj, F.abs(0.5 - F.col("final_utility")), 0.01, 0.1)
    return c.select("prompt_id", "action", F.round(u, 6).alias("utility"))


def _instances(s, d):
    o = I.read(s, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_custkey").alias("instance"))
    return I.candidates(s, d).join(o, "prompt_id").select("instance", "prompt_id", "action_name", "action_cost", "final_utility", F.lit(150.0).alias("budget"))


def greedy_upgrade(s, d):
    return allocation.greedy_upgrade(_instances(s, d), "instance")


def knapsack(s, d):
    return allocation.knapsack(_instances(s, d), "instance", 1)


def lambda_search(s, d):
    c = I.candidates(s, d)
    budget = 12.0 * c.select("prompt_id").distinct().count()
    return allocation.lambda_search(c, budget)[0]


def global_budget(s, d):
    """Choices under one budget over all prompts, with what they cost together and how far from the bound they are at most."""
    c = I.candidates(s, d)
    chosen, report = allocation.global_budget(c, 12.0 * c.select("prompt_id").distinct().count())
    return chosen.select("*", F.lit(report["total_cost"]).alias("total_cost"), F.round(F.lit(report["gap"]), 9).alias("gap"))


def equal_shares(s, d):
    o = I.outcomes(s, d).withColumn("budget", F.lit(37))
    return allocation.equal_shares(o, "instance", "question_id").select("question_id", "share")


def robust_curves(s, d):
    l = I.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    p = F.col("l_partkey")
    x = l.withColumn("curve", F.array(*[(p * k % 101 / 100).cast("double") for k in (3, 7, 11)])).withColumn("r", allocation.smooth_curve("curve"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col("r")[i], 6).alias(f"u{i}") for i in range(3)])


def paired_bootstrap(s, d):
    return statistics.paired_bootstrap(I.outcomes(s, d).withColumn("diff", F.col("dpr") - F.col("rg")), "regime", "question_id", "diff")


def hard_selection(s, d):
    z = statistics.z_blend(I.outcomes(s, d), ["tokens", "error"], [0.7, 0.3])
    return z.select("question_id", F.round("z_score", 6).alias("z_score"))


def class_balance(s, d):
    return writers.class_balance(I.candidates(s, d).withColumn("final_utility", F.round(F.col("final_utility") * 100).cast("long")))


def event_windows(s, d):
    e = I.read(s, d, "events").select("ts", F.col("event_type").alias("action"), (F.col("value") > 50).cast("int").alias("correct"))
    return windowed_outcomes(e)


def _out_of_fold(name):
    def q(s, d):
        o = I.outcomes(s, d).withColumn("label0", ((F.col("rg") == 0) & (F.col("dpr") == 1)).cast("int"))
        return learned.out_of_fold(o, name, "question_id", ["confidence", "error", "tokens"], "label0")

    return q


out_of_fold, learned_tree, learned_forest, learned_bagging, learned_boosting = map(_out_of_fold, ("logistic", "tree", "random_forest", "bagging", "boosting"))


def feature_contrast(s, d):
    return analysis.feature_differences(group_feature_rates(s, d), "revise_only", "both")


def univariate_summary(s, d):
    o = I.outcomes(s, d)
    return analysis.univariate_summary(o, {"tokens": F.col("tokens"), "milli": F.round(F.col("confidence") * 1000)}, outcomes.outcome_groups(F.col("rg"), F.col("dpr")))


def level_distribution(s, d):
    return analysis.level_distribution(I.candidates(s, d).select((F.col("cost") % 5).alias("level")), "level", 7)


def gain_table(s, d):
    o = I.read(s, d, "orders")
    k = [(F.col("o_custkey") % m < r).cast("int") for m, r in ((10, 5), (10, 7), (4, 3))]
    return o.select(F.col("o_orderkey").alias("question_id"), *analysis.gain_table(*k))


def dataset_checks(s, d):
    x = I.read(s, d, "documents").join(stratified_split(s, d).withColumnRenamed("question_id", "doc_id"), "doc_id", "left").select(F.col("source").alias("key"), "doc_id", "split")
    return analysis.dataset_checks(x, "key", ["doc_id", "split"], "split")


def compare_datasets(s, d):
    o = I.outcomes(s, d)
    return analysis.compare_datasets(o.where("question_id % 5 <> 0"), o.where("question_id % 7 <> 0").withColumn("rg", F.when(F.col("question_id") % 2 == 0, F.col("rg"))), "question_id", ["rg", "dpr"])


def token_grid(s, d):
    return analysis.token_grid(I.outcomes(s, d), "tokens", F.col("rg"), F.col("dpr"), [None, 20.0, 60.0], [None, 40.0, 200.0])


def token_grid_choice(s, d):
    return analysis.nearest_rate(token_grid(s, d), 0.3)


def best_gini_split(s, d):
    o = I.outcomes(s, d).withColumn("y", (F.col("dpr") > F.col("rg")).cast("int"))
    return analysis.best_gini_split(o.withColumn("c", F.floor(F.col("confidence") * 100)), ["tokens", "c"], "y")


def budgeted_escalation(s, d):
    o = I.outcomes(s, d)
    r = o.select("instance", "question_id", F.col("tokens").alias("score"), (F.col("tokens") % 3 + 1).alias("want"), F.lit(25).alias("budget"))
    return analysis.budgeted_escalation(r, "instance", "question_id")


def rule_policy(s, d):
    o = I.read(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n, w, multi, failed, out = k % 6, c % 90, k % 3 == 0, c % 4 == 0, c % 7
    a = routing.rule_policy(n, w, multi, failed | (k % 5 == 0), failed, out, strong=True)
    return o.select(k.alias("question_id"), routing.first_action(n, w, multi).alias("first"), a.alias("action"))


def _struct(df: DataFrame, name: str, drop: tuple = ()) -> DataFrame:
    """question_id and the fields of a struct, arrays joined to text."""
    kept = [f for f in df.schema[name].dataType if f.name not in drop]
    text = lambda f: F.array_join(F.col(name)[f.name], "|") if f.dataType.typeName() == "array" else F.col(name)[f.name]
    return df.select("question_id", *[text(f).alias(f.name) for f in kept])


def question_profiles(s, d):
    w = I.word_problems(s, d)
    return _struct(w.select("question_id", F.struct(*[c.alias(k) for k, c in C.question_profile(F.col("q")).items()]).alias("p")), "p")


def constraint_flags(s, d):
    w = I.word_problems(s, d).withColumn("answer", F.lit(None).cast("string"))
    return _struct(C.with_constraints(w, "q", "t", "answer"), "constraint", ("profile", "parsed_answer"))


def number_records(s, d):
    w = once_per_text(I.word_problems(s, d).select("question_id", "q"), ["q"], lambda x: C.with_roles(x, "q"))
    # outer, as Spark would else ask for the size of the roles where they are made, and make them twice
    r = w.select("question_id", F.posexplode_outer("roles").alias("position", "r")).where("position is not null")
    return r.select("question_id", "position", *[F.col("r")[k].alias(k) for k in ("surface", "value", "source", "sentence_index", "context", "unit", "role", "confidence", "required", "strong", "target_relation")])


def _of_problems(s, d, add):
    """Word problems with what `add` makes of their distinct texts and the answers in these."""
    return once_per_text(I.word_problems(s, d), ["q", "t"], lambda x: add(x.withColumn("answer", A.numeric_answer(F.col("t")))))


def role_coverage(s, d):
    return _struct(_of_problems(s, d, lambda x: C.with_role_coverage(x, "q", "t", "answer").select("q", "t", "role")), "role")


def role_cue_counts(s, d):
    w = I.word_problems(s, d)
    return w.select("question_id", C.local_role(F.col("q")).alias("role"), *[F.size(c).alias(f"n_{k}") for k, c in C.role_cues(F.col("q")).items()], F.size(C.number_words(F.col("q"))).alias("n_words"))


def self_verification(s, d):
    w = I.word_problems(s, d)
    return w.select("question_id", *[c.alias(k) for k, c in C.self_verification(F.col("t"), F.lit(None).cast("string")).items()])


def selective_prediction(s, d):
    w = I.word_problems(s, d).withColumn("answer", A.numeric_answer(F.col("t"))).withColumn("passes", F.array("answer", F.lit(""), F.when(F.col("question_id") % 3 == 0, "7").otherwise(F.col("answer"))))
    return w.select("question_id", *[c.alias(k) for k, c in C.selective_prediction(F.col("t"), F.col("answer"), F.col("passes")).items()])


def step_verification(s, d):
    return _struct(C.with_steps(I.word_problems(s, d), "q", "t"), "step")


def unified_error(s, d):
    scores = {"error": F.round("unified_error_score", 6), "confidence": F.round("unified_confidence_score", 6)}
    x = _of_problems(s, d, lambda x: C.with_unified_error(x, "q", "t", "answer").select("q", "t", *[c.alias(k) for k, c in scores.items()]))
    return x.select("question_id", *scores)


def violation_signals(s, d):
    w = policies.violation_policies(I.word_problems(s, d), "q", "t")
    return w.select("question_id", "violation.*", "violation_action", "violation_score", "weighted_action")


def constraint_and_role_policies(s, d):
    columns = ("constraint_score", "constraint_action", "role_decision", "role_action", "unified_decision", "unified_action")
    return _of_problems(s, d, lambda x: policies.role_policies(x, "q", "t", "answer").select("q", "t", *columns)).select("question_id", *columns)


def answer_error_policies(s, d):
    w = once_per_text(I.word_problems(s, d), ["q", "t"], lambda x: policies.answer_error_policies(x, "q", "t"))
    return w.select("question_id", "parsed", "categorical", "explanation_warning_score", "answer_error_score", F.array_join("answer_error_signals", "|").alias("signals"), "trust", "revise_reason", "answer_error_action", "late_error_score", "late_revise_reason", "late_action")


def candidate_consistency(s, d):
    w = I.word_problems(s, d).withColumn("answer", A.numeric_answer(F.col("t")))
    return w.select("question_id", *[c.alias(k) for k, c in policies.candidate_consistency(F.col("q"), F.col("answer")).items()])


def math_answers(s, d):
    t = _answer_text(s, d)
    wrapped = F.when(F.col("k") < 3, F.concat(F.lit("So \\boxed{"), "price", F.lit("}."))).when(F.col("k") < 6, F.concat(F.lit("Thus the answer is $"), "price", F.lit("$"))).otherwise(F.concat(F.lit("Sum\n"), "price"))
    return t.select("question_id", A.math_answer(wrapped).alias("answer"))


NAMES = [
    "policy_comparison", "confidence_sweep", "operating_point", "budget_curve", "cost_ratio_sensitivity", "nearest_point", "outcome_breakdown", "policy_efficiency", "policy_ranking",
    "escalation_decisions", "token_router", "ranked_escalation", "weighted_signals", "question_features", "target_features", "first_pass_features", "question_hardness", "numeric_answers",
    "choice_answers", "boolean_answers", "text_answers", "calibration", "majority_vote_first", "majority_vote_least", "oracle_labels", "best_utility", "pivot_outcomes", "pairwise_wins",
    "disagreement", "label_distribution", "binary_metrics", "group_feature_rates", "signal_firing", "stratified_split", "assembled", "missed_revise", "regime_union", "argmax_actions",
    "candidate_rows", "candidate_utility", "greedy_upgrade", "knapsack", "lambda_search", "global_budget", "equal_shares", "robust_curves", "paired_bootstrap", "hard_selection", "class_balance",
    "event_windows", "out_of_fold", "learned_tree", "learned_forest", "learned_bagging", "learned_boosting",
    "feature_contrast", "univariate_summary", "level_distribution", "gain_table", "dataset_checks", "compare_datasets", "token_grid", "token_grid_choice", "best_gini_split", "budgeted_escalation", "rule_policy",
    "question_profiles", "constraint_flags", "number_records", "role_coverage", "role_cue_counts", "self_verification", "selective_prediction", "step_verification", "unified_error",
    "violation_signals", "constraint_and_role_policies", "answer_error_policies", "candidate_consistency", "math_answers",
]
QUERIES = {n: globals()[n] for n in NAMES}
