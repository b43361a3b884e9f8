"""Candidate actions: feature families, chosen actions and their results, changes against a baseline, label ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.operators.outcomes import ratio
from routeloom.operators.prefix import unused


def field(rows: DataFrame, name: str, default: float = 0.0) -> Column:
    """A column as double; the default where the table lacks it or a row has null."""
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in rows.columns else F.lit(default)


def prompt_features(rows: DataFrame) -> DataFrame:
    q = F.coalesce(F.col("question"), F.lit("")) if "question" in rows.columns else F.lit("")
    flag = lambda c: c.cast("double")
    return rows.withColumns({
        "hfeat_prompt_length_chars": F.length(q).cast("double"),
        "hfeat_prompt_length_tokens": F.size(F.filter(F.split(q, r"(?U)\s+"), lambda x: x != "")).cast("double"),
        "hfeat_prompt_num_count": F.regexp_count(q, F.lit(r"-?[0-9]+(?:\.[0-9]+)?")).cast("double"),
        "hfeat_prompt_has_question_mark": flag(F.contains(q, F.lit("?"))), "hfeat_prompt_has_percent": flag(F.contains(q, F.lit("%"))),
        "hfeat_prompt_unified_confidence": field(rows, "feat_unified_confidence_score"), "hfeat_prompt_error_score": field(rows, "feat_unified_error_score"),
    })


def action_features(rows: DataFrame) -> DataFrame:
    """Kind of the action by its name, and its cost's rank in the prompt, from 0."""
    a = F.lower(F.col("action_name"))
    rank = F.row_number().over(W.partitionBy("prompt_id").orderBy("action_cost", "action_name")) - 1
    has = lambda part: F.contains(a, F.lit(part)).cast("double")
    return rows.withColumns({"hfeat_action_is_revise": has("revise"), "hfeat_action_is_reasoning": has("reasoning"), "hfeat_action_is_direct": has("direct"), "hfeat_action_cost_rank": rank.cast("double")})


def interaction_features(rows: DataFrame) -> DataFrame:
    complexity = field(rows, "hfeat_prompt_length_tokens") / 50.0 + field(rows, "hfeat_prompt_num_count") / 5.0
    return rows.withColumns({
        "hfeat_interaction_complexity_x_revise": complexity * field(rows, "hfeat_action_is_revise"),
        "hfeat_interaction_parse_risk_x_direct": (1.0 - field(rows, "feat_fp_first_pass_parse_success", 1.0)) * field(rows, "hfeat_action_is_direct"),
        "hfeat_interaction_confidence_x_reasoning": field(rows, "hfeat_prompt_unified_confidence") * field(rows, "hfeat_action_is_reasoning"),
    })


def heuristic_features(rows: DataFrame) -> DataFrame:
    risk, revise = 1.0 - field(rows, "feat_fp_first_pass_parse_success", 1.0), field(rows, "hfeat_action_is_revise")
    return rows.withColumns({
        "hfeat_heuristic_revise_favorable": ((risk > 0.3) & (revise > 0.5)).cast("double"),
        "hfeat_heuristic_cheap_safe": ((field(rows, "hfeat_prompt_unified_confidence") > 0.75) & (revise < 0.5)).cast("double"),
        "hfeat_heuristic_parse_risk": risk, "hfeat_heuristic_ambiguity_risk": field(rows, "feat_cons_constraint_word_conflict_suspected"),
    })


def risk_features(rows: DataFrame) -> DataFrame:
    failed, hedging, warning = 1.0 - field(rows, "feat_fp_first_pass_parse_success", 1.0), field(rows, "feat_self_contains_hedging_language"), field(rows, "feat_role_warning_score")
    error = field(rows, "hfeat_prompt_error_score" if "hfeat_prompt_error_score" in rows.columns else "feat_unified_error_score")
    composite = 0.4 * failed + 0.3 * hedging + 0.3 * F.least(F.lit(1.0), error + warning)
    return rows.withColumns({"hfeat_risk_parse_failure": failed, "hfeat_risk_hedging": hedging, "hfeat_risk_warning": warning, "hfeat_risk_composite": composite})


FAMILIES = {
    "prompt_features": prompt_features, "action_features": action_features, "interaction_features": interaction_features,
    "heuristic_features": heuristic_features, "risk_features": risk_features,
}


def apply_families(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named feature families in order; an unknown name raises ValueError."""
    for n in names:
        if n not in FAMILIES:
            raise ValueError(f"unknown feature family {n}")
        rows = rows.transform(FAMILIES[n])
    return rows


def dominated(gain: Column, rank: Column) -> Column:
    """Whether an action that isn't the cheapest gains nothing over it. It reads the labels, as its gain does."""
    return (gain <= 0) & (rank > 0)


def chosen_actions(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(averages, distribution) of the candidate rows that `chosen` (prompt_id, action_name) names: num_prompts,
    final_accuracy, average_cost, average_utility in one row, zeros if none is found; and (action_name, n)."""
    found = rows.join(chosen.select("prompt_id", "action_name"), ["prompt_id", "action_name"])
    n = F.count(F.lit(1))
    mean = lambda c: ratio(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)), n)
    averages = found.agg(n.alias("num_prompts"), mean("correct").alias("final_accuracy"), mean("action_cost").alias("average_cost"), mean("final_utility").alias("average_utility"))
    return averages, found.groupBy("action_name").agg(n.alias("n"))


def simple_baselines(rows: DataFrame) -> DataFrame:
    """(baseline, n, accuracy, avg_cost): the cheapest action of each prompt, the dearest, and the cheapest that is right.
    Ties by name: the first for the cheapest, the last for the others. One aggregation by prompt."""
    s = lambda *key: F.struct(*key, F.col("correct").alias("ok"), F.col("action_cost").alias("spent"))
    g = rows.groupBy("prompt_id").agg(
        F.min(s("action_cost", "action_name")).alias("cheapest_only"), F.max(s("action_cost", "action_name")).alias("always_expensive"),
        F.max(s("correct", (-F.col("action_cost")).alias("less"), F.col("action_name"))).alias("oracle_upper_bound"))
    long = g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), F.col(k)["ok"].alias("ok"), F.col(k)["spent"].alias("spent")) for k in ("cheapest_only", "always_expensive", "oracle_upper_bound")])).alias("b"))
    n = F.count(F.lit(1))
    return long.groupBy("b.baseline").agg(n.alias("n"), ratio(F.sum("b.ok"), n).alias("accuracy"), ratio(F.sum("b.spent"), n).alias("avg_cost"))


def change_attribution(baseline: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row of counts: improved and worsened questions of target against baseline, and each change's cause - another
    normalisation with one sample, the second sample for gating alone, escalation beyond it, or none of these.

    baseline has `correct`; target has `correct`, `normalized`, `samples`, `gated` and `escalated`."""
    j = target.alias("t").join(baseline.select(key, F.col("correct").alias("before")), key).where(F.col("t.correct") != F.col("before"))
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    first, second, third = true("normalized") & (F.col("samples") == 1), true("gated") & ~true("escalated"), true("escalated")
    cause = F.when(first, "normalization_only").when(second, "gating_stage_only").when(third, "true_post_ranking_escalation").otherwise("unattributed")
    j = j.select(F.col("t.correct").alias("now"), cause.alias("cause"))
    counts = [F.count_if(F.col("cause") == c).alias(c) for c in ("normalization_only", "gating_stage_only", "true_post_ranking_escalation", "unattributed")]
    return j.agg(F.count_if(F.col("now") == 1).alias("queries_improved"), F.count_if(F.col("now") == 0).alias("queries_worsened"), *counts)


def label_ties(wide: DataFrame, actions: list[str], price: float) -> list[Column]:
    """accuracy_tie and utility_tie of a wide row: whether several of its actions share the greatest correctness, or the
    greatest correctness less price times cost (to 1e-12). Actions that the row lacks don't count."""
    has = F.array_compact(F.array(*[F.when(F.col(f"correct_{a}").isNotNull(), F.struct(F.col(f"correct_{a}").cast("double").alias("c"), (F.col(f"correct_{a}") - F.lit(price) * F.col(f"cost_{a}")).alias("u"))) for a in actions]))
    c, u = F.transform(has, lambda x: x["c"]), F.transform(has, lambda x: x["u"])
    return [(F.size(F.filter(c, lambda x: x == F.array_max(c))) > 1).alias("accuracy_tie"), (F.size(F.filter(u, lambda x: F.abs(x - F.array_max(u)) < 1e-12)) > 1).alias("utility_tie")]


def extended_group(direct: Column, revise: Column, any_correct: Column, other: Column) -> Column:
    """Five outcome groups of a question; revise may be null (unknown)."""
    return (
        F.when(direct == 1, "direct_already_enough").when(revise == 1, "revise_helps").when(other == 1, "unique_other_strategy_case")
        .when(any_correct == 0, "revise_not_enough").otherwise("reasoning_enough")
    )


def with_override(rows: DataFrame, overrides: DataFrame, key: str, group: str) -> DataFrame:
    """rows with `group` replaced where the case table (key, group) names the key. A key with several cases gets the greatest."""
    k, v = unused(rows.columns, "case_key"), unused(rows.columns, "case_group")
    o = overrides.groupBy(F.col(key).alias(k)).agg(F.max(group).alias(v))
    return rows.join(o, F.col(key) == F.col(k), "left").withColumn(group, F.coalesce(v, group)).drop(k, v)


def first_text(rows: DataFrame, key: str, text: str, *others: DataFrame) -> DataFrame:
    """(key, text): each key's first text that isn't blank, over the tables in order of priority."""
    every = [t.select(key, F.col(text).alias("text"), F.lit(i).alias("at")) for i, t in enumerate((rows, *others))]
    u = every[0]
    for e in every[1:]:
        u = u.union(e)
    return u.where("trim(text) <> ''").groupBy(key).agg(F.min_by("text", F.struct("at", "text")).alias("text"))


def keep_rows(rows: DataFrame, regimes: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """Rows of the listed regimes and splits; None or an empty list keeps all."""
    if regimes:
        rows = rows.where(F.col("regime").isin(regimes))
    return rows.where(F.col("split").isin(splits)) if splits else rows


# Thresholds of the routers over answer-error and explanation-warning scores.
ROUTER_THRESHOLDS = {"explanation_warning": 3, "answer_error": 2, "combined_equal": 3, "answer_error_dominant": 4, "explanation_dominant": 4}


def score_routers(error: Column, warning: Column) -> dict[str, Column]:
    """Five routers over the two scores, each alone or weighed against the other."""
    t = ROUTER_THRESHOLDS
    return {
        "explanation_only_router": warning >= t["explanation_warning"], "answer_error_only_router": error >= t["answer_error"], "combined_equal_router": error + warning >= t["combined_equal"],
        "answer_error_dominant_router": 2 * error + warning >= t["answer_error_dominant"], "explanation_dominant_router": error + 2 * warning >= t["explanation_dominant"],
    }


def routing_errors(rows: DataFrame, routes: dict[str, Column], cheap: Column, dear: Column, by: list[str]) -> DataFrame:
    """(by, route, false_positives, false_negatives): revised although the cheap route is right and revising doesn't
    help, and not revised although it does."""
    helps = (cheap == 0) & (dear == 1)
    flags = F.array(*[F.struct(F.lit(k).alias("route"), v.alias("revise")) for k, v in routes.items()])
    long = rows.select(*by, (cheap == 1).alias("__right"), helps.alias("__helps"), F.explode(flags).alias("r"))
    return long.groupBy(*by, "r.route").agg(F.count_if(F.col("r.revise") & F.col("__right") & ~F.col("__helps")).alias("false_positives"), F.count_if(~F.col("r.revise") & F.col("__helps")).alias("false_negatives"))


def best_route(rows: DataFrame, by: list[str], routes: list[str]) -> DataFrame:
    """Of the listed routes, each group's most accurate, then cheapest, then first by name."""
    pick = F.min(F.struct((-F.col("accuracy")).alias("a"), F.col("avg_cost").alias("c"), F.col("route").alias("r")))
    g = rows.where(F.col("route").isin(routes)).groupBy(*by).agg(pick.alias("b"))
    return g.select(*by, F.col("b.r").alias("route"), (-F.col("b.a")).alias("accuracy"), F.col("b.c").alias("avg_cost"))


def best_setting(sweep: DataFrame) -> DataFrame:
    """The sweep row that matches the cheap baseline, costs less than always revising, is selective, is nearest to the
    oracle, cheapest and most accurate, in that order."""
    keys = [F.col(c).cast("int").desc() for c in ("matches_or_beats_reasoning_greedy", "uses_less_cost_than_always_revise", "nontrivial_selectivity")]
    return sweep.orderBy(*keys, "distance_to_oracle", "avg_cost", F.desc("accuracy")).limit(1)


def runner_up(runs: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """(by, best, best_accuracy, runner_up, runner_up_accuracy, gap): the two most accurate runs of each group, ties by
    `order`, then by name. Each task passes on two rows a group at most, and a group's two are one row in the end."""
    w = W.partitionBy(by).orderBy(F.desc("accuracy"), order, name)
    ranked = runs.select(F.col(by), F.col(name).alias("n"), F.col("accuracy").alias("a"), F.row_number().over(w).alias("at")).where("at <= 2")
    one, two = (F.max(F.when(F.col("at") == k, F.struct("n", "a"))) for k in (1, 2))
    g = ranked.groupBy(by).agg(one.alias("one"), two.alias("two"))
    return g.select(by, F.col("one.n").alias("best"), F.col("one.a").alias("best_accuracy"), F.col("two.n").alias("runner_up"), F.col("two.a").alias("runner_up_accuracy"), (F.col("one.a") - F.col("two.a")).alias("gap"))


TARGET_TYPES = ("asks_rate_or_unit", "asks_remaining_or_left", "asks_difference", "asks_total", "asks_money", "asks_time")


def target_type(features: dict[str, Column]) -> Column:
    """What a question asks for, the first of TARGET_TYPES that holds, else other."""
    out = F.lit("other")
    for name in reversed(TARGET_TYPES):
        out = F.when(features[name], name.removeprefix("asks_")).otherwise(out)
    return out


def derived_features(f: dict[str, Column]) -> dict[str, Column]:
    """15 derived features from flags and scores by their names (question, target, output, constraint and score columns)."""
    any_of = lambda *names: sum((f[n].cast("int") for n in names), F.lit(0)) > 0
    return {
        "prompt_number_count": f["num_numeric_mentions"].cast("double"), "prompt_token_length": f["question_length_tokens_approx"].cast("double"), "target_quantity_type": target_type(f),
        "multi_stepness_proxy": f["has_multi_operation_hint"], "explicit_constraint_presence": any_of("has_subtraction_trap_verb", "has_addition_trap_structure"),
        "relational_wording_presence": any_of("asks_difference", "asks_remaining_or_left"), "special_structure_presence": any_of("has_percent_symbol", "has_fraction_pattern", "asks_rate_or_unit", "asks_time"),
        "final_answer_parseable": f["first_pass_parse_success"], "body_final_numeric_mismatch": f["extra_answer_error"] > 0, "target_quantity_mismatch": f["target_quantity_mismatch_suspected"],
        "constraint_violation_signal": any_of("answer_type_mismatch_suspected", "unit_mismatch_suspected", "impossible_sign_suspected", "integer_expected_but_noninteger_suspected", "constraint_word_conflict_suspected", "bound_violation_suspected"),
        "copied_question_number_as_final_answer": f["potential_answer_echo_risk"], "cheap_route_confidence": f["final_answer_confident"],
        "explanation_warning_signal": f["explanation_warning_score"] > 0, "answer_error_signal": f["answer_error_score"] > 0,
    }


def derived_outcomes(rg: Column, dpr: Column, would_revise: Column, policies: list[tuple[str, Column, Column]] = ()) -> dict[str, Column]:
    """Outcome flags, and the best method: the most accurate, then cheapest, then first of reasoning, revising and the
    given (name, correct, cost) policies; policies with null results don't count."""
    options = [("reasoning_greedy", rg, F.lit(1.0)), ("direct_plus_revise", dpr, F.lit(2.0)), *policies]
    s = F.array_compact(F.array(*[F.when(c.isNotNull() & cost.isNotNull(), F.struct((-c.cast("int")).alias("c"), cost.cast("double").alias("p"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, c, cost) in enumerate(options)]))
    return {
        "revise_helpful": ((rg == 0) & (dpr == 1)).cast("int"), "safe_cheap": (rg == 1).cast("int"), "both_wrong": ((rg == 0) & (dpr == 0)).cast("int"),
        "unnecessary_revise_candidate": ((rg == 1) & would_revise).cast("int"), "method_best_label": F.array_min(s)["n"],
    }


def rates_by(rows: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """(by, n, rate_<flag>): share of rows whose flag is 1, to four places."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(ratio(F.count_if(F.col(c) == 1), F.count(F.lit(1))), 4).alias(f"rate_{c}") for c in flags])


def means_by(rows: DataFrame, by: str, features: list[str]) -> DataFrame:
    """(by, n, mean_<feature>) to four places, without rows whose `by` is null or empty; nulls and NaN don't count."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return rows.where(F.col(by).cast("string") != "").groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.coalesce(F.avg(value(c)), F.lit(0.0)), 4).alias(f"mean_{c}") for c in features])


def top_separating(differences: DataFrame, n: int, least: float) -> DataFrame:
    """The n rows of greatest absolute difference, of at least `least`; ties by feature."""
    d = F.abs("difference")
    return differences.where(d >= least).orderBy(d.desc(), "feature").limit(n)


def false_positive_counts(rows: DataFrame) -> DataFrame:
    """(kind, name, n): signals, patterns and likely causes of right candidates that role signals flag. rows has
    question, is_correct, flagged and signals (array)."""
    from routeloom.functions.matching import pattern_bucket

    s = F.col("signals")
    causes = F.array_compact(F.array(*[F.when(F.array_contains(s, k), v) for k, v in (("missing_required_number", "implicit_usage_missed"), ("possible_intermediate_stop_suspected", "target_type_over_inference"), ("required_rate_number_missing", "operator_cue_over_interpretation"))]))
    named = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    fallback = F.when(F.size(causes) == 0, F.array(F.lit("multi_step_over_penalized"))).otherwise(causes)
    x = rows.where("is_correct = 1 and flagged").select(F.explode(F.concat(named("signal", s), named("pattern", F.array(pattern_bucket(F.col("question")))), named("cause", fallback))).alias("e"))
    return x.groupBy("e.kind", "e.name").agg(F.count(F.lit(1)).alias("n"))
