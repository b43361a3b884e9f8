"""Routing policies that read a question and its first reasoning. Each adds its signals, score and action to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import consistency as C
from routeloom.functions.answers import math_answer, numeric_answer
from routeloom.operators.outcomes import ratio
from routeloom.operators.prefix import unused
from routeloom.operators.routing import CONSTRAINT_WEIGHTS, escalation, revise_if, weighted_score

# Patterns, weights and thresholds of the policies.
FINAL_MARK = r"(?i)(?:final answer|answer\s*:|therefore|thus|hence)"
UNSURE = "maybe|perhaps|probably|possibly|i think|i'm not sure|not sure|guess|approximately|about"
CONTRADICTION = "but|however|although|on the other hand|instead|actually"
UNITS = "dollars?|cents?|hours?|minutes?|days?|weeks?|months?|years?|pages?|people|friends?|students?|apples?|books?|clips?|plants?|miles?|km|meters?|feet|inches?|pounds?|ounces?"
TARGET = "how many|how much|what is|find|total|left|remain"
NEGATIVE_WORDS = "loss|debt|decrease|below|drop|negative"
MANY_NUMBERS = 6
VIOLATION_WEIGHTS = {
    "final_answer_missing_or_unclear": 3,
    "parse_failure": 3,
    "malformed_output": 3,
    "uncertainty_phrase_present": 2,
    "too_many_intermediate_numbers_without_clear_final": 2,
    "contradiction_like_phrase_present": 2,
    "target_mismatch_suspected": 2,
    "unit_mismatch_suspected": 1,
    "impossible_value_suspected": 2,
}
VIOLATION_THRESHOLD = 3
ROLE_MAYBE, ROLE_STRONG = 2, 3
UNIFIED_ERROR, UNIFIED_MIXED, UNIFIED_CONFIDENCE = 0.34, 0.25, 0.45
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SHORT_REASONING = 35
ANSWER_WEIGHTS = {
    "answer_type_mismatch_suspected": 2,
    "target_quantity_mismatch_suspected": 2,
    "constraint_word_conflict_suspected": 2,
    "unit_mismatch_suspected": 2,
    "impossible_sign_suspected": 2,
    "integer_expected_but_noninteger_suspected": 2,
    "bound_violation_suspected": 2,
    "percent_or_ratio_mismatch_suspected": 1,
    "answer_not_mentioned_in_final_statement_suspected": 1,
    "parse_failure_numeric_expected": 3,
    "consistency_intermediate_echo_risk": 2,
    "consistency_remaining_conflict": 2,
    "consistency_total_conflict": 2,
    "consistency_rate_vs_total_conflict": 2,
    "consistency_numeric_type_mismatch": 2,
    "consistency_negative_impossible": 2,
}
ANSWER_ERROR, WARNING_HIGH, WARNING_COMBINED, TRUSTED_COVERAGE = 2, 3, 1, 0.55
LATE_WEIGHTS = {"weekday_question_numeric_final": 3, "need_more_answer_equals_list_price": 3, "tail_equals_disagrees_with_final": 2}
LOW_CONFIDENCE_WARNING = 2
WHOLE_NUMBER = r"^-?[0-9,]+(?:\.[0-9]+)?$"
FINAL_LINE = r"(?isU)\A(.*)((?m:^)\s*(?:final\s*answer|answer)\s*:.*)\z"
TAIL_VALUE = r"(?m)=\s*\$?\s*([0-9,]+(?:\.[0-9]+)?)\s*(?:\n|$|\.|\)|\])"
TAIL = 800


def with_violations(df: DataFrame, question: str, output: str, name: str = "violation") -> DataFrame:
    """df with a struct of the violation signals of an output; `revise_recommended` and `severe_instability` sum them
    up. Null texts count as empty. Shared parts are columns of their own, so that each is computed once a row."""
    q, t, s = C.full(F.col(question)), C.full(F.col(output)), C.stripped(F.col(output))
    units = lambda x: F.transform(C.all_of(x, rf"(?iU)\b(?:{UNITS})\b"), F.lower)
    x = df.withColumns({
        "__parsed": numeric_answer(F.col(output)), "__marked": t.rlike(FINAL_MARK), "__unsure": C.word(t, UNSURE), "__contrary": C.word(t, CONTRADICTION), "__asked": units(q), "__stripped": s,
        "__many": F.size(C.all_of(t, C.LOOSE_NUMBER)) >= MANY_NUMBERS,
    })
    x = x.withColumn("__failed", (F.col("__parsed") == "") | ~F.col("__stripped").rlike("[0-9,]"))
    s, parsed, failed, asked = F.col("__stripped"), F.col("__parsed"), F.col("__failed"), F.col("__asked")
    marked, unsure, contrary = F.col("__marked"), F.col("__unsure"), F.col("__contrary")
    plain = ~failed & ~C.mentions(s, "answer:|final answer") & ~s.rlike(r"^-?[0-9,]+(?:\.[0-9]*)?$")
    signals = {
        "final_answer_missing_or_unclear": failed | (~marked & plain) | (s == ""),
        "target_mismatch_suspected": C.mentions(q, TARGET) & ~marked & contrary,
        "impossible_value_suspected": F.startswith(parsed, F.lit("-")) & ~C.word(q, NEGATIVE_WORDS),
        "unit_mismatch_suspected": (F.size(asked) > 0) & ~F.arrays_overlap(asked, units(t)),
        "too_many_intermediate_numbers_without_clear_final": F.col("__many") & ~marked,
        "uncertainty_phrase_present": unsure,
        "parse_failure": failed,
        "malformed_output": (s == "") | ((F.length(s) <= 2) & failed),
        "contradiction_like_phrase_present": contrary,
    }
    x = x.withColumns({f"__v_{k}": c for k, c in signals.items()})
    v = {k: F.col(f"__v_{k}") for k in signals}
    revise = (contrary | unsure) & ~marked
    for k in signals:
        revise = revise if k in ("uncertainty_phrase_present", "contradiction_like_phrase_present") else revise | v[k]
    severe = failed | v["malformed_output"] | (contrary & unsure & ~marked) | (v["too_many_intermediate_numbers_without_clear_final"] & v["final_answer_missing_or_unclear"])
    out = F.struct(*[c.alias(k) for k, c in v.items()], revise.alias("revise_recommended"), severe.alias("severe_instability"))
    return x.withColumn(name, out).drop("__parsed", "__marked", "__unsure", "__contrary", "__asked", "__stripped", "__many", "__failed", *[f"__v_{k}" for k in signals])


def violation_policies(df: DataFrame, question: str, output: str) -> DataFrame:
    """df with `violation` (signals), `violation_action` (any signal that counts) and `weighted_action` (their weighted
    sum), the second and third policy."""
    x = with_violations(df, question, output)
    v = F.col("violation")
    score, _ = weighted_score({k: v[k] for k in VIOLATION_WEIGHTS}, VIOLATION_WEIGHTS)
    action = F.when(v["revise_recommended"], "direct_plus_revise").otherwise("reasoning_greedy")
    x = x.withColumns({"violation_action": action, "violation_score": score})
    return x.withColumn("weighted_action", revise_if(F.col("violation_score"), VIOLATION_THRESHOLD))


def setting_sweep(rows: DataFrame, signals: str, cheap: Column, dear: Column, settings: list[dict], dear_cost: float = 2.0) -> DataFrame:
    """(setting, n, accuracy, avg_cost, revise_trigger_count, revise_trigger_fraction, distance_to_oracle,
    matches_or_beats_reasoning_greedy, uses_less_cost_than_always_revise, nontrivial_selectivity) for each of the settings:
    `setting` (its name), `threshold`, and weights by names of VIOLATION_WEIGHTS, 0 if it has none.

    Outcomes are first counted by the bit pattern of the signals and both routes' correctness, at most 2,048 rows however
    many questions there are; settings then meet patterns, not questions. A null signal counts as off. Without questions
    a setting has n 0 and nulls.
    """
    names = list(VIOLATION_WEIGHTS)
    bits = sum((F.coalesce(F.col(signals)[k].cast("int"), F.lit(0)) * (1 << i) for i, k in enumerate(names)), F.lit(0))
    counts = rows.select(bits.alias("bits"), cheap.cast("int").alias("c"), dear.cast("int").alias("d")).groupBy("bits", "c", "d").agg(F.count(F.lit(1)).alias("n"))
    on = [F.col("bits").bitwiseAND(1 << i).cast("boolean").cast("int") for i in range(len(names))]
    scored = F.array(*[F.struct(F.lit(x["setting"]).alias("setting"), (sum((int(x.get(k, 0)) * b for k, b in zip(names, on)), F.lit(0)) >= int(x["threshold"])).alias("revise")) for x in settings])
    x = counts.select("c", "d", "n", F.explode(scored).alias("s")).select("s.*", "c", "d", "n")
    n, right = F.sum("n"), lambda c: F.sum(F.col("n") * c)
    g = x.groupBy("setting").agg(
        n.alias("n"), right(F.when(F.col("revise"), F.col("d")).otherwise(F.col("c"))).alias("right"), F.sum(F.when(F.col("revise"), F.col("n")).otherwise(0)).alias("revise_trigger_count"),
        right(F.col("c")).alias("cheap"), right(F.greatest("c", "d")).alias("oracle"))
    share = lambda c: F.col(c) / F.col("n")
    every = rows.sparkSession.createDataFrame([(x["setting"],) for x in settings], "setting string")
    g = every.join(g, "setting", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cost = 1 + (dear_cost - 1) * share("revise_trigger_count")
    return g.select(
        "setting", "n", share("right").alias("accuracy"), cost.alias("avg_cost"), "revise_trigger_count", share("revise_trigger_count").alias("revise_trigger_fraction"),
        (share("right") - share("oracle")).alias("distance_to_oracle"), (F.col("right") >= F.col("cheap")).alias("matches_or_beats_reasoning_greedy"), (cost < dear_cost).alias("uses_less_cost_than_always_revise"),
        ((F.col("revise_trigger_count") > 0) & (F.col("revise_trigger_count") < F.col("n"))).alias("nontrivial_selectivity"))


def role_policies(df: DataFrame, question: str, output: str, answer: str) -> DataFrame:
    """df with the unified error's structs and scores, the fourth policy by constraint weights (`constraint_action`),
    the fifth by the unified rule (`unified_action`) and by calibrated roles (`role_action`)."""
    x = C.with_unified_error(df, question, output, answer)
    c, r = F.col("constraint"), F.col("role")
    score, _ = weighted_score({k: c[k] for k in CONSTRAINT_WEIGHTS}, CONSTRAINT_WEIGHTS)
    combined = r["role_strong_error_score"] + r["role_warning_score"] + c["target_quantity_mismatch_suspected"].cast("int") + c["constraint_word_conflict_suspected"].cast("int")
    role = F.when(combined >= ROLE_STRONG, "strong_escalation_candidate").when((combined >= ROLE_MAYBE) & (r["calibrated_decision"] == "no_escalation"), "maybe_escalate").otherwise(r["calibrated_decision"])
    choose = lambda d, calm: F.when(d == calm, "reasoning_greedy").otherwise("direct_plus_revise")
    x = x.withColumns({"constraint_score": score, "constraint_action": revise_if(score), "role_decision": role, "unified_decision": escalation(F.col("unified_error_score"), F.col("unified_confidence_score"))})
    return x.withColumns({"role_action": choose(F.col("role_decision"), "no_escalation"), "unified_action": choose(F.col("unified_decision"), "none")})


def candidate_consistency(question: Column, answer: Column) -> dict[str, Column]:
    """11 signals of a question and a candidate answer's first number; without a number only the type signal can be on."""
    q = F.lower(C.full(question))
    value = F.nullif(F.regexp_extract(C.full(answer), C.PLAIN_NUMBER, 0), F.lit("")).try_cast("double")
    n = F.transform(C.all_of(q, C.PLAIN_NUMBER), lambda x: x.try_cast("double"))
    has = lambda parts: C.mentions(q, parts)
    after = lambda pattern, group=1: F.nullif(F.regexp_extract(q, pattern, group), F.lit("")).try_cast("double")
    most, least, top, total = after(r"at most\s+([0-9]+(?:\.[0-9]+)?)"), after(r"at least\s+([0-9]+(?:\.[0-9]+)?)"), after(r"no more than\s+([0-9]+(?:\.[0-9]+)?)"), after(r"total of\s+([0-9]+(?:\.[0-9]+)?)")
    a, b = (after(r"ratio\s+of\s+([0-9]+)\s*:\s*([0-9]+)", g) for g in (1, 2))
    share = F.try_divide(total, a + b)
    whole = F.try_mod(total, a + b) == 0
    given = F.array_contains(n, value)
    out = {
        "numeric_type_mismatch": has("how many|how much|what is|what are|how long|minimum number") & value.isNull(),
        "non_integer_count": has("how many|minimum number|number of") & (value != F.floor(value)),
        "negative_impossible": (value < 0) & has("how many|students|books|boxes|apples|tickets"),
        "remaining_conflict": has("left|remaining|remain") & (value >= F.array_max(n)),
        "total_conflict": has("total|altogether|in all") & (value < F.array_min(n)),
        "rate_vs_total_conflict": has("per |each|every") & has("total|altogether|in all") & given,
        "floor_ceiling_conflict": has("minimum number|at least|needed|required") & (most > 0) & (value < F.floor(F.try_divide(F.array_max(n) + most - 1, most))),
        "below_at_least_constraint": value < least,
        "exceeds_no_more_than_constraint": value > top,
        "ratio_constraint_conflict": whole & ~F.array_contains(F.array(a * share, b * share, total), value),
        "intermediate_echo_risk": given & has("then|after|remaining|left|twice|half"),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def with_checkers(df: DataFrame, question: str, candidate: str) -> DataFrame:
    """df with a struct of four checkers of a candidate answer, each whether it flags it and the signals why, by name:
    `plain` (the signals of candidate_consistency), and these with role coverage (`role`), its calibrated decision
    (`calibrated`) or the unified error (`unified`) of an output that only gives the answer."""
    names = [unused(df.columns, n) for n in ("checked_plain", "checked_text", "checked_value")]
    plain, text, value = names
    p = candidate_consistency(F.col(question), F.col(candidate))
    number = F.nullif(F.regexp_extract(C.full(F.col(candidate)), C.PLAIN_NUMBER, 0), F.lit("")).try_cast("double")
    number = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), F.concat(number.cast("long").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))
    x = df.withColumns({plain: F.struct(*[c.alias(k) for k, c in p.items()]), text: F.concat(F.lit("Final answer: "), C.full(F.col(candidate))), value: F.coalesce(number, F.lit(""))})
    parts = ("role", "constraint", "target", "self", "selective", "calibration", "step")
    kept = {k: unused([*df.columns, *names, *parts], f"own_{k}") for k in parts if k in df.columns}
    for k, own in kept.items():
        x = x.withColumnRenamed(k, own)
    x = C.with_unified_error(x, question, text, value)
    fired = F.array_compact(F.array(*[F.when(F.col(plain)[k], k) for k in p]))
    role, decision = F.col("role"), F.col("role")["calibrated_decision"]
    error, confidence = F.col("unified_error_score"), F.col("unified_confidence_score")
    calibrated = F.when(decision != "no_escalation", F.concat(F.lit("calibrated_"), decision))
    unified = F.when((error >= UNIFIED_ERROR) | ((error >= UNIFIED_MIXED) & (confidence < UNIFIED_CONFIDENCE)), "unified_error_escalate")
    signals = {"plain": fired, "role": F.concat(fired, role["signals"]), "calibrated": F.concat(fired, F.array_compact(F.array(calibrated))), "unified": F.concat(fired, F.array_compact(F.array(unified)))}
    out = F.struct(*[F.struct((F.size(v) > 0).alias("flagged"), F.array_sort(F.array_distinct(v)).alias("signals")).alias(k) for k, v in signals.items()])
    x = x.withColumn("checkers", out).drop(*names, *parts, "unified_error_score", "unified_confidence_score")
    for k, own in kept.items():
        x = x.withColumnRenamed(own, k)
    return x.select(*df.columns, "checkers")


def signal_tradeoff(rows: DataFrame, flags: dict[str, Column], correct: Column) -> DataFrame:
    """(variant, wrong_recall, false_positive_rate_on_correct, recall_minus_fpr, balanced_utility, num_flagged) for each
    checker: the shares of wrong and of right candidates that it flags, their difference, and the mean of the first and of
    what the second leaves. A share of nothing is 0; null flags are off; candidates without a verdict are left out."""
    each = F.array(*[F.struct(F.lit(k).alias("variant"), F.coalesce(v, F.lit(False)).alias("on")) for k, v in flags.items()])
    right, on = unused(rows.columns, "right"), F.col("f.on")
    g = rows.select(correct.cast("boolean").alias(right), F.explode(each).alias("f")).where(F.col(right).isNotNull()).groupBy("f.variant").agg(
        F.count_if(on & ~F.col(right)).alias("hit"), F.count_if(~F.col(right)).alias("wrong"), F.count_if(on & F.col(right)).alias("false"), F.count_if(F.col(right)).alias("true"))
    recall, fpr = ratio(F.col("hit"), F.col("wrong")), ratio(F.col("false"), F.col("true"))
    return g.select("variant", recall.alias("wrong_recall"), fpr.alias("false_positive_rate_on_correct"), (recall - fpr).alias("recall_minus_fpr"), ((recall + 1 - fpr) / 2).alias("balanced_utility"), (F.col("hit") + F.col("false")).alias("num_flagged"))


def _trust(categorical: Column, error: Column) -> Column:
    """Why the final answer is trusted or not; the first rule that fits."""
    c, r, a, t = F.col("constraint"), F.col("role"), F.col("parsed"), F.lower(F.col("__text"))
    broken = c["impossible_sign_suspected"] | c["bound_violation_suspected"] | c["integer_expected_but_noninteger_suspected"]
    named = C.word(a, WEEKDAYS) | C.word(a, MONTHS) | F.lower(a).isin("yes", "no")
    final = r["has_finalization_cue"] | C.mentions(t, "final answer|answer:|answer is")
    covered = r["role_coverage_score"] >= TRUSTED_COVERAGE
    return (
        F.when(broken, "hard_constraint_violation").when(a == "", "empty_parse").when(categorical & ~named, "categorical_expected_but_unrecognized_token")
        .when(~categorical & c["profile"]["numeric_target_expected"] & ~a.rlike(WHOLE_NUMBER), "numeric_expected_non_numeric_parse")
        .when(~final, "no_finalization_cue").when(error == 0, "zero_answer_error_with_parse_and_finalization")
        .when(r["coherent_answer_type"] & covered, "coherent_answer_high_coverage").when(~covered, "low_role_coverage_with_residual_answer_error").otherwise("ok_despite_mild_answer_error")
    )


def trusted(reason: Column) -> Column:
    return reason.isin("zero_answer_error_with_parse_and_finalization", "coherent_answer_high_coverage", "ok_despite_mild_answer_error")


def answer_error_policies(df: DataFrame, question: str, output: str) -> DataFrame:
    """df with the sixth and seventh policy: parsed answer, explanation warnings, answer error, trust and its reason,
    late signals, and for each policy the reason to revise and the action."""
    q, t = C.full(F.col(question)), C.full(F.col(output))
    x = df.withColumn("__text", t).withColumn("parsed", F.coalesce(F.nullif(math_answer(F.col("__text")), F.lit("")), numeric_answer(F.col("__text"))))
    x = x.withColumn("__answer", F.nullif(F.col("parsed"), F.lit("")))
    x = C.with_constraints(C.with_role_coverage(x, question, "__text", "__answer"), question, "__text", "__answer")
    c, r, a = F.col("constraint"), F.col("role"), F.col("parsed")
    low = F.lower(q)
    either = C.word(q, "yes|no") & C.mentions(low, "yes or no| true or false")
    x = x.withColumn("categorical", c["profile"]["asks_when"] | either | C.mentions(low, "which month|what month") | (C.mentions(low, "who ") & ~C.mentions(low, "how many")))
    kind, numeric = F.col("categorical"), c["profile"]["numeric_target_expected"] & ~F.col("categorical")

    lacks = ["possible_intermediate_stop_suspected", "required_subtractive_number_missing", "required_additive_number_missing", "required_rate_number_missing", "required_capacity_number_missing"]
    short = F.size(C.all_of(F.col("__text"), r"(?U)\b\w+\b")) <= SHORT_REASONING
    warnings = r["n_missing"] + sum((r[k].cast("int") for k in lacks), F.lit(0)) + short.cast("int")
    x, check = C.staged(x, "check", candidate_consistency(F.col(question), a))
    signals = {k: c[k] for k in ANSWER_WEIGHTS if k.endswith("_suspected")} | {
        "answer_type_mismatch_suspected": c["answer_type_mismatch_suspected"] & ~kind, "parse_failure_numeric_expected": (a == "") & numeric,
    } | {f"consistency_{k}": v & (a != "") & numeric for k, v in check.items()}
    x = x.withColumns({f"__v_{k}": v for k, v in signals.items()} | {"explanation_warning_score": warnings})
    score, names = weighted_score({k: F.col(f"__v_{k}") for k in signals}, ANSWER_WEIGHTS)
    x = x.withColumns({"answer_error_score": score, "answer_error_signals": F.array_sort(names)}).drop(*[f"__v_{k}" for k in signals])
    x = x.withColumn("trust", _trust(kind, F.col("answer_error_score")))
    warning, error = F.col("explanation_warning_score"), F.col("answer_error_score")
    combined = "explanation_pressure_plus_low_trust_plus_moderate_answer_error"
    pressed = lambda e, trust: (warning >= WARNING_HIGH) & ~trusted(F.col(trust)) & (e >= WARNING_COMBINED)
    x = x.withColumn("revise_reason", F.when(error >= ANSWER_ERROR, "answer_error_high").when(pressed(error, "trust"), combined).otherwise("no_escalation"))

    s = C.stripped(F.col("__text"))
    final = C.stripped(F.regexp_extract(s, FINAL_LINE, 2))
    body = F.when(s.rlike(FINAL_LINE), C.stripped(F.regexp_extract(s, FINAL_LINE, 1))).otherwise(s)
    x = x.withColumn("__final", F.coalesce(F.nullif(math_answer(final), F.lit("")), F.nullif(numeric_answer(final), F.lit("")), a))
    x = x.withColumn("__value", F.when(F.col("__final").rlike(WHOLE_NUMBER), F.regexp_replace("__final", ",", "").try_cast("double")))
    stated = F.try_element_at(F.regexp_extract_all(F.right(body, F.lit(TAIL)), F.lit(TAIL_VALUE), F.lit(1)), F.lit(-1))
    price = F.nullif(F.regexp_extract(q, r"\$\s*([0-9]+)", 1), F.lit("")).try_cast("long")
    late = {
        "weekday_question_numeric_final": kind & F.col("__final").rlike(WHOLE_NUMBER),
        "need_more_answer_equals_list_price": C.mentions(low, r"how\s+much\s+more") & (F.regexp_replace("__final", ",", "").try_cast("double").try_cast("long") == price),
        "tail_equals_disagrees_with_final": numeric & (F.abs(F.regexp_replace(stated, ",", "").try_cast("double") - F.col("__value")) > 1e-6),
    }
    late = {k: F.coalesce(v, F.lit(False)) for k, v in late.items()}
    unsure = ~trusted(F.col("trust")) & (kind | (warning >= LOW_CONFIDENCE_WARNING))
    x, v = C.staged(x, "late", late | {"low_confidence_escalate": unsure})
    x = x.withColumn("late", F.struct(*[c.alias(k) for k, c in v.items()]))
    x = x.withColumn("late_error_score", error + weighted_score({k: F.col("late")[k] for k in late}, LATE_WEIGHTS)[0])
    x = x.withColumn("late_trust", _trust(kind, F.col("late_error_score")))
    reason = F.when(F.col("late_error_score") >= ANSWER_ERROR, "answer_error_high").when(F.col("late")["low_confidence_escalate"], "late_low_confidence").when(pressed(F.col("late_error_score"), "late_trust"), combined).otherwise("no_escalation")
    x = x.withColumn("late_revise_reason", reason)
    act = lambda k: F.when(F.col(k) == "no_escalation", "reasoning_greedy").otherwise("direct_plus_revise")
    return x.withColumns({"answer_error_action": act("revise_reason"), "late_action": act("late_revise_reason")}).drop("__text", "__answer", "__final", "__value").transform(C.unstaged, "check", "late")
