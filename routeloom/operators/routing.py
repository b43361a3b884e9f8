"""Routing decisions: weighted signal scores, threshold rules, and ranked escalation under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights and threshold of the constraint-aware score.
CONSTRAINT_WEIGHTS = {
    "answer_type_mismatch_suspected": 3,
    "target_quantity_mismatch_suspected": 2,
    "unit_mismatch_suspected": 2,
    "impossible_sign_suspected": 3,
    "integer_expected_but_noninteger_suspected": 3,
    "percent_or_ratio_mismatch_suspected": 2,
    "answer_not_mentioned_in_final_statement_suspected": 2,
    "constraint_word_conflict_suspected": 2,
    "obvious_upper_bound_exceeded_suspected": 2,
    "obvious_lower_bound_violated_suspected": 2,
}
REVISE_THRESHOLD = 2


def weighted_score(signals: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(score, names of the signals that add to it), null signals counting as absent."""
    score, names = F.lit(0), []
    for name, weight in weights.items():
        if name in signals:
            on = F.coalesce(signals[name], F.lit(False))
            score = score + F.when(on, weight).otherwise(0)
            if weight > 0:
                names.append(F.when(on, F.lit(name)))
    return score, F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def revise_if(score: Column, threshold: float = REVISE_THRESHOLD) -> Column:
    return F.when(score >= threshold, "direct_plus_revise").otherwise("reasoning_greedy")


def escalation(error: Column, confidence: Column) -> Column:
    """none, maybe or strong, by the unified error and confidence."""
    return (
        F.when((confidence >= 0.70) & (error < 0.25), "none").when((error >= 0.34) & (confidence <= 0.45), "strong").when(error >= 0.25, "maybe").otherwise("none")
    )


def token_router(tokens: Column, low: float | None, high: float | None) -> Column:
    """Revise iff the length is at most `low` or at least `high`; a bound of None doesn't apply."""
    out = F.lit(False)
    if low is not None:
        out = out | (tokens <= low)
    if high is not None:
        out = out | (tokens >= high)
    return out


def ranked_escalation(rows: DataFrame, by: str, key: str, score: Column, threshold: float, spare: Column, extra: int) -> DataFrame:
    """rows with `escalate`: by falling score, then key, those at the threshold or above while the group's spare budget lasts."""
    w = W.partitionBy(by).orderBy(F.desc("__s"), key)
    x = rows.withColumn("__s", score).withColumn("__b", F.floor(spare / extra))
    return x.withColumn("escalate", (F.row_number().over(w) <= F.col("__b")) & (F.col("__s") >= threshold)).drop("__s", "__b")


def heuristic_adjustment(confidence: Column, parse_risk: Column, ambiguity: Column, parsed: Column, revise: Column, direct: Column) -> Column:
    """Sum of the rule adjustments of a candidate: cheap and safe, revise favoured, format risk, ambiguity."""
    return (
        F.when((confidence > 0.75) & ~revise, 0.03).otherwise(0.0) + F.when((parse_risk > 0.35) & revise, 0.05).otherwise(0.0)
        - F.when(~parsed & direct, 0.04).otherwise(0.0) - F.when((ambiguity > 0.5) & direct, 0.03).otherwise(0.0)
    )


def utility(name: str, p: Column, cost: Column, baseline: Column, adjustment: Column, uncertainty: Column, price: float, beta: float = 0.0) -> Column:
    """A candidate's utility by name; heuristic_adjusted counts its adjustment twice."""
    base = {
        "expected_correct_minus_lambda_cost": p - price * cost,
        "gain_vs_baseline_minus_lambda_delta_cost": p - price * (cost - baseline),
        "expected_reward_minus_cost": p - price * cost,
        "heuristic_adjusted": p + adjustment,
        "p_correct_times_reward_minus_cost": p * p - price * cost,
    }
    if name not in base:
        raise ValueError(f"unknown utility {name}")
    return base[name] + adjustment - beta * uncertainty


# Limits of the first rule-based policy.
SIMPLE_NUMBERS, SIMPLE_WORDS, COMPLEX_NUMBERS, COMPLEX_WORDS, MANY_NUMBERS = 2, 35, 4, 60, 4


def rule_policy(numbers: Column, words: Column, multi_step: Column, unstable: Column, failed: Column, output_numbers: Column, strong: bool = False, best_of_3: bool = True) -> Column:
    """Action after a first pass: keep it unless the output is unstable or has many numbers; then a stronger model, more
    samples or a revision, by the question's complexity."""
    hard = (numbers >= COMPLEX_NUMBERS) | (multi_step & (words >= COMPLEX_WORDS))
    many = output_numbers >= MANY_NUMBERS
    out = F.when(~(unstable | many), "reasoning_greedy")
    if strong:
        out = out.when(hard & failed, "strong_direct")
    if best_of_3:
        out = out.when(hard & many, "reasoning_best_of_3")
    return out.otherwise("direct_plus_revise")


def first_action(numbers: Column, words: Column, multi_step: Column) -> Column:
    """Action before any pass: direct for simple questions."""
    simple = (numbers <= SIMPLE_NUMBERS) & ~multi_step & (words <= SIMPLE_WORDS)
    return F.when(simple, "direct_greedy").otherwise("reasoning_greedy")
