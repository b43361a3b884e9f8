"""SQL with the same rows as the queries over word problems. The answer in each reasoning is stated, not extracted."""

from __future__ import annotations

from routeloom.functions import consistency as C
from routeloom.operators import policies as P
from routeloom.plans.inputs import WORD_PROBLEMS

_ANSWER = "CASE j WHEN 0 THEN CAST(a - b AS VARCHAR) WHEN 2 THEN n WHEN 3 THEN '' WHEN 4 THEN '' WHEN 6 THEN '-' || m || '.5' ELSE n END AS x"
_W = "WITH " + WORD_PROBLEMS.replace("SELECT question_id, CASE i", f"SELECT question_id, {_ANSWER}, CASE i")


def _has(words: str, text: str = "q") -> str:
    return rf"regexp_matches({text}, '(?i)\b(?:{words})\b')"


def _in(parts: str, text: str = "q") -> str:
    return f"regexp_matches({text}, '(?i)(?:{parts})')"


def _all(pattern: str, text: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


def _words(words: str, text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '(?i)\b(?:{words})\b'), lambda w: lower(w))"


_NUMBERS = f"list_transform({_all(C.LOOSE_NUMBER, 'q')}, lambda v: TRY_CAST(replace(v, ',', '') AS DOUBLE))"
_PROFILE = f"""p AS (SELECT question_id, q, t, x, TRY_CAST(x AS DOUBLE) AS v, {_words(C.COUNT_UNITS, 'q')} AS units, {_has(C.MONEY_UNITS)} AS has_money_unit, {_has(C.TIME_UNITS)} AS has_time_unit,
  {_has('how many')} AS asks_how_many, {_has('how much')} AS asks_how_much, {_in(C.ASKS_WHEN)} AS asks_when, {_has(C.LEFT)} AS asks_left, {_has(C.TOTAL)} AS asks_total, {_has(C.ACTION)} AS asks_action_quantity,
  {_has(C.PERCENT_OR_RATIO)} AS has_percent_or_ratio, list_max({_NUMBERS}) AS obvious_total, {_has('half of the remaining')} AS half_of_remaining, len({_all(C.LOOSE_NUMBER, 'q')}) AS n_numbers,
  CASE WHEN regexp_matches(t, '(?i)(?:final answer|answer\\s*:|therefore|thus|hence|so)') THEN trim(regexp_extract(t, '(?is)(?:final answer|answer\\s*:|therefore|thus|hence|so)\\s*(.*)', 1)) ELSE trim(t) END AS f FROM w)"""
_EXPECTED = "(asks_how_many OR asks_how_much OR has_time_unit OR has_money_unit)"
_SIGNALS = {
    "answer_type_mismatch_suspected": f"({_EXPECTED} AND x = '') OR (asks_when AND x <> '')",
    "target_quantity_mismatch_suspected": f"(asks_left AND NOT {_has(C.LEFT, 'f')} AND {_has(C.TOTAL, 'f')}) OR (half_of_remaining AND NOT {_in(C.HALVING, 'f')} AND ({_has(C.LEFT, 'f')} OR x <> '')) OR (asks_action_quantity AND {_has(C.TOTAL, 'f')} AND NOT asks_total)",
    "unit_mismatch_suspected": f"x = '' AND ((has_money_unit AND NOT {_has(C.MONEY_UNITS, 'f')}) OR (has_time_unit AND NOT {_has(C.TIME_UNITS, 'f')}) OR (len(units) > 0 AND NOT contains(lower(f), units[1])))",
    "impossible_sign_suspected": "v < 0 AND (asks_how_many OR asks_how_much OR len(units) > 0 OR has_money_unit)",
    "integer_expected_but_noninteger_suspected": "asks_how_many AND len(units) > 0 AND v <> floor(v)",
    "percent_or_ratio_mismatch_suspected": "has_percent_or_ratio AND v < 0",
    "answer_not_mentioned_in_final_statement_suspected": "x <> '' AND f <> '' AND NOT contains(replace(f, ',', ''), x)",
    "constraint_word_conflict_suspected": f"(asks_left AND {_has(C.TOTAL, 'f')}) OR (asks_total AND {_has(C.LEFT, 'f')}) OR (half_of_remaining AND {_has(C.LEFT, 'f')} AND v = obvious_total)",
    "bound_violation_suspected": "n_numbers <= 3 AND ((asks_left AND v > obvious_total) OR v < 0)",
}
_BOUNDS = {"obvious_upper_bound_exceeded_suspected": "n_numbers <= 3 AND asks_left AND v > obvious_total", "obvious_lower_bound_violated_suspected": "n_numbers <= 3 AND v < 0"}
_ON = "[" + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in _SIGNALS) + "]"

_PLAIN = _all(C.PLAIN_NUMBER, "t")
_SELF = f"""{_W}, n AS (SELECT *, {_PLAIN} AS n, string_split(t, chr(10)) AS ls FROM w), a AS (SELECT *, coalesce(n[-1], '') AS a, lower(array_to_string(ls[-2:], chr(10))) AS chunk FROM n),
 s AS (SELECT question_id, a <> '' AND contains(chunk, a) AS answer_consistency_across_rephrasing, a <> '' AND len(list_distinct(n)) <= 4 AS answer_stability_under_small_prompt_change,
  a <> '' AND len(list_filter(n, lambda y: y = a)) >= 2 AS final_answer_repeated_consistently, {_has(C.CONFLICTS, 't')} AS reasoning_contains_backtracking_or_conflict, {_has(C.VERIFY_HEDGES, 't')} AS contains_hedging_language FROM a)
 SELECT *, CAST(greatest(0, 35 * CAST(answer_consistency_across_rephrasing AS INT) + 35 * CAST(answer_stability_under_small_prompt_change AS INT) + 20 * CAST(final_answer_repeated_consistently AS INT)
  - 20 * CAST(reasoning_contains_backtracking_or_conflict AS INT) - 10 * CAST(contains_hedging_language AS INT)) AS DOUBLE) / 100 AS self_verification_score FROM s"""
_SELECTIVE = f"""{_W}, s AS (SELECT question_id, x <> '' AS final_answer_clarity, {_has('final answer|answer:', 't').replace("answer:)", "answer:)")} AS clear_final_marker, len({_words(C.SELECTIVE_HEDGES, 't')}) AS hedging_word_count,
  len(list_distinct({_PLAIN})) >= 4 AS many, len(list_distinct(list_filter([x, CASE WHEN question_id % 3 = 0 THEN '7' ELSE x END], lambda y: y <> ''))) = 1 AS agreement_between_multiple_shallow_passes FROM w)
 SELECT * EXCLUDE (many), CAST(least(100, CASE WHEN final_answer_clarity THEN 40 ELSE 10 END + 20 * CAST(clear_final_marker AS INT) + 20 * CAST(agreement_between_multiple_shallow_passes AS INT) + greatest(0, 20 - 5 * hedging_word_count)) AS DOUBLE) / 100 AS confidence_proxy_score,
  CAST(greatest(0, 100 - 35 * CAST(many AS INT) - least(40, 12 * hedging_word_count) - 20 * CAST(NOT final_answer_clarity AS INT)) AS DOUBLE) / 100 AS decision_margin_proxy FROM s"""
_STEPS = rf"""{_W}, k AS (SELECT question_id, {_all(C.PLAIN_NUMBER, 'q')} AS q, regexp_matches(t, '[-=+*/×÷]') AS eq,
  list_transform(list_filter(regexp_split_to_array(t, '(?i)(?:\n+|\bthen\b|\bnext\b|\btherefore\b|\bso\b)'), lambda s: regexp_matches(s, '\S')), lambda s: {_all(C.PLAIN_NUMBER, 's')}) AS n FROM w),
 m AS (SELECT *, len(n) AS steps, greatest(len(n) - 1, 0) AS moves, len(list_filter(range(1, len(n)), lambda i: len(n[i]) > 0 AND len(n[i + 1]) > 0 AND NOT list_has_any(n[i], n[i + 1]))) AS broken,
  CAST(len(list_filter(list_distinct(q), lambda y: NOT list_contains(flatten(n), y))) AS DOUBLE) / greatest(len(list_distinct(q)), 1) AS lacking FROM k)
 SELECT question_id, steps AS number_of_steps_detected, eq AS presence_of_equation_like_patterns, lacking AS missing_question_number_fraction, moves > 0 AND 5 * broken > 3 * moves AS missing_transition_logic,
  greatest(1.0 - least(0.5, lacking) - CASE WHEN moves > 0 AND 5 * broken > 3 * moves THEN 0.25 ELSE 0 END - CASE WHEN NOT eq AND steps >= 3 THEN 0.15 ELSE 0 END, 0) AS step_consistency_score FROM m"""
_CUES = f"{_W}, c AS (SELECT question_id, {', '.join(f'len(list_distinct({_words(v, chr(113))})) AS n_{k}' for k, v in C.WINDOW_CUES.items())}, len({_words('|'.join(k for k in (C.NUMBER_WORDS | C.MULTIPLE_WORDS) if k not in ('zero', 'thrice')), 'q')}) AS n_words FROM w)"
_TOP = f"greatest({', '.join(f'n_{k}' for k in C.WINDOW_CUES)})"
_MARK = P.FINAL_MARK.removeprefix("(?i)")
_VIOLATIONS = f"""{_W}, r AS (SELECT question_id, x, q, t, x = '' AS parse_failure, {_in(_MARK, 't')} AS marked, {_has(P.UNSURE.replace("'", "''"), 't')} AS uncertainty_phrase_present, {_has(P.CONTRADICTION, 't')} AS contradiction_like_phrase_present,
   len({_all(C.LOOSE_NUMBER, 't')}) >= {P.MANY_NUMBERS} AS many, {_words(P.UNITS, 'q')} AS qu, {_words(P.UNITS, 't')} AS tu FROM w),
 v AS (SELECT question_id, marked, parse_failure OR (NOT marked AND NOT {_in('answer:|final answer', 't')} AND NOT regexp_matches(trim(t), '^-?[0-9,]+(?:[.][0-9]*)?$')) OR t = '' AS final_answer_missing_or_unclear,
   {_in(P.TARGET)} AND NOT marked AND contradiction_like_phrase_present AS target_mismatch_suspected, starts_with(x, '-') AND NOT {_has(P.NEGATIVE_WORDS)} AS impossible_value_suspected, len(qu) > 0 AND NOT list_has_any(qu, tu) AS unit_mismatch_suspected,
   many AND NOT marked AS too_many_intermediate_numbers_without_clear_final, uncertainty_phrase_present, parse_failure, t = '' OR (length(trim(t)) <= 2 AND parse_failure) AS malformed_output, contradiction_like_phrase_present FROM r),
 z AS (SELECT *, final_answer_missing_or_unclear OR target_mismatch_suspected OR impossible_value_suspected OR unit_mismatch_suspected OR too_many_intermediate_numbers_without_clear_final OR parse_failure OR malformed_output
    OR ((contradiction_like_phrase_present OR uncertainty_phrase_present) AND NOT marked) AS revise_recommended,
   parse_failure OR malformed_output OR (contradiction_like_phrase_present AND uncertainty_phrase_present AND NOT marked) OR (too_many_intermediate_numbers_without_clear_final AND final_answer_missing_or_unclear) AS severe_instability,
   {' + '.join(f'{w} * CAST({k} AS INT)' for k, w in P.VIOLATION_WEIGHTS.items())} AS violation_score FROM v)
 SELECT * EXCLUDE (marked), CASE WHEN revise_recommended THEN 'direct_plus_revise' ELSE 'reasoning_greedy' END AS violation_action,
  CASE WHEN violation_score >= {P.VIOLATION_THRESHOLD} THEN 'direct_plus_revise' ELSE 'reasoning_greedy' END AS weighted_action FROM z"""
_CHECKS = {
    "numeric_type_mismatch": f"{_in('how many|how much|what is|what are|how long|minimum number')} AND v IS NULL",
    "non_integer_count": f"{_in('how many|minimum number|number of')} AND v <> floor(v)",
    "negative_impossible": f"v < 0 AND {_in('how many|students|books|boxes|apples|tickets')}",
    "remaining_conflict": f"{_in('left|remaining|remain')} AND v >= list_max(n)",
    "total_conflict": f"{_in('total|altogether|in all')} AND v < list_min(n)",
    "rate_vs_total_conflict": f"{_in('per |each|every')} AND {_in('total|altogether|in all')} AND list_contains(n, v)",
    "floor_ceiling_conflict": "false",
    "below_at_least_constraint": "false",
    "exceeds_no_more_than_constraint": "false",
    "ratio_constraint_conflict": "false",
    "intermediate_echo_risk": f"list_contains(n, v) AND {_in('then|after|remaining|left|twice|half')}",
}

ORACLE_SQL = {
    "question_profiles": f"""{_W}, {_PROFILE} SELECT question_id, array_to_string(units, '|') AS count_units, has_money_unit, has_time_unit, asks_how_many, asks_how_much, asks_when, asks_left, asks_total, asks_action_quantity,
      has_percent_or_ratio, obvious_total, asks_how_many AND len(units) > 0 AS integer_expected, {_EXPECTED} AS numeric_target_expected, half_of_remaining, n_numbers FROM p""",
    "constraint_flags": f"""{_W}, {_PROFILE}, s AS (SELECT question_id, f AS final_statement, {', '.join(f'coalesce({c}, false) AS {k}' for k, c in (_SIGNALS | _BOUNDS).items())} FROM p)
      SELECT *, array_to_string(list_filter({_ON}, lambda y: y IS NOT NULL), '|') AS signals, len(list_filter({_ON}, lambda y: y IS NOT NULL)) AS n_signals FROM s""",
    "self_verification": _SELF,
    "selective_prediction": _SELECTIVE,
    "step_verification": _STEPS,
    "role_cue_counts": f"{_CUES} SELECT *, CASE WHEN {_TOP} = 0 THEN NULL {' '.join(f'WHEN n_{k} = {_TOP} THEN {chr(39)}{k}{chr(39)}' for k in C.WINDOW_CUES)} END AS role FROM c",
    "violation_signals": _VIOLATIONS,
    "candidate_consistency": f"{_W}, c AS (SELECT question_id, lower(q) AS q, TRY_CAST(x AS DOUBLE) AS v, list_transform({_all(C.PLAIN_NUMBER, 'q')}, lambda y: CAST(y AS DOUBLE)) AS n FROM w) SELECT question_id, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _CHECKS.items())} FROM c",
}
