"""SQL with the same rows as the queries, for DuckDB."""

from __future__ import annotations

from routeloom.functions.text import CURRENCY, EQUATION, FRACTION, NUMBER, PERCENT, SENTENCE_END, WORDS
from routeloom.operators.routing import CONSTRAINT_WEIGHTS, REVISE_THRESHOLD
from routeloom.plans.inputs import ANSWERS, CANDIDATES, OUTCOMES

_ESC = "CASE WHEN confidence >= 0.7 AND error < 0.25 THEN 'none' WHEN error >= 0.34 AND confidence <= 0.45 THEN 'strong' WHEN error >= 0.25 THEN 'maybe' ELSE 'none' END"


def _metrics(routes: dict[str, str]) -> str:
    long = " UNION ALL ".join(f"SELECT regime, rg, dpr, '{k}' AS route, ({v}) AS revise FROM o" for k, v in routes.items())
    return f"""long AS ({long}), m AS (SELECT regime, route, count(*) AS n, CAST(sum(CASE WHEN revise THEN dpr ELSE rg END) AS DOUBLE) / count(*) AS accuracy,
      1 + CAST(sum(CAST(revise AS INT)) AS DOUBLE) / count(*) AS avg_cost, CAST(sum(CAST(revise AS INT)) AS DOUBLE) / count(*) AS revise_rate FROM long GROUP BY regime, route)"""


_POLICIES = f"WITH {OUTCOMES}, " + _metrics({"reasoning_greedy": "false", "direct_plus_revise": "true", "unified_rule": f"({_ESC}) <> 'none'", "confidence_threshold": "confidence < 0.5", "oracle": "rg = 0 AND dpr = 1"})
_SWEEP = f"""WITH {OUTCOMES}, t AS (SELECT CAST(i AS DOUBLE) / 20 AS threshold FROM range(21) r(i)),
 sweep AS (SELECT regime, threshold, count(*) AS n, CAST(sum(CASE WHEN confidence < threshold THEN dpr ELSE rg END) AS DOUBLE) / count(*) AS accuracy,
  1 + CAST(sum(CAST(confidence < threshold AS INT)) AS DOUBLE) / count(*) AS avg_cost, CAST(sum(CAST(confidence < threshold AS INT)) AS DOUBLE) / count(*) AS revise_rate
  FROM o, t GROUP BY regime, threshold)"""
_CURVE = f"""WITH {OUTCOMES}, t AS (SELECT 1 + CAST(i AS DOUBLE) / 10 AS target FROM range(11) r(i)), n AS (SELECT regime, count(*) AS n FROM o GROUP BY regime),
 k AS (SELECT regime, target, n, CAST(round_even(n * (target - 1), 0) AS BIGINT) AS k FROM n, t),
 ranked AS (SELECT regime, rg, dpr, row_number() OVER (PARTITION BY regime ORDER BY dpr - rg DESC, question_id) AS r FROM o),
 curve AS (SELECT k.regime, target, k, CAST(sum(CASE WHEN r <= k THEN dpr ELSE rg END) AS DOUBLE) / max(n) AS accuracy, 1 + CAST(k AS DOUBLE) / max(n) AS avg_cost
  FROM k JOIN ranked USING (regime) GROUP BY k.regime, target, k)"""


def _word(words: str, text: str = "t") -> str:
    w = words.replace("'", "''")
    return rf"regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:{w})([^\p{{L}}\p{{N}}_]|$)')"


_NUMS = f"regexp_extract_all(t, '{NUMBER}')"
_VALUES = f"list_transform({_NUMS}, lambda x: CAST(regexp_replace(x, '[,_]', '', 'g') AS DOUBLE))"
_SENTS = rf"list_filter(regexp_split_to_array(t, '{SENTENCE_END}'), lambda x: regexp_matches(x, '\S'))"
_TOKENS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_F = f"""f AS (SELECT doc_id, t, length(t) AS chars, {_VALUES} AS v, {_NUMS} AS toks, {_SENTS} AS s, {_word(WORDS['multi_step'])} AS multi, regexp_matches(t, '{EQUATION}') AS eq FROM d)"""
_RANGE = "CASE WHEN len(v) >= 2 THEN list_max(v) - list_min(v) ELSE 0 END"
_VERBS = rf"len(list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}_]+'), lambda x: list_contains(string_split('{WORDS['operation']}', '|'), x))))"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)"
_CLEAN = f"CASE WHEN regexp_matches({_PRICE}, '[.]') THEN regexp_replace(regexp_replace({_PRICE}, '0+$', ''), '[.]$', '') ELSE {_PRICE} END"


def _vote(where: str, tie: str) -> str:
    return f"""WITH {ANSWERS}, n AS (SELECT question_id, answer, count(*) AS n, min(position) AS p FROM v {where} GROUP BY question_id, answer),
     r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, {tie}) AS r, max(n) OVER (PARTITION BY question_id) AS top, sum(n) OVER (PARTITION BY question_id) AS total FROM n)
     SELECT question_id, max(CASE WHEN r = 1 THEN answer END) AS winner, max(top) AS n_winner, CAST(max(total) AS BIGINT) AS n_votes, sum(CASE WHEN n = top THEN 1 ELSE 0 END) > 1 AS tie,
       max(CASE WHEN r = 1 THEN answer END) = '' AS ambiguous FROM r GROUP BY question_id"""


_ACTIONS = [f"a{i}" for i in range(1, 8)]
_WIDE = f"WITH {CANDIDATES}, w AS (SELECT prompt_id, " + ", ".join(f"max(CASE WHEN action = '{a}' THEN {c} END) AS {c}_{a}" for a in _ACTIONS for c in ("correct", "cost")) + " FROM c GROUP BY prompt_id)"
_LABELS = f"""WITH {CANDIDATES}, l AS (SELECT prompt_id, max(correct) AS any_correct, CAST(sum(correct) AS BIGINT) AS n_correct,
  arg_min(action, (cost, action)) AS cheapest_action, coalesce(arg_min(action, (cost, action)) FILTER (WHERE correct = 1), arg_min(action, (cost, action))) AS label FROM c GROUP BY prompt_id)"""
_FLAGS = "[" + ", ".join(f"coalesce(correct_{a}, 0)" for a in _ACTIONS) + "]"
_GROUP = "CASE WHEN rg = 1 AND dpr = 1 THEN 'both' WHEN rg = 1 THEN 'reasoning_only' WHEN dpr = 1 THEN 'revise_only' ELSE 'none' END"
_ADJ = "(CASE WHEN final_utility > 0.75 AND action NOT IN ('a3', 'a4') THEN 0.03 ELSE 0 END + CASE WHEN cost / 50.0 > 0.35 AND action IN ('a3', 'a4') THEN 0.05 ELSE 0 END - CASE WHEN correct <> 1 AND action = 'a1' THEN 0.04 ELSE 0 END - CASE WHEN action = 'a1' THEN 0.03 ELSE 0 END)"
_SIGNALS = [f"CAST(l_partkey % {i + 3} = 0 AS INT)" for i in range(len(CONSTRAINT_WEIGHTS))]
_SCORE = " + ".join(f"{w} * {x}" for w, x in zip(CONSTRAINT_WEIGHTS.values(), _SIGNALS))
_R = lambda k: f"CAST((l_partkey * {k} % 101) AS DOUBLE) / 100"
_MEAN = f"(({_R(3)} + {_R(7)} + {_R(11)}) / 3)"
_S = lambda k: f"least(greatest(0.5 * {_R(k)} + 0.5 * {_MEAN}, 0), 1)"
_FEATURES = {"low_confidence": "confidence < 0.5", "high_error": "error >= 0.34", "long": "tokens > 150"}
_D = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END"

_GRID = [(lo, hi) for lo in (None, 20.0, 60.0) for hi in (None, 40.0, 200.0) if (lo, hi) != (None, None) and not (lo and hi and lo > hi)]
_COND = lambda lo, hi: " OR ".join(x for x in (f"tokens <= {lo}" if lo else "", f"tokens >= {hi}" if hi else "") if x)
_NUM = lambda x: f"CAST({x or 'NULL'} AS DOUBLE)"
_TOKEN_GRID = f"WITH {OUTCOMES}, g AS (" + " UNION ALL ".join(f"SELECT {_NUM(lo)} AS low, {_NUM(hi)} AS high, count(*) AS n, CAST(sum(CASE WHEN {_COND(lo, hi)} THEN dpr ELSE rg END) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER ({_COND(lo, hi)}) AS DOUBLE) / count(*) AS revise_rate FROM o" for lo, hi in _GRID) + ")"

ORACLE_SQL = {
    "policy_comparison": f"{_POLICIES} SELECT * FROM m",
    "confidence_sweep": f"{_SWEEP} SELECT * FROM sweep",
    "operating_point": f"""{_SWEEP}, r AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY CASE WHEN avg_cost <= 1.2 + 1e-9 THEN 0 ELSE 1 END,
      CASE WHEN avg_cost <= 1.2 + 1e-9 THEN -accuracy ELSE abs(avg_cost - 1.2) END, avg_cost, threshold) AS r FROM sweep) SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
    "budget_curve": f"{_CURVE} SELECT * FROM curve",
    "cost_ratio_sensitivity": f"{_POLICIES} SELECT regime, route, n, accuracy, (1.0 - revise_rate) + revise_rate * q AS avg_cost, revise_rate, q AS cost_ratio FROM m, (SELECT CAST(unnest([1.5, 2.0, 3.0, 5.0]) AS DOUBLE) AS q)",
    "nearest_point": f"""{_CURVE}, g AS (SELECT regime, target, accuracy, avg_cost, CAST(x AS DOUBLE) AS target_cost FROM curve, (SELECT unnest([1.14, 1.46]) AS x)),
      r AS (SELECT *, row_number() OVER (PARTITION BY regime, target_cost ORDER BY abs(avg_cost - target_cost), avg_cost) AS r FROM g) SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
    "outcome_breakdown": f"""WITH {OUTCOMES} SELECT regime, count(*) AS n, count(*) FILTER (rg = 1 AND dpr = 1) AS both, count(*) FILTER (rg = 1 AND dpr = 0) AS reasoning_only,
      count(*) FILTER (rg = 0 AND dpr = 1) AS revise_only, count(*) FILTER (rg = 0 AND dpr = 0) AS "none" FROM o GROUP BY regime""",
    "policy_efficiency": f"""{_POLICIES}, b AS (SELECT regime, max(accuracy) FILTER (route = 'reasoning_greedy') AS rg, max(accuracy) FILTER (route = 'oracle') AS orc FROM m GROUP BY regime)
      SELECT regime, route, accuracy - rg AS gain, (accuracy - rg) / nullif(avg_cost - 1, 0) AS gain_per_cost, (accuracy - rg) / nullif(orc - rg, 0) AS recovered, orc - accuracy AS oracle_gap FROM m JOIN b USING (regime)""",
    "policy_ranking": f"{_POLICIES} SELECT regime, route, row_number() OVER (PARTITION BY regime ORDER BY accuracy DESC, avg_cost, route) AS place FROM m",
    "escalation_decisions": f"WITH {OUTCOMES} SELECT question_id, {_ESC} AS escalation, CASE WHEN ({_ESC}) = 'none' THEN 'reasoning_greedy' ELSE 'direct_plus_revise' END AS action FROM o",
    "token_router": f"WITH {OUTCOMES.replace('o AS (', 'o0 AS (', 1)}, q AS (SELECT quantile_cont(tokens, 0.1) AS lo, quantile_cont(tokens, 0.9) AS hi FROM o0), o AS (SELECT * FROM o0, q), " + _metrics({"low": "tokens <= lo", "high": "tokens >= hi", "both": "tokens <= lo OR tokens >= hi"}).replace("regime, rg, dpr, '", "regime, rg, dpr, '") + " SELECT * FROM m",
    "ranked_escalation": f"WITH {OUTCOMES} SELECT question_id, instance, row_number() OVER (PARTITION BY instance ORDER BY error + tokens DESC, question_id) <= 2 AND error + tokens >= 50 AS escalate FROM o",
    "weighted_signals": f"SELECT l_partkey, score, n_signals, CASE WHEN score >= {REVISE_THRESHOLD} THEN 'direct_plus_revise' ELSE 'reasoning_greedy' END AS action FROM (SELECT DISTINCT l_partkey, {_SCORE} AS score, {' + '.join(_SIGNALS)} AS n_signals FROM lineitem)",
    "question_features": f"""WITH {_DOCS}, {_F} SELECT doc_id, chars AS question_length_chars, {_TOKENS.format('t')} AS question_length_tokens_approx, len(v) AS num_numeric_mentions, len(s) AS num_sentences_approx,
      multi AS has_multi_step_cue, eq AS has_equation_like_pattern, regexp_matches(t, '{PERCENT}') AS has_percent_symbol, regexp_matches(t, '{FRACTION}') AS has_fraction_pattern, regexp_matches(t, '{CURRENCY}') AS has_currency_symbol,
      coalesce(list_max(v), 0) AS max_numeric_value_approx, coalesce(list_min(v), 0) AS min_numeric_value_approx, {_RANGE} AS numeric_range_approx, len(toks) <> len(list_distinct(toks)) AS repeated_number_flag FROM f""",
    "target_features": f"""WITH {_DOCS}, {_F} SELECT doc_id, {_word(WORDS['remaining'])} AS asks_remaining_or_left, {_word(WORDS['total'])} AS asks_total, {_word(WORDS['difference'])} AS asks_difference, {_word(WORDS['rate'])} AS asks_rate_or_unit,
      {_word(WORDS['money'])} OR regexp_matches(t, '{CURRENCY}') AS asks_money, {_word(WORDS['time'])} AS asks_time, {_word(WORDS['subtraction'])} AS has_subtraction_trap_verb, {_word(WORDS['addition'])} AS has_addition_trap_structure,
      {_VERBS} >= 2 AS has_multi_operation_hint, len(s) >= 3 AND len(v) >= 3 AND NOT ({_word(WORDS['total'])} OR {_word(WORDS['remaining'])}) AS likely_intermediate_quantity_ask,
      len(v) >= 4 AND len(s) > 0 AND {_TOKENS.format('s[-1]')} <= 12 AS potential_answer_echo_risk FROM f""",
    "first_pass_features": rf"""SELECT conv_id, turn, len(regexp_extract_all(t, '{NUMBER}')) > 0 AS first_pass_parse_success, length(t) AS first_pass_output_length,
      regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:final answer|the answer is|therefore|thus|so the|answer:)') OR regexp_matches(t, '[\p{{L}}\p{{N}}_]= [0-9]') AS first_pass_has_final_answer_cue, {_word(WORDS['uncertainty'])} AS first_pass_has_uncertainty_phrase,
      len(regexp_extract_all(t, '{NUMBER}')) AS first_pass_num_numeric_mentions, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 3 AS first_pass_empty_or_malformed_flag FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant')""",
    "question_hardness": f"""WITH {_DOCS}, {_F} SELECT doc_id, round(0.01 * chars + 2.0 * len(v) + 5.0 * CAST(multi AS INT) + 3.0 * CAST(eq AS INT) + 2.0 * {_RANGE}, 4) AS hardness,
      round(0.35 * least(1, CAST(chars AS DOUBLE) / 1200) + 0.35 * least(1, CAST(len(v) AS DOUBLE) / 12) + 0.3 * least(1, CAST(len(s) AS DOUBLE) / 8), 6) AS difficulty FROM f""",
    "numeric_answers": f"SELECT o_orderkey AS question_id, {_CLEAN} AS answer FROM orders",
    "choice_answers": "SELECT o_orderkey AS question_id, chr(CAST(65 + o_orderkey % 10 AS INT)) AS letter FROM orders",
    "boolean_answers": "SELECT o_orderkey AS question_id, CASE (o_orderkey % 10) % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE '' END AS answer FROM orders",
    "text_answers": r"SELECT doc_id, regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '\s+', ' ', 'g'), '^[ .,;:!?]+|[ .,;:!?]+$', '', 'g') AS answer FROM documents",
    "calibration": f"""WITH a AS (SELECT o_orderkey AS question_id, o_orderkey % 10 AS k, o_custkey, {_PRICE} AS price FROM orders),
      b AS (SELECT *, k < 6 AS clean, k % 2 = 0 AS many, k >= 6 AND k < 8 AS several FROM a), c AS (SELECT *, CASE WHEN clean THEN 8 ELSE 3 END - 2 * CAST(many AS INT) - 2 * CAST(several AS INT) AS raw FROM b)
      SELECT question_id, CAST(greatest(raw, 0) AS DOUBLE) / 10 AS predicted_answer_format_confidence, CASE WHEN raw >= 7 THEN 'high_confidence' WHEN raw >= 5 THEN 'medium_confidence' ELSE 'low_confidence' END AS calibration_bin,
      clean AS format_clean_numeric, many AS format_many_numeric_candidates FROM c""",
    "majority_vote_first": _vote("", "p"),
    "majority_vote_least": _vote("WHERE answer <> ''", "answer"),
    "oracle_labels": f"{_LABELS} SELECT * FROM l",
    "best_utility": f"WITH {CANDIDATES} SELECT prompt_id, arg_min(action, (cost - 20 * correct, cost, action)) AS best_action, arg_min(cost, (cost - 20 * correct, cost, action)) AS best_cost, max(20 * correct - cost) AS best_score FROM c GROUP BY prompt_id",
    "pivot_outcomes": f"{_WIDE} SELECT * FROM w",
    "pairwise_wins": f"{_WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (correct_{a} = 1 AND correct_{b} = 0) AS wins, count(*) FILTER (correct_{a} <> correct_{b}) AS disagree, count(*) FILTER (correct_{a} IS NOT NULL AND correct_{b} IS NOT NULL) AS n FROM w" for a in _ACTIONS for b in _ACTIONS if a != b),
    "disagreement": f"{_WIDE}, f AS (SELECT {_FLAGS} AS f FROM w) SELECT count(*) AS n, count(*) FILTER (len(list_distinct(f)) = 1) AS all_same, count(*) FILTER (list_max(f) = 0) AS all_wrong, count(*) FILTER (list_min(f) = 1) AS all_right, count(*) FILTER (list_max(f) = 1) AS oracle_correct FROM f",
    "label_distribution": f"{_LABELS} SELECT label, count(*) AS n, CAST(sum(any_correct) AS BIGINT) AS n_correct FROM l GROUP BY label",
    "binary_metrics": f"""WITH {OUTCOMES}, x AS (SELECT regime, CAST(rg = 0 AND dpr = 1 AS INT) AS t, CAST(confidence < 0.4 AS INT) AS p FROM o),
      k AS (SELECT regime, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 1 AND p = 0) AS fn FROM x GROUP BY regime)
      SELECT regime, tp, fp, tn, fn, {_D('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_D('tp', 'tp + fp')} AS precision, {_D('tp', 'tp + fn')} AS recall, {_D('2 * tp', '2 * tp + fp + fn')} AS f1, {_D('fp', 'fp + tn')} AS fpr FROM k""",
    "group_feature_rates": f"WITH {OUTCOMES}, g AS (SELECT *, {_GROUP} AS grp FROM o), e AS (SELECT unnest(['both', 'reasoning_only', 'revise_only', 'none', 'unknown']) AS grp) " + " UNION ALL ".join(f"SELECT e.grp AS \"group\", '{k}' AS feature, count(g.question_id) AS n, coalesce(CAST(sum(CAST({v} AS INT)) AS DOUBLE) / nullif(count(g.question_id), 0), 0) AS rate FROM e LEFT JOIN g ON e.grp = g.grp GROUP BY e.grp" for k, v in _FEATURES.items()),
    "signal_firing": f"WITH {OUTCOMES} " + " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) FILTER ({v}) AS fires, CAST(count(*) FILTER ({v}) AS DOUBLE) / count(*) AS fraction, count(*) FILTER ({v} AND rg = 0) AS fires_on_wrong FROM o" for k, v in {"low_confidence": "confidence < 0.1", "high_error": "error > 0.9", "never": "false"}.items()),
    "stratified_split": f"""WITH {OUTCOMES}, x AS (SELECT question_id, count(*) OVER w AS n, row_number() OVER (w ORDER BY md5('42|' || question_id), question_id) AS r FROM o WINDOW w AS (PARTITION BY regime, instance)),
      y AS (SELECT *, greatest(floor(0.7 * n), 1) AS a, CASE WHEN n >= 3 THEN greatest(floor(0.15 * n), 1) ELSE 0 END AS b FROM x) SELECT question_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM y""",
    "assembled": "SELECT d.doc_id, source, n_chars, coalesce(CAST(quality AS VARCHAR), '') AS quality, l.doc_id IS NOT NULL AS oracle_label_available FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "missed_revise": f"WITH {OUTCOMES} SELECT question_id, regime FROM o WHERE rg = 0 AND dpr = 1 AND NOT (confidence < 0.3 OR error > 0.7)",
    "regime_union": f"WITH {OUTCOMES} SELECT CASE WHEN question_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS regime, count(*) AS n, CAST(sum(rg) AS BIGINT) AS rg, CAST(sum(CASE WHEN question_id % 2 = 0 THEN dpr END) AS BIGINT) AS dpr, count(*) FILTER (question_id % 2 = 1) AS missing FROM o GROUP BY 1",
    "argmax_actions": f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY final_utility - CAST(0.01 AS DOUBLE) * action_cost DESC, action_cost, action_name DESC) AS r FROM c) SELECT prompt_id, action_name, action_cost, final_utility FROM r WHERE r = 1",
    "candidate_rows": f"""WITH {CANDIDATES} SELECT prompt_id, action_name, action_cost, correct, row_number() OVER w - 1 AS cost_rank, correct - first_value(correct) OVER w AS gain_vs_cheapest FROM c WINDOW w AS (PARTITION BY prompt_id ORDER BY cost, action)""",
    "candidate_utility": f"WITH {CANDIDATES} SELECT prompt_id, action, round(final_utility + {_ADJ} + {_ADJ} - 0.1 * abs(0.5 - final_utility), 6) AS utility FROM c",
    "equal_shares": f"WITH {OUTCOMES} SELECT question_id, 37 // count(*) OVER w + CAST(row_number() OVER (w ORDER BY question_id) <= 37 % count(*) OVER w AS INT) AS share FROM o WINDOW w AS (PARTITION BY instance)",
    "robust_curves": f"SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, round({_S(3)}, 6) AS u0, round(greatest({_S(3)}, {_S(7)}), 6) AS u1, round(greatest({_S(3)}, {_S(7)}, {_S(11)}), 6) AS u2 FROM lineitem",
    "hard_selection": f"WITH {OUTCOMES} SELECT question_id, round(0.7 * (tokens - avg(tokens) OVER ()) / stddev_pop(tokens) OVER () + 0.3 * (error - avg(error) OVER ()) / stddev_pop(error) OVER (), 6) AS z_score FROM o",
    "class_balance": f"WITH {CANDIDATES} SELECT action_name, count(*) AS n, avg(correct) AS mean_correct, avg(CAST(round(final_utility * 100) AS BIGINT)) AS mean_utility FROM c GROUP BY action_name",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS action, count(*) AS n, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS correct FROM events GROUP BY 1, 2",
    "univariate_summary": f"""WITH {OUTCOMES}, u AS (SELECT {_GROUP} AS class, 'tokens' AS feature, CAST(tokens AS DOUBLE) AS v FROM o UNION ALL SELECT {_GROUP}, 'milli', round(confidence * 1000) FROM o),
      g AS (SELECT feature, class, count(*) AS n, avg(v) AS mean FROM u GROUP BY feature, class) SELECT *, max(mean) OVER (PARTITION BY feature) - min(mean) OVER (PARTITION BY feature) AS effect FROM g""",
    "level_distribution": f"WITH {CANDIDATES}, l AS (SELECT unnest(range(7)) AS level) SELECT CAST(level AS INT) AS level, count(c.cost) AS n, CAST(count(c.cost) AS DOUBLE) / (SELECT count(*) FROM c) AS fraction FROM l LEFT JOIN c ON c.cost % 5 = l.level GROUP BY level",
    "gain_table": """WITH k AS (SELECT o_orderkey AS question_id, CAST(o_custkey % 10 < 5 AS INT) AS a, CAST(o_custkey % 10 < 7 AS INT) AS b, CAST(o_custkey % 4 < 3 AS INT) AS c FROM orders)
      SELECT question_id, a AS success_k1, b AS success_k2, c AS success_k3, b - a AS gain_1_to_2, c - b AS gain_2_to_3, c > a AS needs_more, a + b + c = 3 AS always_right, a + b + c = 0 AS never_right FROM k""",
    "compare_datasets": f"""WITH {OUTCOMES}, a AS (SELECT * FROM o WHERE question_id % 5 <> 0), b AS (SELECT question_id, CASE WHEN question_id % 2 = 0 THEN rg END AS rg, dpr FROM o WHERE question_id % 7 <> 0)
      SELECT count(*) FILTER (b.question_id IS NULL) AS only_a, count(*) FILTER (a.question_id IS NULL) AS only_b, count(*) FILTER (a.question_id IS NOT NULL AND b.question_id IS NOT NULL) AS both,
      count(*) FILTER (a.question_id IS NOT NULL AND b.question_id IS NOT NULL AND (a.rg IS DISTINCT FROM b.rg OR a.dpr IS DISTINCT FROM b.dpr)) AS differing FROM a FULL JOIN b ON a.question_id = b.question_id""",
    "token_grid": f"{_TOKEN_GRID} SELECT * FROM g",
    "token_grid_choice": f"{_TOKEN_GRID} SELECT * FROM g ORDER BY abs(revise_rate - 0.3), accuracy DESC, revise_rate, low NULLS FIRST, high NULLS FIRST LIMIT 1",
}
ORACLE_SQL["feature_contrast"] = f"WITH r AS ({ORACLE_SQL['group_feature_rates']}) SELECT feature, max(rate) FILTER (\"group\" = 'revise_only') AS focus_rate, max(rate) FILTER (\"group\" = 'both') AS baseline_rate, max(rate) FILTER (\"group\" = 'revise_only') - max(rate) FILTER (\"group\" = 'both') AS difference FROM r GROUP BY feature"
ORACLE_SQL["dataset_checks"] = f"""WITH s AS ({ORACLE_SQL['stratified_split']}), x AS (SELECT source AS key, doc_id, split FROM documents LEFT JOIN s ON doc_id = question_id),
  g AS (SELECT key, count(*) AS n, sum(CAST(doc_id IS NULL AS INT) + CAST(split IS NULL AS INT)) AS nulls, min(split) <> max(split) AS leaked FROM x GROUP BY key)
  SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(nulls) AS BIGINT) AS nulls, count(*) FILTER (leaked) AS leaked_keys FROM g"""
ORACLE_SQL["best_gini_split"] = f"""WITH {OUTCOMES}, y AS (SELECT 'tokens' AS feature, CAST(tokens AS DOUBLE) AS v, CAST(dpr > rg AS INT) AS y FROM o UNION ALL SELECT 'c', floor(confidence * 100), CAST(dpr > rg AS INT) FROM o),
  g AS (SELECT feature, v, count(*) AS n, sum(y) AS p FROM y GROUP BY feature, v),
  x AS (SELECT feature, v, lead(v) OVER w AS nx, CAST(sum(n) OVER w AS DOUBLE) AS nl, CAST(sum(p) OVER w AS DOUBLE) AS pl, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS nt, CAST(sum(p) OVER (PARTITION BY feature) AS DOUBLE) AS pt FROM g WINDOW w AS (PARTITION BY feature ORDER BY v)),
  z AS (SELECT feature, (v + nx) / 2 AS threshold, round((nl - (pl * pl + (nl - pl) * (nl - pl)) / nl + (nt - nl) - ((pt - pl) * (pt - pl) + (nt - nl - pt + pl) * (nt - nl - pt + pl)) / (nt - nl)) / nt, 12) AS impurity FROM x WHERE nx IS NOT NULL)
  SELECT feature, threshold, impurity FROM z ORDER BY impurity, feature, threshold LIMIT 1"""
ORACLE_SQL["rule_policy"] = """WITH x AS (SELECT o_orderkey AS question_id, o_orderkey % 6 AS n, o_custkey % 90 AS w, o_orderkey % 3 = 0 AS multi, o_custkey % 4 = 0 AS failed,
  o_custkey % 4 = 0 OR o_orderkey % 5 = 0 AS unstable, o_custkey % 7 >= 4 AS many FROM orders)
  SELECT question_id, CASE WHEN n <= 2 AND NOT multi AND w <= 35 THEN 'direct_greedy' ELSE 'reasoning_greedy' END AS first,
  CASE WHEN NOT (unstable OR many) THEN 'reasoning_greedy' WHEN (n >= 4 OR (multi AND w >= 60)) AND failed THEN 'strong_direct'
   WHEN (n >= 4 OR (multi AND w >= 60)) AND many THEN 'reasoning_best_of_3' ELSE 'direct_plus_revise' END AS action FROM x"""
ORACLE_SQL["math_answers"] = f"SELECT o_orderkey AS question_id, {_CLEAN} AS answer FROM orders"
