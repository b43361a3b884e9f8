"""Queries of answer matching, candidates, simulated allocation and learned scores, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeloom.functions import answers as A
from routeloom.functions import matching as M
from routeloom.functions import text as T
from routeloom.operators import allocation, boosting, candidates, features, learned, matrix, multiclass, neural, outcomes, policies, simulated, statistics
from routeloom.plans import inputs as I
from routeloom.plans import policy_sql, queries
from routeloom.plans.inputs import CANDIDATES, OUTCOMES, WORD_PROBLEMS
from routeloom.plans.sql import _DOCS, _TOKENS, _WIDE, _word
from routeloom.plans.sql import ORACLE_SQL as BASE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


# ---------------------------------------------------------------- answers

_NORM = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}), '[$,]', '', 'g'), '\.+$', ''), '^(-?[0-9]+(?:\.[0-9]*[1-9])?)\.?0*$', '\1'), '^(-?)0+([0-9]+(?:\.[0-9]+)?)$', '\1\2')"
_LAST = lambda x: f"coalesce({_NORM(f'''regexp_extract_all({x}, '{A.ANSWER_NUMBER}')[-1]''')}, '')"
_BOXED = r"regexp_extract_all(t, '\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1)[-1]"
_LINES = lambda x: rf"list_filter(list_transform(string_split_regex({x}, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '')"


def numeric_sql(source: str, out: str, column: str = "t", keep: str = "*") -> str:
    """Two common table expressions: `out` has the rows of source and `answer`, the numeric answer of a text column."""
    parts = f"string_split_regex(t, '{A.FINAL_CUE}')"
    pick = [_LAST("box"), rf"{_LAST('''string_split_regex(tr, '\r\n|\r|\n')[1]''')}", _LAST("substr(tr, 1, 200)"), _LAST("array_to_string(lines[-3:], chr(10))"), _LAST("t")]
    options = ", ".join(f"nullif({p}, '')" for p in pick)
    return f"""{out}0 AS (SELECT {keep}, trim(coalesce({column}, '')) AS t FROM {source}),
      {out}1 AS (SELECT *, {_BOXED} AS box, CASE WHEN len({parts}) > 1 THEN {parts}[-1] END AS tr, {_LINES('t')} AS lines FROM {out}0),
      {out} AS (SELECT * EXCLUDE (box, tr, lines), coalesce({options}, '') AS answer FROM {out}1)"""


def _first(*options: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({o}, '')" for o in options) + ", '')"


_STRIPPED = lambda x: rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"
_LONE = rf"list_filter(list_transform(list_reverse({_LINES('s')})[1:5], lambda x: regexp_extract(x, '{M.LONE_LETTER}', 1)), lambda x: x <> '')"
_OPTION = "upper(" + _first(*[f"regexp_extract(s, '{p}', 1)" for p in (M.BOXED_LETTER, M.SAID_LETTER, M.BRACKETED_LETTER)], f"{_LONE}[1]", "regexp_extract(right(s, 80), '(?s)^.*([A-Da-d])', 1)") + ")"


@query(f"SELECT doc_id, {_OPTION} AS letter FROM (SELECT doc_id, {_STRIPPED('text')} AS s FROM documents)")
def option_letters(s, d):
    return I.read(s, d, "documents").select("doc_id", M.option_letter(F.col("text")).alias("letter"))


_TOKEN = r"list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}\p{M}_]+'), lambda x: list_contains(['true', 'false', 'yes', 'no', 'y', 'n', '0', '1'], x))[-1]"
_CHOICE = "upper(coalesce(" + ", ".join((f"regexp_extract_all(t, '{A.LETTER_FINAL}', 1)[-1]", r"regexp_extract_all(t, '\(\s*([A-Ja-j])\s*\)', 1)[-1]",
    r"list_filter(regexp_split_to_array(array_to_string(lines[-5:], chr(10)), '[^A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Ja-j]'))[-1]", "''")) + "))"


@query(f"""WITH {numeric_sql('documents', 'n', 'text', 'doc_id')}, c AS (SELECT *, {_TOKEN} AS token, {_LINES('t')} AS lines FROM n)
  SELECT doc_id, answer AS number, CASE WHEN token IN ('true', 'yes', 'y', '1') THEN 'true' WHEN token IS NULL THEN '' ELSE 'false' END AS truth, {_CHOICE} AS choice FROM c""")
def document_answers(s, d):
    t = F.col("text")
    return I.read(s, d, "documents").select("doc_id", A.numeric_answer(t).alias("number"), A.boolean_answer(t).alias("truth"), A.choice_letter(t).alias("choice"))


# Boxes and braces planted all over the texts: every sentence starts a box, "th" and "en" open and "on" and "er" close.
_BRACED = "replace(replace(replace(replace(replace(coalesce(text, ''), '. ', '. \\boxed{ '), 'th', '{'), 'en', '{'), 'on', '}'), 'er', '}')"


@query(f"""WITH b AS (SELECT doc_id, {_BRACED} AS t FROM documents), p AS (SELECT doc_id, string_split(t, '\\boxed{{') AS parts FROM b),
  r AS (SELECT doc_id, parts[-1] AS rest FROM p WHERE len(parts) > 1),
  c AS (SELECT doc_id, unnest(string_split(rest, '')) AS ch, unnest(range(1, length(rest) + 1)) AS i FROM r WHERE rest <> ''),
  w AS (SELECT doc_id, i, 1 + sum(CASE ch WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c),
  z AS (SELECT doc_id, min(i) FILTER (depth = 0) AS stop FROM w GROUP BY doc_id)
  SELECT b.doc_id, CASE WHEN stop IS NULL THEN '' ELSE regexp_replace(left(rest, CAST(stop - 1 AS INT)), '^\\s+|\\s+$', '', 'g') END AS content FROM b LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)""")
def boxed_answers(s, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    for old, new in ((". ", ". \\boxed{ "), ("th", "{"), ("en", "{"), ("on", "}"), ("er", "}")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return I.read(s, d, "documents").select("doc_id", A.boxed(t).alias("content"))


@query("""SELECT o_orderkey AS question_id, o_orderkey % 8 IN (0, 1, 2, 6, 7) AS by_number, o_orderkey % 8 IN (0, 1, 2, 7) AS by_form, o_orderkey % 8 IN (1, 7) AS exact,
  o_orderkey % 5 < 2 AS by_letter FROM orders""")
def answer_matches(s, d):
    price, k = F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.col("o_orderkey") % 8
    said = F.when(k == 0, F.concat(F.lit("$"), price, F.lit("."))).when(k == 1, F.concat(F.lit(" \t"), price, F.lit("\n"))).when(k == 2, F.concat(F.lit("0"), price)).when(k == 3, F.concat(price, F.lit("1"))).when(k == 4, "  ").when(k == 5, "none")
    said = said.when(k == 6, F.concat(F.lit("+"), price)).otherwise(price)
    m = F.col("o_orderkey") % 5
    gold = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    letter = F.when(m == 0, gold).when(m == 1, F.concat(F.lit(" "), F.lower(gold))).when(m == 2, F.concat(F.lit("("), gold, F.lit(")"))).when(m == 3, "E")
    return I.read(s, d, "orders").select(
        F.col("o_orderkey").alias("question_id"), M.answers_match(price, said, "numeric").alias("by_number"), M.answers_match(price, F.when(k != 1, said).otherwise(F.concat(F.lit(" "), price)), "math").alias("by_form"),
        M.exact_match(said, price).alias("exact"), M.answers_match(gold, letter, "mcq").alias("by_letter"))


_MESSAGES = {"config": "Missing OPENAI_API_KEY in env", "quota": "Error 429: insufficient_quota", "rate_limit": "Rate limit reached", "model_access": "The model does not exist", "network": "Request timed out", "unknown": "boom"}


@query("SELECT o_orderkey AS question_id, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_MESSAGES)) + " ELSE 'unknown' END AS class FROM orders")
def access_errors(s, d):
    message = F.element_at(F.array(*map(F.lit, _MESSAGES.values()), F.lit(None)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return I.read(s, d, "orders").select(F.col("o_orderkey").alias("question_id"), M.access_error(message).alias("class"))


_BUCKET = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {p!r})' for p in parts)} THEN '{k}'" for k, parts in M.PATTERNS.items()) + " ELSE 'other' END"


@query(f"SELECT doc_id, {_BUCKET} AS pattern FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def pattern_buckets(s, d):
    return I.read(s, d, "documents").select("doc_id", M.pattern_bucket(F.col("text")).alias("pattern"))


_UNSURE = _word(T.WORDS["uncertainty"])
_DEC = lambda x: _NORM(x)  # noqa: E731  # of numbers without a plus sign, as word problems have
_ROUTER = f"""WITH {WORD_PROBLEMS}, cf AS ({policy_sql.ORACLE_SQL['constraint_flags']}), {numeric_sql('w', 'm', 't', 'question_id, q')},
  ends AS (SELECT question_id AS line_id, coalesce({_LINES('t')}[-1], '') AS last FROM w), {numeric_sql('ends', 'l', 'last', 'line_id')},
  r AS (SELECT m.question_id, m.t, m.answer, l.answer AS last_answer, cf.n_signals, {_UNSURE.replace('(t,', '(m.t,')} AS unsure, length(regexp_replace(m.t, '^\\s+|\\s+$', '', 'g')) < 3 AS malformed,
    len(list_distinct(list_filter(list_transform(regexp_extract_all(right({_STRIPPED('m.t')}, 400), '{M.TAIL_NUMBER}'), lambda x: {_DEC('x')}), lambda x: x <> ''))) >= 2 AS tail_disagrees
    FROM m JOIN cf USING (question_id) JOIN l ON l.line_id = m.question_id),
  c AS (SELECT *, greatest(least((CASE WHEN answer <> '' THEN 1.0::DOUBLE ELSE 0.25 END) * (CASE WHEN unsure THEN 0.55::DOUBLE ELSE 1.0 END) * greatest(0.15::DOUBLE, 1.0 - 0.12::DOUBLE * n_signals) * (CASE WHEN malformed THEN 0.4::DOUBLE ELSE 1.0 END), 1.0), 0.0) AS confidence,
    answer <> '' AND last_answer <> '' AND answer <> last_answer AS final_differs FROM r)
  SELECT question_id, round(confidence, 6) AS confidence, tail_disagrees, final_differs, confidence < 0.45 OR final_differs OR n_signals > 0 OR tail_disagrees OR unsure OR answer = '' AS escalate FROM c"""


@query(_ROUTER)
def output_router(s, d):
    w = I.word_problems(s, d).withColumn("answer", A.numeric_answer(F.col("t")))
    return M.with_output_router(w, "q", "t", "answer").select("question_id", F.round("confidence", 6).alias("confidence"), "tail_disagrees", "final_differs", "escalate")


_NUMS = lambda x: f"len(regexp_extract_all({x}, '{T.NUMBER}'))"
_SIGNALS = f"""WITH {WORD_PROBLEMS}, {numeric_sql('w', 'm', 't', 'question_id, q')}, t0 AS (SELECT question_id AS tail_id, right(t, 400) AS tail FROM w), {numeric_sql('t0', 'l', 'tail', 'tail_id')},
  x AS (SELECT m.*, l.answer AS tail_answer, {_UNSURE.replace('(t,', '(m.t,')} AS unsure, {_word(T.WORDS['multi_step'], 'q')} AS multi FROM m JOIN l ON l.tail_id = m.question_id)
  SELECT question_id, CAST(answer <> '' AND tail_answer <> '' AND answer <> tail_answer AS INT) AS extraction_tail_mismatch, CAST({_NUMS('q')} >= 3 AND {_NUMS('t')} <= 1 AND length(t) < 80 AS INT) AS reasoning_length_short_vs_question,
    1.0 / (1 + CAST(unsure AS INT)) AS confidence_proxy, round(0.01 * length(q) + 2.0 * {_NUMS('q')} + 5.0 * CAST(multi AS INT), 6) AS difficulty_proxy FROM x"""


@query(_SIGNALS)
def first_pass_signals(s, d):
    w = I.word_problems(s, d).withColumn("answer", A.numeric_answer(F.col("t")))
    x = M.first_pass_signals(F.col("q"), F.col("t"), F.col("answer"))
    return w.select("question_id", "answer", "q", "t").select("question_id", *[x[k].alias(k) for k in ("extraction_tail_mismatch", "reasoning_length_short_vs_question", "confidence_proxy")], F.round(x["difficulty_proxy"], 6).alias("difficulty_proxy"))


# ---------------------------------------------------------------- candidates

_NAMED = "CASE action WHEN 'a1' THEN 'direct_greedy' WHEN 'a2' THEN 'reasoning_greedy' ELSE 'direct_plus_revise_' || action END"


def _rows(s, d):
    a = F.col("action")
    named = F.when(a == "a1", "direct_greedy").when(a == "a2", "reasoning_greedy").otherwise(F.concat(F.lit("direct_plus_revise_"), a))
    w = I.word_problems(s, d).select(F.col("question_id").alias("prompt_id"), F.col("q").alias("question"))
    c = I.candidates(s, d).withColumn("action_name", named).withColumns({"feat_unified_confidence_score": F.col("final_utility"), "feat_fp_first_pass_parse_success": F.col("correct").cast("double"), "feat_role_warning_score": F.col("cost") / 50})
    return c.join(w, "prompt_id")


@query(f"""WITH {CANDIDATES}, {WORD_PROBLEMS}, j AS (SELECT c.*, {_NAMED} AS name, w.q FROM c JOIN w ON w.question_id = c.prompt_id),
  f AS (SELECT *, CAST({_TOKENS.format('q')} AS DOUBLE) AS words, CAST(len(regexp_extract_all(q, '-?[0-9]+(?:\\.[0-9]+)?')) AS DOUBLE) AS nums, CAST(contains(name, 'revise') AS DOUBLE) AS revise, CAST(contains(name, 'reasoning') AS DOUBLE) AS reasoning,
    CAST(contains(name, 'direct') AS DOUBLE) AS direct, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY action_cost, name) - 1 AS DOUBLE) AS cost_rank FROM j)
  SELECT prompt_id, name AS action_name, CAST(length(q) AS DOUBLE) AS chars, words, nums, cost_rank, CAST(contains(q, '?') AS DOUBLE) AS asks, round((words / 50.0 + nums / 5.0) * revise, 6) AS complexity_x_revise,
    (1 - correct) * direct AS parse_risk_x_direct, round(final_utility * reasoning, 6) AS confidence_x_reasoning, CAST(1 - correct > 0.3 AND revise > 0.5 AS DOUBLE) AS revise_favorable, CAST(final_utility > 0.75 AND revise < 0.5 AS DOUBLE) AS cheap_safe,
    round(CAST(0.4 AS DOUBLE) * (1 - correct) + CAST(0.3 AS DOUBLE) * least(1.0, CAST(cost AS DOUBLE) / 50), 6) AS risk FROM f""")
def candidate_features(s, d):
    x = candidates.apply_families(_rows(s, d), list(candidates.FAMILIES))
    h = lambda a, b: F.col(f"hfeat_{a}").alias(b)
    r = lambda a, b: F.round(f"hfeat_{a}", 6).alias(b)
    return x.select(
        "prompt_id", "action_name", h("prompt_length_chars", "chars"), h("prompt_length_tokens", "words"), h("prompt_num_count", "nums"), h("action_cost_rank", "cost_rank"), h("prompt_has_question_mark", "asks"),
        r("interaction_complexity_x_revise", "complexity_x_revise"), h("interaction_parse_risk_x_direct", "parse_risk_x_direct"), r("interaction_confidence_x_reasoning", "confidence_x_reasoning"),
        h("heuristic_revise_favorable", "revise_favorable"), h("heuristic_cheap_safe", "cheap_safe"), r("risk_composite", "risk"))


@query(f"""WITH {CANDIDATES}, w AS (SELECT *, row_number() OVER k - 1 AS r, correct - first_value(correct) OVER k AS gain FROM c WINDOW k AS (PARTITION BY prompt_id ORDER BY cost, action))
  SELECT prompt_id, action_name, gain <= 0 AND r > 0 AS dominated FROM w""")
def dominated_actions(s, d):
    """Over all seven actions of a prompt, those that it lacks left out."""
    wide = queries.pivot_outcomes(s, d)
    long = allocation.candidate_rows(wide, "prompt_id", {a: (f"correct_{a}", f"cost_{a}") for a in queries.ACTIONS})
    return long.select("prompt_id", "action_name", candidates.dominated(F.col("gain_vs_cheapest"), F.col("cost_rank")).alias("dominated"))


_ARGMAX = f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY final_utility - CAST(0.01 AS DOUBLE) * action_cost DESC, action_cost, action_name DESC) AS r FROM c), g AS (SELECT * FROM r WHERE r = 1)"


@query(f"{_ARGMAX} SELECT count(*) AS num_prompts, avg(correct) AS final_accuracy, avg(action_cost) AS average_cost, round(avg(final_utility), 9) AS average_utility FROM g")
def chosen_averages(s, d):
    averages, _ = candidates.chosen_actions(I.candidates(s, d), queries.argmax_actions(s, d))
    return averages.withColumn("average_utility", F.round("average_utility", 9))


@query(f"{_ARGMAX} SELECT action_name, count(*) AS n FROM g GROUP BY action_name")
def chosen_distribution(s, d):
    return candidates.chosen_actions(I.candidates(s, d), queries.argmax_actions(s, d))[1]


_PICKS = {"cheapest_only": "action_cost, action_name", "always_expensive": "action_cost DESC, action_name DESC", "oracle_upper_bound": "correct DESC, action_cost, action_name DESC"}


@query(f"WITH {CANDIDATES}, " + ", ".join(f"{k} AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {o}) AS r FROM c)" for k, o in _PICKS.items())
       + " " + " UNION ALL ".join(f"SELECT '{k}' AS baseline, count(*) AS n, avg(correct) AS accuracy, avg(action_cost) AS avg_cost FROM {k} WHERE r = 1" for k in _PICKS))
def simple_baselines(s, d):
    return candidates.simple_baselines(I.candidates(s, d))


@query(f"""WITH {OUTCOMES}, x AS (SELECT dpr, question_id % 4 = 0 AS a, instance % 3 AS k, question_id % 5 < 3 AS g, question_id % 5 = 0 AS e FROM o WHERE rg <> dpr),
  c AS (SELECT dpr, CASE WHEN a AND k = 1 THEN 1 WHEN g AND NOT e THEN 2 WHEN e THEN 3 ELSE 4 END AS cause FROM x)
  SELECT count(*) FILTER (dpr = 1) AS queries_improved, count(*) FILTER (dpr = 0) AS queries_worsened, count(*) FILTER (cause = 1) AS normalization_only, count(*) FILTER (cause = 2) AS gating_stage_only,
    count(*) FILTER (cause = 3) AS true_post_ranking_escalation, count(*) FILTER (cause = 4) AS unattributed FROM c""")
def change_attribution(s, d):
    o, q = I.outcomes(s, d), F.col("question_id")
    target = o.select(q, F.col("dpr").alias("correct"), (q % 4 == 0).alias("normalized"), (F.col("instance") % 3).alias("samples"), (q % 5 < 3).alias("gated"), (q % 5 == 0).alias("escalated"))
    return candidates.change_attribution(o.select(q, F.col("rg").alias("correct")), target, "question_id")


_HAVE = "list_filter([" + ", ".join(f"correct_a{i}" for i in range(1, 8)) + "], lambda x: x IS NOT NULL)"
_UTIL = "list_filter([" + ", ".join(f"correct_a{i} - CAST(0.05 AS DOUBLE) * cost_a{i}" for i in range(1, 8)) + "], lambda x: x IS NOT NULL)"


@query(f"{_WIDE}, u AS (SELECT prompt_id, {_HAVE} AS c, {_UTIL} AS u FROM w), m AS (SELECT *, list_max(u) AS mu, list_max(c) AS mc FROM u) "
       "SELECT prompt_id, len(list_filter(c, lambda x: x = mc)) > 1 AS accuracy_tie, len(list_filter(u, lambda x: abs(x - mu) < 1e-12)) > 1 AS utility_tie FROM m")
def label_ties(s, d):
    w = queries.pivot_outcomes(s, d)
    return w.select("prompt_id", *candidates.label_ties(w, queries.ACTIONS, 0.05))


@query(f"""WITH {OUTCOMES} SELECT question_id, CASE WHEN question_id % 50 = 0 THEN 'case_table' WHEN rg = 1 THEN 'direct_already_enough' WHEN tokens % 3 <> 0 AND dpr = 1 THEN 'revise_helps' WHEN tokens % 7 = 0 THEN 'unique_other_strategy_case'
  WHEN tokens % 2 = 0 THEN 'revise_not_enough' ELSE 'reasoning_enough' END AS "group" FROM o""")
def extended_groups(s, d):
    o, t = I.outcomes(s, d), F.col("tokens")
    g = candidates.extended_group(F.col("rg"), F.when(t % 3 != 0, F.col("dpr")), (t % 2).cast("int"), (t % 7 == 0).cast("int"))
    cases = o.where("question_id % 50 = 0").select("question_id", F.lit("case_table").alias("group"))
    return candidates.with_override(o.select("question_id", g.alias("group")), cases, "question_id", "group")


_SCORES = "tokens % 5 AS a, tokens % 6 AS e"
_ROUTES = {"explanation_only_router": "e >= 3", "answer_error_only_router": "a >= 2", "combined_equal_router": "a + e >= 3", "answer_error_dominant_router": "2 * a + e >= 4", "explanation_dominant_router": "a + 2 * e >= 4"}


@query(f"WITH {OUTCOMES}, x AS (SELECT *, {_SCORES} FROM o), l AS (" + " UNION ALL ".join(f"SELECT regime, rg, dpr, '{k}' AS route, {v} AS revise FROM x" for k, v in _ROUTES.items())
       + f") SELECT regime, route, count(*) AS n, {_ratio('sum(CASE WHEN revise THEN dpr ELSE rg END)', 'count(*)')} AS accuracy, 1 + {_ratio('count(*) FILTER (revise)', 'count(*)')} AS avg_cost, {_ratio('count(*) FILTER (revise)', 'count(*)')} AS revise_rate, "
       "count(*) FILTER (revise AND rg = 1 AND NOT (rg = 0 AND dpr = 1)) AS false_positives, count(*) FILTER (NOT revise AND rg = 0 AND dpr = 1) AS false_negatives FROM l GROUP BY regime, route")
def score_routers(s, d):
    o = I.outcomes(s, d)
    routes = candidates.score_routers(F.col("tokens") % 5, F.col("tokens") % 6)
    m = outcomes.route_metrics(o, routes, F.col("rg"), F.col("dpr"), ["regime"])
    return m.join(candidates.routing_errors(o, routes, F.col("rg"), F.col("dpr"), ["regime"]), ["regime", "route"])


@query(f"""WITH p AS ({BASE['policy_comparison']}), r AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY accuracy DESC, avg_cost, route) AS r FROM p WHERE route IN ('unified_rule', 'confidence_threshold'))
  SELECT regime, route, accuracy, avg_cost FROM r WHERE r = 1""")
def best_adaptive(s, d):
    return candidates.best_route(queries.policy_comparison(s, d), ["regime"], ["unified_rule", "confidence_threshold"])


@query(f"""WITH p AS ({BASE['confidence_sweep']}), r AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY accuracy DESC, regime) AS r FROM p), a AS (SELECT * FROM r WHERE r = 1), b AS (SELECT * FROM r WHERE r = 2)
  SELECT a.threshold, a.regime AS best, a.accuracy AS best_accuracy, b.regime AS runner_up, b.accuracy AS runner_up_accuracy, a.accuracy - b.accuracy AS gap FROM a LEFT JOIN b USING (threshold)""")
def runners_up(s, d):
    return candidates.runner_up(queries.confidence_sweep(s, d), "threshold", "regime", "regime")


_BEST = "CASE WHEN rg = 1 THEN 'reasoning_greedy' WHEN v5 = 1 THEN 'adaptive_v5' WHEN dpr = 1 THEN 'direct_plus_revise' ELSE 'reasoning_greedy' END"
_DERIVED = f"""WITH {OUTCOMES}, x AS (SELECT *, CASE WHEN instance % 2 = 0 THEN CAST(question_id % 3 = 0 AS INT) END AS v5 FROM o),
  y AS (SELECT question_id, tokens, confidence, CAST(rg = 0 AND dpr = 1 AS INT) AS revise_helpful, rg AS safe_cheap, CAST(rg = 0 AND dpr = 0 AS INT) AS both_wrong, CAST(rg = 1 AND error > 0.7 AS INT) AS unnecessary_revise_candidate, {_BEST} AS method_best_label FROM x)"""


def _derived(s, d):
    o = I.outcomes(s, d)
    v5 = F.when(F.col("instance") % 2 == 0, (F.col("question_id") % 3 == 0).cast("int"))
    f = candidates.derived_outcomes(F.col("rg"), F.col("dpr"), F.col("error") > 0.7, [("adaptive_v5", v5, F.lit(1.5))])
    return o.select("question_id", "tokens", "confidence", *[c.alias(k) for k, c in f.items()])


@query(f"{_DERIVED} SELECT * EXCLUDE (tokens, confidence) FROM y")
def derived_outcomes(s, d):
    return _derived(s, d).drop("tokens", "confidence")


@query(f"{_DERIVED} SELECT method_best_label, count(*) AS n, round(avg(tokens), 4) AS mean_tokens, round(avg(confidence), 4) AS mean_confidence FROM y GROUP BY method_best_label")
def method_fit(s, d):
    return candidates.means_by(_derived(s, d), "method_best_label", ["tokens", "confidence"])


_ASKS = "CASE " + " ".join(f"WHEN {_word(T.WORDS[w])}{extra} THEN '{k}'" for k, w, extra in (
    ("rate_or_unit", "rate", ""), ("remaining_or_left", "remaining", ""), ("difference", "difference", ""), ("total", "total", ""), ("money", "money", f" OR regexp_matches(t, '{T.CURRENCY}')"), ("time", "time", ""))) + " ELSE 'other' END"


@query(f"""WITH {_DOCS}, k AS (SELECT d.doc_id, {_ASKS} AS target_quantity_type, quality, toxic FROM d JOIN labels l ON d.doc_id = l.doc_id)
  SELECT target_quantity_type, count(*) AS n, round({_ratio('count(*) FILTER (quality = 1)', 'count(*)')}, 4) AS rate_quality, round({_ratio('count(*) FILTER (toxic = 1)', 'count(*)')}, 4) AS rate_toxic FROM k GROUP BY target_quantity_type""")
def target_types(s, d):
    x, parts = T.with_parts(I.read(s, d, "documents").select("doc_id", "text"), "text")
    t = x.select("doc_id", candidates.target_type(T.target_features(F.col("text"), parts)).alias("target_quantity_type"))
    return candidates.rates_by(t.join(I.read(s, d, "labels"), "doc_id"), "target_quantity_type", ["quality", "toxic"])


@query(f"""WITH {WORD_PROBLEMS}, x AS (SELECT q, list_filter([CASE WHEN question_id % 2 = 0 THEN 'missing_required_number' END, CASE WHEN question_id % 3 = 0 THEN 'required_rate_number_missing' END], lambda x: x IS NOT NULL) AS s, lower(q) AS t
    FROM w WHERE question_id % 7 < 4 AND question_id % 5 < 3),
  e AS (SELECT 'signal' AS kind, unnest(s) AS name FROM x UNION ALL SELECT 'pattern', {_BUCKET} FROM x UNION ALL SELECT 'cause', unnest(CASE WHEN len(s) = 0 THEN ['multi_step_over_penalized'] ELSE
    list_transform(s, lambda x: CASE x WHEN 'missing_required_number' THEN 'implicit_usage_missed' ELSE 'operator_cue_over_interpretation' END) END) FROM x)
  SELECT kind, name, count(*) AS n FROM e GROUP BY kind, name""")
def false_positives(s, d):
    q = F.col("question_id")
    signals = F.array_compact(F.array(F.when(q % 2 == 0, "missing_required_number"), F.when(q % 3 == 0, "required_rate_number_missing")))
    return candidates.false_positive_counts(I.word_problems(s, d).select(F.col("q").alias("question"), (q % 7 < 4).cast("int").alias("is_correct"), (q % 5 < 3).alias("flagged"), signals.alias("signals")))


@query(f"""WITH r AS ({BASE['feature_contrast']}) SELECT * FROM r WHERE abs(difference) >= 0.001 ORDER BY abs(difference) DESC, feature LIMIT 2""")
def top_separating(s, d):
    return candidates.top_separating(queries.feature_contrast(s, d), 2, 0.001)


# ---------------------------------------------------------------- simulated allocation

COSTS = [0, 1, 2, 4]
_CURVE = [f"greatest({', '.join(f'CAST((p_partkey * {k} % 101) AS DOUBLE) / 100' for k in (3, 7, 11, 13)[: i + 1])})" if i else "CAST((p_partkey * 3 % 101) AS DOUBLE) / 100" for i in range(4)]


def _curves(s, d):
    """A rising curve of four levels for each part, in instances of some twenty parts."""
    n = F.col("p_partkey")
    x = I.read(s, d, "part").select(F.floor(n / 20).alias("instance"), n.alias("part"))
    raw = F.array(*[(F.col("part") * k % 101 / 100).cast("double") for k in (3, 7, 11, 13)])
    hard = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("part") % 3 + 1).cast("int"))
    return x.select("instance", "part", simulated.rising(raw).alias("curve"), F.when(F.col("part") % 3 < 2, hard).otherwise("easy").alias("difficulty"))


@query(f"""WITH p AS (SELECT p_partkey % 4 AS level, CASE p_partkey % 3 WHEN 1 THEN 'medium' ELSE 'easy' END AS difficulty, [{', '.join(_CURVE)}] AS curve FROM part),
  s AS (SELECT *, [0, 1, 2, 4][level + 1] AS cost, curve[level + 1] AS utility FROM p), e AS (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty), l AS (SELECT difficulty, CAST(unnest(range(4)) AS INT) AS level FROM e)
  SELECT l.difficulty, l.level, count(s.level) FILTER (s.level = l.level) AS n, {_ratio('count(s.level) FILTER (s.level = l.level)', 'count(s.level)')} AS fraction, count(s.level) AS num_queries,
    coalesce(avg(cost), 0) AS average_cost, round(coalesce(avg(utility), 0), 9) AS average_utility FROM l LEFT JOIN s USING (difficulty) GROUP BY l.difficulty, l.level""")
def difficulty_summary(s, d):
    t = simulated.scored(_curves(s, d).withColumn("level", (F.col("part") % 4).cast("int")), COSTS)
    return simulated.by_difficulty(t, 4).withColumn("average_utility", F.round("average_utility", 9))


@query()
def budget_sweep(s, d):
    return simulated.budget_sweep(_curves(s, d), "instance", "part", COSTS, [10, 20, 40])


@query()
def budget_gaps(s, d):
    return simulated.comparison(budget_sweep(s, d), ["instance", "budget"])


@query()
def noise_sweep(s, d):
    return simulated.noise_sweep(_curves(s, d).withColumn("budget", F.lit(25)), "instance", "part", COSTS, {"none": 0.0, "high": 0.2})


@query()
def synthetic_curves(s, d):
    q = I.read(s, d, "orders").select(F.col("o_orderkey").alias("query"))
    return simulated.curves(q, "query", 5)


_SEEDS = """x AS (SELECT o_custkey % 5 AS budget, o_orderkey % 7 AS seed, CAST(o_orderkey % 11 AS DOUBLE) AS equal_utility, CAST(o_custkey % 13 AS DOUBLE) AS mckp_utility FROM orders), y AS (SELECT *, mckp_utility - equal_utility AS gap FROM x)"""


def _seeds(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x = I.read(s, d, "orders").select((c % 5).alias("budget"), (o % 7).alias("seed"), (o % 11).cast("double").alias("equal_utility"), (c % 13).cast("double").alias("mckp_utility"))
    return x.withColumn("gap", F.col("mckp_utility") - F.col("equal_utility"))


_SUMMARY = ", ".join(f"round({f}({c}), 9) AS {k}_{n}" for n, c in (("equal_utility", "equal_utility"), ("mckp_utility", "mckp_utility"), ("utility_gap", "gap")) for k, f in (("mean", "avg"), ("std", "stddev_pop")))


@query(f"WITH {_SEEDS} SELECT budget, count(*) AS n_seeds, {_SUMMARY}, {_ratio('count(*) FILTER (gap > 0)', 'count(*)')} AS fraction_mckp_beats_equal FROM y GROUP BY budget")
def seed_summary(s, d):
    g = simulated.seed_summary(_seeds(s, d), ["budget"])
    return g.withColumns({c: F.round(c, 9) for c in g.columns if c.startswith(("mean", "std"))})


@query(f"""WITH {_SEEDS}, b AS (SELECT budget, avg(gap) AS g FROM y GROUP BY budget), n AS (SELECT 'level_' || seed AS name, CAST(seed AS DOUBLE) / 10 AS sd, avg(gap) - seed AS g FROM y GROUP BY seed)
  SELECT (SELECT arg_max(budget, (g, -budget)) FROM b) AS budget_where_gap_peaks, (SELECT round(max(g), 9) FROM b) AS peak_gap, (SELECT min(budget) FROM b WHERE g <= 1.0) AS budget_where_gap_becomes_small, (SELECT round(avg(g), 9) FROM b) AS average_gap,
    (SELECT arg_min(name, sd) FROM n WHERE g <= 0) AS noise_without_gain, (SELECT min(sd) FROM n WHERE g <= 0) AS noise_std_without_gain""")
def key_findings(s, d):
    y = _seeds(s, d)
    b = y.groupBy("budget").agg(F.avg("gap").alias("mean_utility_gap"))
    n = y.groupBy("seed").agg((F.avg("gap") - F.first("seed")).alias("mean_utility_gap")).select(F.concat(F.lit("level_"), F.col("seed").cast("string")).alias("noise_name"), (F.col("seed") / 10).alias("noise_std"), "mean_utility_gap")
    k = simulated.key_findings(b, n, 1.0)
    return k.withColumns({"peak_gap": F.round("peak_gap", 9), "average_gap": F.round("average_gap", 9)})


@query(f"""WITH g AS ({BASE['gain_table']}) SELECT count(*) AS total_queries, {_ratio('count(*) FILTER (success_k3 > success_k1)', 'count(*)')} AS fraction_positive_gain,
  {_ratio('count(*) FILTER (gain_1_to_2 >= gain_2_to_3)', 'count(*)')} AS fraction_diminishing_returns, {_ratio('count(*) FILTER (success_k1 = success_k2 AND success_k2 = success_k3)', 'count(*)')} AS fraction_no_gain FROM g""")
def gain_summary(s, d):
    return simulated.gain_summary(queries.gain_table(s, d))


@query("""SELECT o_orderkey AS question_id, CAST(CASE WHEN o_custkey % 50 < 10 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 ELSE least(greatest(o_orderkey % 6, 1), (o_custkey % 50) // 10) END AS INT) AS samples FROM orders""")
def samples_for_budget(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    n = simulated.samples_for_budget(F.when(o % 3 == 0, "greedy").otherwise("best_of_n"), c % 50, F.lit(10), o % 6)
    return I.read(s, d, "orders").select(o.alias("question_id"), n.alias("samples"))


# ---------------------------------------------------------------- statistics and learned scores


@query()
def accuracy_interval(s, d):
    return statistics.paired_bootstrap(I.outcomes(s, d), "regime", "question_id", "rg")


@query()
def regime_comparisons(s, d):
    o = I.outcomes(s, d).withColumns({"v6": F.col("error") > 0.5, "v7": F.col("confidence") < 0.4})
    return statistics.regime_comparisons(o, "regime", "rg", "dpr", ["v6", "v7"])


@query(f"WITH {OUTCOMES} SELECT quantile_cont(tokens, 0.1) AS p10, quantile_cont(tokens, 0.5) AS p50, quantile_cont(tokens, 0.99) AS p99 FROM o")
def token_quantiles(s, d):
    q = statistics.exact_quantiles(I.outcomes(s, d), "tokens", [0.1, 0.5, 0.99])
    return s.createDataFrame([tuple(q)], "p10 double, p50 double, p99 double")


_LABEL = "CAST(rg = 0 AND dpr = 1 AS INT)"
_SPLIT = "CASE WHEN regime = '1-URGENT' THEN 'test' WHEN CAST(CAST('0x' || substr(md5('42|' || question_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 < 0.2 THEN 'validation' ELSE 'train' END"


@query(f"WITH {OUTCOMES} SELECT question_id, {_SPLIT} AS split FROM o")
def holdout_split(s, d):
    return learned.holdout(I.outcomes(s, d), "question_id", "1-URGENT").select("question_id", "split")


@query(f"""WITH {OUTCOMES}, x AS (SELECT question_id, {_LABEL} AS label, {_SPLIT} AS split FROM o), m AS (SELECT label, count(*) AS n FROM x WHERE split = 'train' GROUP BY label)
  SELECT question_id, (SELECT avg(label) FROM x WHERE split = 'train') AS probability, (SELECT arg_min(label, (-n, label)) FROM m) AS majority FROM x WHERE split = 'test'""")
def constant_scores(s, d):
    o = learned.holdout(I.outcomes(s, d), "question_id", "1-URGENT").withColumn("label", ((F.col("rg") == 0) & (F.col("dpr") == 1)).cast("int"))
    return learned.constant_score(o.where("split = 'train'"), o.where("split = 'test'").select("question_id"), "label")


@query(f"""WITH {OUTCOMES}, t AS (SELECT round(i * 0.05::DOUBLE, 2) AS threshold FROM range(1, 20) r(i)), x AS (SELECT threshold, {_LABEL} AS y, confidence >= threshold AS p FROM o, t),
  k AS (SELECT threshold, count(*) AS n, count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp, count(*) FILTER (NOT p AND y = 1) AS fn FROM x GROUP BY threshold)
  SELECT threshold, n, {_ratio('n - fp - fn', 'n')} AS accuracy, {_ratio('tp', 'tp + 0.5 * (fp + fn)')} AS f1, {_ratio('tp + fp', 'n')} AS revise_rate, 1 + {_ratio('tp + fp', 'n')} AS avg_cost FROM k""")
def threshold_scores(s, d):
    o = I.outcomes(s, d).withColumn("label", ((F.col("rg") == 0) & (F.col("dpr") == 1)).cast("int"))
    return learned.threshold_scores(o, "confidence", "label")


@query()
def calibrated_scores(s, d):
    o = I.outcomes(s, d).select("question_id", "confidence", (F.col("dpr") > F.col("rg")).cast("int").alias("label"))
    for method in ("sigmoid", "isotonic"):
        o = learned.Calibrator(method).fit(o, "confidence", "label").transform(o, "confidence", method)
    return o.select("question_id", "sigmoid", "isotonic")


@query(f"""WITH {OUTCOMES}, m AS (SELECT avg(tokens) AS mean, stddev_pop(tokens) AS sd FROM o) SELECT question_id, CAST(tokens AS DOUBLE) AS raw, CAST(tokens AS DOUBLE) / greatest(instance % 9, 1) AS ratio, round((tokens - mean) / sd, 6) AS z_score FROM o, m""")
def token_series(s, d):
    o = I.outcomes(s, d).withColumn("question_tokens", F.col("instance") % 9)
    z = statistics.z_blend(o, ["tokens"], [1.0])
    return z.select("question_id", F.col("tokens").cast("double").alias("raw"), (F.col("tokens") / F.greatest("question_tokens", F.lit(1))).alias("ratio"), F.round("z_score", 6).alias("z_score"))


# ---------------------------------------------------------------- SQL of queries defined elsewhere

_TAKE = lambda want, left: f"CASE WHEN {want} <= {left} THEN {want} ELSE 0 END"
ORACLE_SQL["budgeted_escalation"] = f"""WITH RECURSIVE {OUTCOMES}, r AS (SELECT instance, question_id, CAST(tokens % 3 + 1 AS INT) AS want, row_number() OVER (PARTITION BY instance ORDER BY tokens DESC, question_id) AS k, 25 - count(*) OVER (PARTITION BY instance) AS spare FROM o),
  s AS (SELECT instance, question_id, k, {_TAKE('want', 'spare')} AS take, spare - ({_TAKE('want', 'spare')}) AS rest FROM r WHERE k = 1
    UNION ALL SELECT r.instance, r.question_id, r.k, {_TAKE('r.want', 's.rest')}, s.rest - ({_TAKE('r.want', 's.rest')}) FROM r JOIN s ON r.instance = s.instance AND r.k = s.k + 1)
  SELECT instance, question_id, CAST(1 + take AS INT) AS samples FROM s"""


def _search_sql(rounds: int = 24, top: float = 50.0) -> str:
    """A common table expression for each halving of the price."""
    spent = "(SELECT sum(cost) FROM (SELECT arg_max(action_cost, ROW(final_utility - p.mid * action_cost, -action_cost, action_name)) AS cost FROM c, p GROUP BY prompt_id))"
    out = [CANDIDATES, "b AS (SELECT 12.0 * count(DISTINCT prompt_id) AS budget FROM c)", f"r0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS lo, {top}::DOUBLE AS hi)"]
    for i in range(1, rounds + 1):
        step = spent.replace("p.mid", f"m{i}.mid").replace("FROM c, p ", f"FROM c, m{i} ")
        out += [f"m{i} AS MATERIALIZED (SELECT (lo + hi) / 2 AS mid FROM r{i - 1})", f"f{i} AS MATERIALIZED (SELECT {step} <= (SELECT budget FROM b) AS ok)",
                f"r{i} AS MATERIALIZED (SELECT CASE WHEN ok THEN lo ELSE mid END AS lo, CASE WHEN ok THEN mid ELSE hi END AS hi FROM r{i - 1}, m{i}, f{i})"]
    pick = lambda v: f"arg_max({v}, ROW(final_utility - hi * action_cost, -action_cost, action_name)) AS {v}"
    return f"WITH {', '.join(out)} SELECT prompt_id, {pick('action_name')}, {pick('action_cost')}, {pick('final_utility')} FROM c, r{rounds} GROUP BY prompt_id"


ORACLE_SQL["lambda_search"] = _search_sql()


# ---------------------------------------------------------------- many actions, boosting by histograms, neural router

_CLASSES = f"""t AS (SELECT prompt_id, arg_min(action, struct_pack(r := CASE WHEN correct = 1 THEN 0 ELSE 1 END, c := cost, a := action)) AS truth, arg_max(action, struct_pack(u := final_utility, c := -cost, a := action)) AS predicted FROM c GROUP BY prompt_id)"""


def _choices(s, d):
    """The cheapest right action of each prompt (the cheapest of all without one) and the one of greatest utility."""
    c = I.candidates(s, d)
    truth = F.min_by("action", F.struct(F.when(F.col("correct") == 1, 0).otherwise(1), "cost", "action"))
    return c.groupBy("prompt_id").agg(truth.alias("truth"), F.max_by("action", F.struct("final_utility", -F.col("cost"), "action")).alias("predicted"))


@query(f"""WITH {CANDIDATES}, {_CLASSES}, l AS (SELECT truth AS label FROM t UNION SELECT predicted FROM t),
  g AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (predicted = label) AS said, count(*) FILTER (truth = label AND predicted = label) AS hit FROM l, t GROUP BY label),
  m AS (SELECT label, 'class' AS kind, {_ratio('hit', 'said')} AS precision, {_ratio('hit', 'support')} AS recall, {_ratio('2 * hit', '(said + support)')} AS f1, support, hit FROM g),
  u AS (SELECT label, kind, precision, recall, f1, support FROM m UNION ALL SELECT NULL, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM m
    UNION ALL SELECT NULL, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m
    UNION ALL SELECT NULL, 'accuracy', NULL, sum(hit) / sum(support), NULL, sum(support) FROM m UNION ALL SELECT NULL, 'balanced', NULL, avg(recall) FILTER (support > 0), NULL, sum(support) FROM m)
  SELECT label, kind, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def class_report(s, d):
    r = multiclass.class_report(_choices(s, d), "truth", "predicted")
    return r.select("label", "kind", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_BEST_U = "max(CAST(correct AS DOUBLE) - CAST(0.01 AS DOUBLE) * cost)"


@query(f"""WITH {CANDIDATES}, {_CLASSES}, b AS (SELECT prompt_id, max(correct) AS r, {_BEST_U} AS u FROM c GROUP BY prompt_id),
  p AS (SELECT prompt_id, 'oracle' AS policy, truth AS action FROM t UNION ALL SELECT prompt_id, 'utility', predicted FROM t UNION ALL SELECT prompt_id, 'always_a1', 'a1' FROM t)
  SELECT policy, count(*) AS n, round(avg(correct), 9) AS mean_accuracy, round(avg(cost), 9) AS mean_cost, round(avg(r - correct), 9) AS mean_regret_accuracy,
    round(avg(correct - CAST(0.01 AS DOUBLE) * cost), 9) AS mean_utility_0, round(avg(u - (correct - CAST(0.01 AS DOUBLE) * cost)), 9) AS mean_regret_utility_0
  FROM p JOIN c USING (prompt_id, action) JOIN b USING (prompt_id) GROUP BY policy""")
def policy_regret(s, d):
    wide = queries.pivot_outcomes(s, d).join(_choices(s, d), "prompt_id")
    r = multiclass.policy_regret(wide, {"oracle": F.col("truth"), "utility": F.col("predicted"), "always_a1": F.lit("a1")}, queries.ACTIONS, [0.01])
    return r.select("policy", "n", *[F.round(c, 9).alias(c) for c in r.columns[2:]])


def _prompt_features(s, d):
    """Costs and utilities of each prompt's actions, as features of the action that is its cheapest right one."""
    g = I.candidates(s, d).groupBy("prompt_id").agg(F.min("cost").alias("least_cost"), F.max("cost").alias("most_cost"), F.avg("final_utility").alias("mean_utility"), F.count(F.lit(1)).alias("n_actions"), F.min_by("action", "cost").alias("first"))
    return g.join(_choices(s, d).select("prompt_id", "truth"), "prompt_id").withColumn("first", F.substring("first", 2, 9).cast("double"))


@query()
def multiclass_predictions(s, d):
    """Actions predicted out of fold by two of the five models."""
    x, features = _prompt_features(s, d), ["least_cost", "most_cost", "mean_utility", "n_actions", "first"]
    return multiclass.out_of_fold(x, "tree", "prompt_id", features, "truth").withColumn("model", F.lit("tree")).union(
        multiclass.out_of_fold(x, "logistic", "prompt_id", features, "truth").withColumn("model", F.lit("logistic")))


_STUMP_CUTS = {"confidence": [0.25, 0.5, 0.75], "tokens": [50.0, 100.0, 200.0]}
_HELPED = "CAST(rg = 0 AND dpr = 1 AS INT)"


@query(f"""WITH {OUTCOMES}, x AS (SELECT {_HELPED} AS y, 1.0 + error AS w, confidence, tokens FROM o), t AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST({c} AS DOUBLE) AS threshold, y, w, {f} <= {c} AS low FROM x" for f, cuts in _STUMP_CUTS.items() for c in cuts)})
  SELECT feature, threshold, {', '.join(f"round(coalesce(sum(w) FILTER ({'' if n == 'low' else 'NOT '}low AND y = {y}), 0), 6) AS {n}_{y}" for n in ('low', 'high') for y in (0, 1))} FROM t GROUP BY ALL""")
def stump_sums(s, d):
    """What a round of boosting chooses its stump from."""
    o = I.outcomes(s, d).withColumn("y", ((F.col("rg") == 0) & (F.col("dpr") == 1)).cast("int")).withColumn("w", 1.0 + F.col("error"))
    r = boosting.stump_sums(o, list(_STUMP_CUTS), list(_STUMP_CUTS.values()), "y", "w")
    return r.select("feature", "threshold", *[F.round(c, 6).alias(c) for c in ("low_0", "low_1", "high_0", "high_1")])


def _helped(s, d):
    return I.outcomes(s, d).withColumn("label", ((F.col("rg") == 0) & (F.col("dpr") == 1)).cast("int"))


@query()
def adaboost_scores(s, d):
    """200 rounds fitted to two thirds of the questions; probabilities of all."""
    x = _helped(s, d).withColumn("held_out", F.pmod(F.xxhash64("question_id"), F.lit(3)) == 0)
    model = boosting.HistogramBoost(["confidence", "error", "tokens"]).fit(x.where("not held_out"))
    return model.transform(x).select("question_id", "held_out", F.round("probability", 9).alias("probability"))


@query()
def neural_router(s, d):
    """Probabilities of held-out questions; a needless revision costs half, and long questions count more."""
    x = _helped(s, d).withColumn("held_out", F.pmod(F.xxhash64("question_id"), F.lit(3)) == 0).withColumn("w", 1.0 + F.col("tokens") / 100)
    model = neural.NeuralRouter(["confidence", "error", "tokens"], hidden=(16, 8), cost=0.5).fit(x.where("not held_out"), weight="w")
    scored = model.transform(x.where("held_out"))
    return neural.decide(scored, 0.5, "reasoning_greedy", "direct_plus_revise").select("question_id", F.round("probability", 6).alias("probability"), "action")


# ---------------------------------------------------------------- settings of weighted policies

_SETTINGS = [
    {"setting": "default", "threshold": policies.VIOLATION_THRESHOLD, **policies.VIOLATION_WEIGHTS}, {"setting": "strict", "threshold": 1, **policies.VIOLATION_WEIGHTS}, {"setting": "loose", "threshold": 5, **policies.VIOLATION_WEIGHTS},
    {"setting": "answers_only", "threshold": 2, "final_answer_missing_or_unclear": 2, "parse_failure": 2, "malformed_output": 2}, {"setting": "always", "threshold": 0}, {"setting": "never", "threshold": 99, **policies.VIOLATION_WEIGHTS},
]
_SWEEP = f"""SELECT setting, count(*) AS n, avg(CASE WHEN revise THEN dpr ELSE rg END) AS accuracy, 1 + avg(CAST(revise AS DOUBLE)) AS avg_cost, count(*) FILTER (revise) AS revise_trigger_count, avg(CAST(revise AS DOUBLE)) AS revise_trigger_fraction,
    avg(CASE WHEN revise THEN dpr ELSE rg END) - avg(greatest(rg, dpr)) AS distance_to_oracle, sum(CASE WHEN revise THEN dpr ELSE rg END) >= sum(rg) AS matches_or_beats_reasoning_greedy, count(*) FILTER (revise) < count(*) AS uses_less_cost_than_always_revise,
    count(*) FILTER (revise) > 0 AND count(*) FILTER (revise) < count(*) AS nontrivial_selectivity FROM (
    {' UNION ALL '.join(f"SELECT '{x['setting']}' AS setting, rg, dpr, {' + '.join(f'{int(x.get(k, 0))} * CAST({k} AS INT)' for k in policies.VIOLATION_WEIGHTS)} >= {x['threshold']} AS revise FROM s" for x in _SETTINGS)}) GROUP BY setting"""
_SWEPT = f"WITH {OUTCOMES}, v AS ({policy_sql.ORACLE_SQL['violation_signals']}), s AS (SELECT v.*, rg, dpr FROM v JOIN o USING (question_id)), p AS ({_SWEEP})"
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" if c in ("accuracy", "avg_cost", "revise_trigger_fraction", "distance_to_oracle") else c for c in (
    "setting", "n", "accuracy", "avg_cost", "revise_trigger_count", "revise_trigger_fraction", "distance_to_oracle", "matches_or_beats_reasoning_greedy", "uses_less_cost_than_always_revise", "nontrivial_selectivity"))


@query(f"{_SWEPT} SELECT {_ROUNDED} FROM p")
def setting_sweep(s, d):
    w = policies.with_violations(I.word_problems(s, d), "q", "t").select("question_id", "violation").join(I.outcomes(s, d).select("question_id", "rg", "dpr"), "question_id")
    return policies.setting_sweep(w, "violation", F.col("rg"), F.col("dpr"), _SETTINGS).withColumns({c: F.round(c, 9) for c in ("accuracy", "avg_cost", "revise_trigger_fraction", "distance_to_oracle")})


@query(f"""{_SWEPT} SELECT {_ROUNDED} FROM p ORDER BY CAST(matches_or_beats_reasoning_greedy AS INT) DESC, CAST(uses_less_cost_than_always_revise AS INT) DESC, CAST(nontrivial_selectivity AS INT) DESC,
  round(distance_to_oracle, 9), round(avg_cost, 9), round(accuracy, 9) DESC LIMIT 1""")
def best_policy_setting(s, d):
    return candidates.best_setting(setting_sweep(s, d))


# ---------------------------------------------------------------- checkers of candidate answers


def _checked(s, d):
    return queries._of_problems(s, d, lambda x: policies.with_checkers(x, "q", "answer").select("q", "t", "checkers"))


@query()
def consistency_variants(s, d):
    """What four checkers say of each problem's answer."""
    return _checked(s, d).select("question_id", *[F.col(f"checkers.{k}.flagged").alias(k) for k in ("plain", "role", "calibrated", "unified")], F.array_join("checkers.role.signals", "|").alias("role_signals"))


_PLAIN = f"WITH k AS ({policy_sql.ORACLE_SQL['candidate_consistency']}), f AS ({policy_sql.ORACLE_SQL['constraint_flags']}), x AS (SELECT question_id % 3 = 0 AS correct, {' OR '.join(f'k.{c}' for c in policy_sql._CHECKS)} AS plain, n_signals > 0 AS constrained FROM k JOIN f USING (question_id)), u AS (SELECT 'plain' AS variant, plain AS flagged, correct FROM x UNION ALL SELECT 'constrained', constrained, correct FROM x), g AS (SELECT variant, count(*) FILTER (flagged AND NOT correct) AS hit, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (flagged AND correct) AS no, count(*) FILTER (correct) AS yes FROM u GROUP BY variant)"


@query(f"""{_PLAIN}, r AS (SELECT variant, {_ratio('hit', 'wrong')} AS recall, {_ratio('no', 'yes')} AS fpr, hit + no AS num_flagged FROM g)
  SELECT variant, round(recall, 9) AS wrong_recall, round(fpr, 9) AS false_positive_rate_on_correct, round(recall - fpr, 9) AS recall_minus_fpr, round((recall + 1 - fpr) / 2, 9) AS balanced_utility, num_flagged FROM r""")
def signal_tradeoff(s, d):
    w = I.word_problems(s, d).withColumn("answer", A.numeric_answer(F.col("t")))
    plain = F.lit(False)
    for c in policies.candidate_consistency(F.col("q"), F.col("answer")).values():
        plain = plain | c
    flags = queries.constraint_flags(s, d).select("question_id", (F.col("n_signals") > 0).alias("constrained"))
    x = w.select("question_id", plain.alias("plain")).join(flags, "question_id")
    r = policies.signal_tradeoff(x, {"plain": F.col("plain"), "constrained": F.col("constrained")}, F.col("question_id") % 3 == 0)
    return r.select("variant", *[F.round(c, 9).alias(c) for c in ("wrong_recall", "false_positive_rate_on_correct", "recall_minus_fpr", "balanced_utility")], "num_flagged")


# ---------------------------------------------------------------- fitted feature matrix

_REGIMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_MATRIX = "SELECT c.prompt_id, c.action_name, regime, CAST(cost AS DOUBLE) AS feat_cost, CASE WHEN c.prompt_id % 11 = 0 THEN 'nan' WHEN c.prompt_id % 13 = 0 THEN 'none' ELSE CAST(final_utility AS VARCHAR) END AS hfeat_utility FROM c JOIN o ON o.question_id = c.prompt_id"


@query(f"""WITH {CANDIDATES}, {OUTCOMES}, r AS ({_MATRIX}), x AS (SELECT *, CASE WHEN hfeat_utility = 'none' THEN 0.0 WHEN hfeat_utility = 'nan' THEN NULL ELSE CAST(hfeat_utility AS DOUBLE) END AS u FROM r)
  SELECT prompt_id, action_name, feat_cost, round(coalesce(u, (SELECT median(u) FROM x)), 9) AS hfeat_utility, {', '.join(f"CAST(action_name = 'a{i}' AS DOUBLE) AS cat_action__a{i}" for i in range(1, 8))},
    {', '.join(f"CAST(regime = '{x}' AS DOUBLE) AS r{i}" for i, x in enumerate(_REGIMES))} FROM x""")
def feature_matrix(s, d):
    """Candidate rows as a matrix of numbers and categories, fitted and applied."""
    c, o = I.candidates(s, d), I.outcomes(s, d).select(F.col("question_id").alias("prompt_id"), "regime")
    u, k = F.col("final_utility").cast("string"), F.col("prompt_id")
    rows = c.join(o, "prompt_id").select("prompt_id", "action_name", "regime", F.col("cost").cast("double").alias("feat_cost"), F.when(k % 11 == 0, "nan").when(k % 13 == 0, "none").otherwise(u).alias("hfeat_utility"))
    model = matrix.FeatureMatrix().fit(rows)
    x = rows.select("prompt_id", F.col("action_name").alias("of"), *model.columns(rows)).withColumnRenamed("of", "action_name")
    return x.select("prompt_id", "action_name", "feat_cost", F.round("hfeat_utility", 9).alias("hfeat_utility"), *[f"cat_action__a{i}" for i in range(1, 8)], *[F.col(f"`cat_regime__{r}`").alias(f"r{i}") for i, r in enumerate(_REGIMES)])


@query()
def numeric_features(s, d):
    """The flat feature row of every word problem."""
    w = I.word_problems(s, d).withColumn("answer", A.numeric_answer(F.col("t")))
    return features.numeric_features(w, "question_id", "q", "t", "answer")


# ---------------------------------------------------------------- SQL of greedy upgrades: a step of the recursion is an upgrade

_TAKEN = "r.total + s.extra <= 150 AND s.u > coalesce(list_filter(r.now, lambda x: x.p = s.prompt_id)[1].u, s.base_u)"
ORACLE_SQL["greedy_upgrade"] = f"""WITH RECURSIVE {CANDIDATES}, i AS (SELECT o_custkey AS instance, prompt_id, action_name, action_cost AS cost, final_utility AS u FROM c JOIN orders ON o_orderkey = prompt_id),
  b AS (SELECT instance, prompt_id, arg_min(struct_pack(n := action_name, c := cost, u := u), struct_pack(c := cost, n := action_name)) AS m FROM i GROUP BY ALL),
  s AS (SELECT i.instance, i.prompt_id, i.action_name, i.cost, i.u, m.u AS base_u, i.cost - m.c AS extra, row_number() OVER (PARTITION BY i.instance ORDER BY -((i.u - m.u) / (i.cost - m.c)), i.cost - m.c, CAST(i.prompt_id AS VARCHAR), i.action_name) AS k
    FROM i JOIN b ON i.instance = b.instance AND i.prompt_id = b.prompt_id WHERE i.cost > m.c AND i.u > m.u),
  r AS (SELECT instance, CAST(0 AS BIGINT) AS k, sum(m.c) AS total, CAST([] AS STRUCT(p BIGINT, u DOUBLE, n VARCHAR, c DOUBLE)[]) AS now FROM b GROUP BY instance
    UNION ALL SELECT r.instance, s.k, CASE WHEN {_TAKEN} THEN r.total + s.extra ELSE r.total END,
      CASE WHEN {_TAKEN} THEN list_append(list_filter(r.now, lambda x: x.p <> s.prompt_id), struct_pack(p := s.prompt_id, u := s.u, n := s.action_name, c := s.cost)) ELSE r.now END FROM r JOIN s ON s.instance = r.instance AND s.k = r.k + 1),
  e AS (SELECT instance, arg_max(total, k) AS total, arg_max(now, k) AS now FROM r GROUP BY instance), p AS (SELECT instance, unnest(now) AS x FROM e)
  SELECT b.instance, b.prompt_id, coalesce(x.n, m.n) AS action_name, coalesce(x.c, m.c) AS action_cost, coalesce(x.u, m.u) AS final_utility, e.total AS total_cost, e.total <= 150 AS feasible
  FROM b JOIN e ON e.instance = b.instance LEFT JOIN p ON p.instance = b.instance AND p.x.p = b.prompt_id"""
