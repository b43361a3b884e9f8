"""Consistency of a reasoned answer with its question: constraint flags, number roles and their coverage,
verification features, and the unified error and confidence. All are Columns; null texts count as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.answers import calibration, normalized_number, numeric_answer
from routeloom.functions.text import target_features, text_parts

# Patterns and cue words that define the signals.
PLAIN_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
LOOSE_NUMBER = r"-?[0-9,]+(?:\.[0-9]+)?"
COUNT_UNITS = "apples?|clips?|plants?|trees?|pages?|pieces?|items?|cookies?|figures?|books?|people|friends?|sales?|holes?|cars?|headlights?|horses?|trips?|boxes?|bags?|bales?|sacks?|paperclips?"
MONEY_UNITS = "dollars?|cents?|commission|budget|cost|pay|earned"
TIME_UNITS = "minutes?|hours?|days?|weeks?|months?|years?"
PERCENT_OR_RATIO = "percent|percentage|ratio|fraction|half|double|twice"
LEFT = "left|remain|remaining|at the end"
TOTAL = "total|altogether|in all|sum"
ACTION = "sold|read|wrote|removed|added|spent|earned|made"
ASKS_WHEN = r"\bon what day|what day|which day|when\b"
HALVING = r"\bhalf|/ ?2|divide|divided by 2\b"
FINAL_STATEMENT = r"(?isU)(?:final answer|answer\s*:|therefore|thus|hence|so)\s*(.*)"
UNIT_HINTS = "dollars?|cents?|hours?|minutes?|days?|weeks?|months?|years?|students?|people|friends?|apples?|books?|boxes?|trips?|buses?|tickets?|pages?|liters?|kg|miles?|km|items?|seats?|cookies?|candies?|cars?|balls?"
NEARBY_VERBS = "add|added|gain|gained|receive|received|buy|bought|earn|earned|spend|spent|lose|lost|gave|give|sold|sell|used|use|ate|consume|divide|divided|multiply|multiplied|split|share|left|remaining|remain|need|needed|required|minimum|maximum|compare|difference|more|less"
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
MULTIPLE_WORDS = {"half": 0.5, "double": 2, "twice": 2, "triple": 3, "thrice": 3, "dozen": 12}
#: role, its cues anywhere in the context, confidence; the first that fits counts.
ROLE_CUES = [
    ("capacity_ceiling", "at most|minimum number|capacity|holds|fit|required", "high"),
    ("subtract", "spent|lost|gave|sold|used|ate|removed|away", "high"),
    ("add", "add|added|gain|gained|receive|received|buy|bought|more", "medium"),
    ("ratio", "ratio|half|twice|double|triple", "medium"),
    ("multiply", "each|per|every|times|double|twice|triple", "medium"),
    ("divide", "average|split|share|divided|per", "low"),
    ("compare_difference", "difference|more than|less than|fewer than", "medium"),
]
CONTEXT = 28
#: relation asked for, its cues; the first that fits counts.
RELATIONS = [
    ("contributes_to_remaining", "left|remaining|remain"),
    ("contributes_to_total", "total|altogether|in all"),
    ("contributes_to_rate", "per|each|every|hour|minute"),
    ("contributes_to_capacity", "minimum number|at most|required|capacity|holds"),
]
#: Cues of a role in a short window, and the order that breaks ties.
WINDOW_CUES = {
    "subtract": r"spent|spend|spends|lost|lose|loses|gave\s+away|sold|sell|sells|used|uses|use\s+up|used\s+up|ate|eat|eats|eaten|removed|remove|removes|donated|donate|donates|consumed|consume|consumes|gave|give|gives",
    "add": r"received|receive|receives|gained|gain|gains|bought|buy|buys|added|add|adds|found|find|finds|got\s+more|collected|collect|collects|earned|earn|earns|picked\s+up|picks\s+up",
    "ratio": "half|double|twice|triple",
    "multiply_rate": r"each|every|per|apiece|a\s+piece",
    "capacity": r"minimum\s+(?:number\s+of|of)|at\s+least|enough|trips?|boxes?|buses?|busses?|containers?",
}
VERIFY_HEDGES = "i think|maybe|perhaps|approximately|around|roughly|probably|likely"
CONFLICTS = "however|but|on the other hand|wait|actually|contradict|instead"
SELECTIVE_HEDGES = "i think|maybe|perhaps|approximately|around|roughly|probably|might|uncertain|not sure"
STEP_ENDS = r"(?iU)(?:\n+|\bthen\b|\bnext\b|\btherefore\b|\bso\b)"
ANY_OPERATOR = r"=|\+|-|\*|/|×|÷"
LONG_TOKENS = 220
# Parts of the unified error and confidence.
ERROR_WEIGHTS = {"role": 0.24, "constraint": 0.19, "target": 0.08, "self": 0.14, "selective": 0.12, "calibration": 0.11, "step": 0.12}
CONFIDENCE_WEIGHTS = {"selective": 0.3, "calibration": 0.25, "self": 0.25, "step": 0.2}


def full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(full(text), r"(?U)^\s+|\s+$", "")


def word(text: Column, words: str) -> Column:
    return text.rlike(rf"(?iU)\b(?:{words})\b")


def mentions(text: Column, parts: str) -> Column:
    """Whether one of the parts stands anywhere, inside longer words too."""
    return text.rlike(rf"(?iU)(?:{parts})")


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without the empty one after a last line end."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|\r|\n)$", ""), r"\r\n|\r|\n")


def unit(hundredths: Column) -> Column:
    """Hundredths as a number from 0 to 1."""
    return F.greatest(F.least(hundredths, F.lit(100)), F.lit(0)) / 100


def flags(signals: dict[str, Column]) -> Column:
    """Names of the signals that are on."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in signals.items()]))


def staged(df: DataFrame, stage: str, values: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """df with each value as a column of its own, and references to them: what is used often is then computed once a row."""
    names = {k: f"__{stage}_{k}" for k in values}
    return df.withColumns({names[k]: v for k, v in values.items()}), {k: F.col(v) for k, v in names.items()}


def unstaged(df: DataFrame, *stages: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(f"__{s}_" for s in stages))])


def question_profile(question: Column) -> dict[str, Column]:
    """What a question asks for, by its words, units and numbers; `obvious_total` is its greatest number or null."""
    q = full(question)
    values = F.transform(all_of(q, r"(?<![A-Za-z])" + LOOSE_NUMBER), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    counts = F.transform(all_of(q, rf"(?iU)\b(?:{COUNT_UNITS})\b"), F.lower)
    many, much, money, time = word(q, "how many"), word(q, "how much"), word(q, MONEY_UNITS), word(q, TIME_UNITS)
    return {
        "count_units": counts, "has_money_unit": money, "has_time_unit": time, "asks_how_many": many, "asks_how_much": much,
        "asks_when": q.rlike(rf"(?iU)(?:{ASKS_WHEN})"), "asks_left": word(q, LEFT), "asks_total": word(q, TOTAL), "asks_action_quantity": word(q, ACTION),
        "has_percent_or_ratio": word(q, PERCENT_OR_RATIO), "obvious_total": F.array_max(values), "integer_expected": many & (F.size(counts) > 0),
        "numeric_target_expected": many | much | time | money, "half_of_remaining": word(q, "half of the remaining"), "n_numbers": F.size(all_of(q, LOOSE_NUMBER)),
    }


def final_statement(reasoning: Column) -> Column:
    """What follows the first final cue, else the last line that isn't blank."""
    t = full(reasoning)
    last = F.try_element_at(F.filter(F.transform(lines(t), stripped), lambda x: x != ""), F.lit(-1))
    return F.when(t.rlike(FINAL_STATEMENT), stripped(F.regexp_extract(t, FINAL_STATEMENT, 1))).otherwise(full(last))


def with_constraints(df: DataFrame, question: str, reasoning: str, answer: str, name: str = "constraint") -> DataFrame:
    """df with a struct of the question's profile, the final statement, 11 flags, the signals on and their count. A
    null answer is read from the reasoning; an empty one is a failed parse."""
    parsed = normalized_number(F.coalesce(F.col(answer), numeric_answer(F.col(reasoning))))
    x, p = staged(df, "profile", question_profile(F.col(question)))
    x, o = staged(x, "output", {"final": final_statement(F.col(reasoning)), "answer": parsed})
    f, a, value = o["final"], o["answer"], o["answer"].try_cast("double")
    has, negative = a != "", F.coalesce(value < 0, F.lit(False))
    left, total, halved, counted = word(f, LEFT), word(f, TOTAL), f.rlike(rf"(?iU)(?:{HALVING})"), F.size(p["count_units"]) > 0
    bounded = value.isNotNull() & p["obvious_total"].isNotNull() & (p["n_numbers"] <= 3)
    upper = F.coalesce(bounded & p["asks_left"] & (value > p["obvious_total"]), F.lit(False))
    lower = bounded & negative
    target = (p["asks_left"] & ~left & total) | (p["half_of_remaining"] & ~halved & (left | has)) | (p["asks_action_quantity"] & total & ~p["asks_total"])
    units = ~has & ((p["has_money_unit"] & ~word(f, MONEY_UNITS)) | (p["has_time_unit"] & ~word(f, TIME_UNITS)) | (counted & ~F.coalesce(F.contains(F.lower(f), F.try_element_at(p["count_units"], F.lit(1))), F.lit(False))))
    echo = F.coalesce(p["half_of_remaining"] & left & (value == p["obvious_total"]), F.lit(False))
    signals = {
        "answer_type_mismatch_suspected": (p["numeric_target_expected"] & ~has) | (p["asks_when"] & has),
        "target_quantity_mismatch_suspected": target,
        "unit_mismatch_suspected": units,
        "impossible_sign_suspected": negative & (p["asks_how_many"] | p["asks_how_much"] | counted | p["has_money_unit"]),
        "integer_expected_but_noninteger_suspected": p["integer_expected"] & F.coalesce(value != F.floor(value), F.lit(False)),
        "percent_or_ratio_mismatch_suspected": p["has_percent_or_ratio"] & negative,
        "answer_not_mentioned_in_final_statement_suspected": has & (f != "") & ~F.contains(F.regexp_replace(f, ",", ""), a),
        "constraint_word_conflict_suspected": (p["asks_left"] & total) | (p["asks_total"] & left) | echo,
        "bound_violation_suspected": upper | lower,
    }
    bounds = {"obvious_upper_bound_exceeded_suspected": upper, "obvious_lower_bound_violated_suspected": lower}
    x, v = staged(x, "signal", signals | bounds)
    on = flags({k: v[k] for k in signals})
    out = [c.alias(k) for k, c in v.items()]
    profile = F.struct(*[c.alias(k) for k, c in p.items()])
    x = x.withColumn(name, F.struct(a.alias("parsed_answer"), f.alias("final_statement"), *out, on.alias("signals"), F.size(on).alias("n_signals"), profile.alias("profile")))
    return unstaged(x, "profile", "output", "signal")


def number_records(question: Column) -> Column:
    """Every number and number word of a text: surface, value, the form to look for in a reasoning, source, sentence,
    context of 28 characters on each side within the sentence, unit and verbs near it. Characters outside the basic
    plane count as one and stand as U+FFFD in contexts."""
    t = F.regexp_replace(stripped(question), r"[\x{10000}-\x{10FFFF}]", "�")
    sentences = F.filter(F.split(t, r"(?U)(?<=[.!?])\s+"), lambda s: s.rlike(r"(?U)\S"))
    values = F.create_map(*[F.lit(x) for k, v in (NUMBER_WORDS | MULTIPLE_WORDS).items() for x in (k, float(v))])

    def found(sentence: Column, i: Column, pattern: str) -> Column:
        p = rf"(?isU)(?={pattern})(?<=(^.{{0,{CONTEXT - 1}}}|.{{{CONTEXT}}}))({pattern})(?=(.{{0,{CONTEXT}}}))"
        left, middle, right = (F.regexp_extract_all(sentence, F.lit(p), F.lit(g)) for g in (1, 2, 3))
        near = F.zip_with(F.zip_with(left, middle, lambda a, b: F.struct(a.alias("a"), F.lower(b).alias("b"), F.concat(a, b).alias("c"))), right, lambda x, r: F.struct(x["b"].alias("surface"), F.concat(x["c"], r).alias("context")))
        return F.transform(near, lambda x: F.struct(x["surface"].alias("surface"), x["context"].alias("context"), i.alias("sentence_index")))

    words = "|".join(NUMBER_WORDS | MULTIPLE_WORDS)
    raw = F.flatten(F.transform(sentences, lambda s, i: F.concat(found(s, i, PLAIN_NUMBER), found(s, i, rf"\b(?:{words})\b"))))

    def record(x: Column) -> Column:
        s = x["surface"]
        value = F.coalesce(F.try_element_at(values, s), s.try_cast("double"))
        source = F.when(s == "half", "fraction_word").when(s.isin(*MULTIPLE_WORDS), "multiplicative_word").when(s.isin(*NUMBER_WORDS), "number_word").otherwise("numeric_literal")
        form = F.when(source == "numeric_literal", normalized_number(s)).otherwise(normalized_number(F.try_element_at(values, s).cast("string")))
        hint = F.try_element_at(all_of(x["context"], rf"(?iU)\b(?:{UNIT_HINTS})\b"), F.lit(1))
        verbs = F.transform(all_of(x["context"], rf"(?iU)\b(?:{NEARBY_VERBS})\b"), F.lower)
        return F.struct(s.alias("surface"), value.alias("value"), form.alias("form"), source.alias("source"), x["sentence_index"].alias("sentence_index"), x["context"].alias("context"), F.lower(hint).alias("unit"), verbs.alias("verbs"))

    return F.transform(raw, record)


def target_relation(question: Column) -> Column:
    q = full(question)
    return reduce(lambda w, r: w.when(mentions(q, r[1]), r[0]), RELATIONS[1:], F.when(mentions(q, RELATIONS[0][1]), RELATIONS[0][0])).otherwise("unknown")


def with_roles(df: DataFrame, question: str, name: str = "roles") -> DataFrame:
    """df with the question's number records and, for each, its role, the confidence in it, whether the answer needs
    it, strongly or at all, and the relation it adds to."""
    x = df.withColumn("__r", number_records(F.col(question))).withColumn("__g", target_relation(F.col(question)))

    def by_cue(c: Column, index: int, other: str) -> Column:
        first, *rest = ROLE_CUES
        return reduce(lambda w, r: w.when(mentions(c, r[1]), r[0] if index == 0 else r[2]), rest, F.when(mentions(c, first[1]), first[0] if index == 0 else first[2])).otherwise(other)

    fields = ["surface", "value", "form", "source", "sentence_index", "context", "unit", "verbs"]
    cued = F.transform("__r", lambda r: F.struct(*[r[k].alias(k) for k in fields], by_cue(r["context"], 0, "unknown").alias("cue"), by_cue(r["context"], 2, "low").alias("confidence")))

    def assigned(r: Column) -> Column:
        scaled = r["source"].isin("fraction_word", "multiplicative_word")
        spare = (F.col("__g") == "contributes_to_remaining") & (r["source"] == "numeric_literal")
        role = F.when((r["cue"] == "unknown") & spare, "subtract").otherwise(r["cue"])
        required = (r["cue"] != "unknown") | scaled | spare
        strong = r["cue"].isin("capacity_ceiling", "subtract", "ratio") | scaled
        relation = F.when(r["cue"] == "capacity_ceiling", "contributes_to_capacity").when(required, F.col("__g")).otherwise("unknown")
        return F.struct(*[r[k].alias(k) for k in fields], role.alias("role"), r["confidence"].alias("confidence"), required.alias("required"), strong.alias("strong"), relation.alias("target_relation"))

    return x.withColumn("__r", cued).withColumn(name, F.transform("__r", assigned)).drop("__r", "__g")


def with_role_coverage(df: DataFrame, question: str, reasoning: str, answer: str, name: str = "role") -> DataFrame:
    """df with a struct on how far the reasoning covers the numbers that the answer needs, and the calibrated decision."""
    t, q, a = F.lower(full(F.col(reasoning))), full(F.col(question)), stripped(F.col(answer))
    x = with_roles(df, question, "__roles").withColumn("__t", t)
    needed = F.transform(F.filter("__roles", lambda r: r["required"]), lambda r: F.struct(r["role"].alias("role"), r["strong"].alias("strong"), (F.contains(F.col("__t"), r["form"]) | F.contains(F.col("__t"), r["surface"])).alias("found")))
    x = x.withColumn("__n", needed)
    n, t = F.col("__n"), F.col("__t")
    count = lambda f: F.size(F.filter(n, f))
    missing = lambda *roles: F.exists(n, lambda r: ~r["found"] & r["role"].isin(*roles))
    finished = mentions(t, "final answer|therefore|answer:|so the answer")
    number = a.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    value = a.try_cast("double")
    coherent = F.coalesce(number & mentions(q, "how many|number of|minimum number") & (value == F.floor(value)) & (value >= 0), F.lit(False))
    x, c = staged(x, "count", {
        "n_numbers": F.size("__roles"), "n_required": F.size(n), "n_strong": count(lambda r: r["strong"]), "n_found": count(lambda r: r["found"]),
        "n_strong_missing": count(lambda r: r["strong"] & ~r["found"]), "subtract": missing("subtract"), "add": missing("add"), "rate": missing("multiply", "divide", "ratio"), "capacity": missing("capacity_ceiling"),
    })
    x, e = staged(x, "cue", {"finished": finished, "coherent": coherent})
    finished, coherent = e["finished"], e["coherent"]
    lacking = c["n_required"] - c["n_found"]
    stop = (c["n_strong_missing"] > 0) & (a != "") & (finished | t.rlike("[0-9]")) & (mentions(q, "left|remaining|remain") | c["subtract"])
    share = F.when(c["n_required"] == 0, 1.0).otherwise(c["n_found"] / c["n_required"])
    x, d = staged(x, "cover", {"lacking": lacking, "stop": stop})
    x, score = staged(x, "score", {"score": F.greatest(F.lit(0.0), share - F.when(d["stop"], 0.2).otherwise(0.0))})
    d |= score | e
    on = lambda *pairs: sum((F.when(cond, w).otherwise(0) for cond, w in pairs), F.lit(0))
    strong_missing = c["n_strong_missing"] > 0
    warning = on((strong_missing | (d["lacking"] > 0), 1), (c["subtract"], 1), (c["capacity"], 1), (c["rate"] & strong_missing, 1), (d["stop"], 1))
    warning = F.greatest(warning - F.when(d["coherent"] & d["finished"] & (d["score"] >= 0.7), 1).otherwise(0), F.lit(0))
    error = on((strong_missing, 2), (c["subtract"], 2), (c["capacity"], 2), (d["stop"], 1))
    x, w = staged(x, "sum", {"warning": warning, "error": error})
    decision = F.when(w["error"] >= 4, "strong_escalation_candidate").when((w["error"] >= 3) & (w["warning"] >= 2), "maybe_escalate").otherwise("no_escalation")
    names = {"missing_required_number": d["lacking"] > 0, "required_subtractive_number_missing": c["subtract"], "required_additive_number_missing": c["add"], "required_rate_number_missing": c["rate"], "required_capacity_number_missing": c["capacity"], "possible_intermediate_stop_suspected": d["stop"]}
    out = F.struct(
        *[c[k].alias(k) for k in ("n_numbers", "n_required", "n_strong", "n_found", "n_strong_missing")], d["lacking"].alias("n_missing"),
        F.when(c["n_required"] == 0, 0.0).otherwise(d["lacking"] / c["n_required"]).alias("missing_fraction"), *[v.alias(k) for k, v in list(names.items())[1:]], d["score"].alias("role_coverage_score"),
        flags(names).alias("signals"), d["coherent"].alias("coherent_answer_type"), d["finished"].alias("has_finalization_cue"), w["warning"].alias("role_warning_score"), w["error"].alias("role_strong_error_score"),
        decision.alias("calibrated_decision"),
    )
    return unstaged(x.withColumn(name, out), "count", "cue", "cover", "score", "sum").drop("__roles", "__t", "__n")


def role_cues(text: Column) -> dict[str, Column]:
    """Distinct cues of each role in a text, lower-cased."""
    return {k: F.array_distinct(F.transform(all_of(full(text), rf"(?iU)\b(?:{v})\b"), F.lower)) for k, v in WINDOW_CUES.items()}


def local_role(text: Column) -> Column:
    """Role with the most cues in a short window, ties to the earlier one of `WINDOW_CUES`; null without cues."""
    n = {k: F.size(v) for k, v in role_cues(text).items()}
    best = F.greatest(*n.values())
    return F.when(best > 0, F.coalesce(*[F.when(c == best, k) for k, c in n.items()]))


def number_words(text: Column) -> Column:
    """Number words from one to twelve and multiples in a text, in order, with their values."""
    values = {k: float(v) for k, v in (NUMBER_WORDS | MULTIPLE_WORDS).items() if k not in ("zero", "thrice")}
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    found = F.transform(all_of(full(text), rf"(?iU)\b(?:{'|'.join(values)})\b"), F.lower)
    return F.transform(found, lambda x: F.struct(x.alias("surface"), F.try_element_at(table, x).alias("value")))


def self_verification(reasoning: Column, answer: Column) -> dict[str, Column]:
    """Stability of the answer in its own reasoning; a null or empty answer is the last number."""
    t = full(reasoning)
    n = all_of(t, PLAIN_NUMBER)
    a = stripped(F.coalesce(F.nullif(full(answer), F.lit("")), F.try_element_at(n, F.lit(-1)), F.lit("")))
    all_lines = lines(t)
    chunk = F.lower(F.array_join(F.slice(all_lines, F.greatest(F.size(all_lines) - 1, F.lit(1)), F.lit(2)), "\n"))
    same = F.size(F.filter(n, lambda x: x == a))
    out = {
        "answer_consistency_across_rephrasing": (a != "") & F.contains(chunk, F.lower(a)),
        "answer_stability_under_small_prompt_change": (a != "") & (same >= 1) & (F.size(F.array_distinct(n)) <= 4),
        "final_answer_repeated_consistently": (a != "") & (same >= 2),
        "reasoning_contains_backtracking_or_conflict": word(t, CONFLICTS),
        "contains_hedging_language": word(t, VERIFY_HEDGES),
    }
    return out | {"self_verification_score": unit(sum((c.cast("int") * w for c, w in zip(out.values(), (35, 35, 20, -20, -10))), F.lit(0)))}


def selective_prediction(reasoning: Column, answer: Column, passes: Column | None = None) -> dict[str, Column]:
    """Proxies of confidence and margin; `passes` are the answers of shallow passes, which agree if all that aren't
    blank are equal."""
    t, a = stripped(reasoning), stripped(answer)
    hedges = F.size(all_of(t, rf"(?iU)\b(?:{SELECTIVE_HEDGES})\b"))
    clear, marker = a.rlike(rf"^{PLAIN_NUMBER}$"), word(t, "final answer|answer:")
    agreed = F.lit(False)
    if passes is not None:
        kept = F.array_distinct(F.filter(F.transform(passes, stripped), lambda x: x != ""))
        agreed = F.coalesce(F.size(kept) == 1, F.lit(False))
    margin = 100 - 35 * (F.size(F.array_distinct(all_of(t, PLAIN_NUMBER))) >= 4).cast("int") - F.least(F.lit(40), 12 * hedges) - 20 * (~clear).cast("int")
    tokens = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))
    confidence = F.when(clear, 40).otherwise(10) + 20 * marker.cast("int") + 20 * agreed.cast("int") + F.greatest(F.lit(0), 20 - 5 * hedges) - F.when(tokens > LONG_TOKENS, 10).otherwise(0)
    return {
        "confidence_proxy_score": unit(confidence), "agreement_between_multiple_shallow_passes": agreed, "decision_margin_proxy": unit(margin),
        "hedging_word_count": hedges, "final_answer_clarity": clear, "clear_final_marker": marker,
    }


def with_steps(df: DataFrame, question: str, reasoning: str, name: str = "step") -> DataFrame:
    """df with a struct on the steps of a reasoning: their number, the question's numbers they lack, whether adjacent
    steps share numbers, and a score."""
    t = full(F.col(reasoning))
    steps = F.filter(F.split(t, STEP_ENDS), lambda s: s.rlike(r"(?U)\S"))
    x = df.withColumn("__n", F.transform(steps, lambda s: F.array_distinct(all_of(s, PLAIN_NUMBER)))).withColumn("__q", F.array_distinct(all_of(full(F.col(question)), PLAIN_NUMBER)))
    n, q = F.col("__n"), F.col("__q")
    moves = F.greatest(F.size(n) - 1, F.lit(0))
    broken = F.size(F.filter(F.zip_with(F.slice(n, F.lit(1), moves), F.slice(n, F.lit(2), moves), lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)), lambda v: v))
    lacking = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_except(q, F.flatten(n))) / F.size(q))
    x, s = staged(x, "step", {"n": F.size(n), "eq": t.rlike(ANY_OPERATOR), "lacking": lacking, "broken": (moves > 0) & (5 * broken > 3 * moves)})
    score = 1.0 - F.least(F.lit(0.5), s["lacking"]) - F.when(s["broken"], 0.25).otherwise(0.0) - F.when(~s["eq"] & (s["n"] >= 3), 0.15).otherwise(0.0)
    out = F.struct(s["n"].alias("number_of_steps_detected"), s["eq"].alias("presence_of_equation_like_patterns"), s["lacking"].alias("missing_question_number_fraction"), s["broken"].alias("missing_transition_logic"), F.greatest(score, F.lit(0.0)).alias("step_consistency_score"))
    return unstaged(x.withColumn(name, out), "step").drop("__n", "__q")


def with_unified_error(df: DataFrame, question: str, reasoning: str, answer: str, passes: str | None = None) -> DataFrame:
    """df with the structs role, constraint, target, self, selective, calibration and step, and with
    unified_error_score and unified_confidence_score."""
    q, t, a = F.col(question), F.col(reasoning), F.col(answer)
    x = with_steps(with_constraints(with_role_coverage(df, question, reasoning, answer), question, reasoning, answer), question, reasoning)
    x, shared = staged(x, "shared", text_parts(q))
    parts = {"target": target_features(q, shared), "self": self_verification(t, a), "selective": selective_prediction(t, a, None if passes is None else F.col(passes)), "calibration": calibration(t, a)}
    x, flat = staged(x, "part", {f"{k}_{n}": c for k, v in parts.items() for n, c in v.items()})
    x = unstaged(x.withColumns({k: F.struct(*[flat[f"{k}_{n}"].alias(n) for n in v]) for k, v in parts.items()}), "part", "shared")
    bit = lambda c: c.cast("int")
    k, c, g = F.col("role"), F.col("constraint"), F.col("target")
    confidence = {"selective": F.col("selective")["confidence_proxy_score"], "calibration": F.col("calibration")["predicted_answer_format_confidence"], "self": F.col("self")["self_verification_score"], "step": F.col("step")["step_consistency_score"]}
    error = {
        "role": F.least(F.lit(10), 2 * k["role_warning_score"] + 3 * k["role_strong_error_score"]) / 10,
        "constraint": (25 * bit(c["target_quantity_mismatch_suspected"]) + 20 * bit(c["constraint_word_conflict_suspected"]) + 20 * bit(c["answer_type_mismatch_suspected"])) / 100,
        "target": (15 * bit(g["likely_intermediate_quantity_ask"]) + 10 * bit(g["potential_answer_echo_risk"])) / 100,
    } | {n: 1.0 - v for n, v in confidence.items()}
    total = lambda values, weights: F.greatest(F.least(reduce(lambda u, v: u + v, [w * values[n] for n, w in weights.items()]), F.lit(1.0)), F.lit(0.0))
    return x.withColumns({"unified_error_score": total(error, ERROR_WEIGHTS), "unified_confidence_score": total(confidence, CONFIDENCE_WEIGHTS)})
