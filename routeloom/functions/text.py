"""Question-side and output-side features of text, as Columns that stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and cue words that define the features.
NUMBER = r"-?[0-9]+(?:[,_][0-9]{3})*(?:\.[0-9]+)?"
EQUATION = r"[0-9]\s*[+\-*/=]\s*[0-9]"
FRACTION = r"[0-9]+\s*/\s*[0-9]+"
PERCENT = r"[0-9]+\s*%"
CURRENCY = r"[$€£¥₹]"
SENTENCE_END = r"[.!?]+"
WORDS = {
    "multi_step": "total|remaining|after|left|difference|each|every|altogether|twice|half|percent|ratio|average|consecutive",
    "uncertainty": "not sure|uncertain|unclear|i don'?t know|cannot determine|it depends|may be|might be|possibly|probably",
    "remaining": r"remaining|left\s*over|left|have\s+left|are\s+left|is\s+left",
    "total": r"total|altogether|in\s+all|combined|grand\s+total",
    "difference": r"difference|how\s+much\s+more|how\s+many\s+more|more\s+than|less\s+than|fewer\s+than|how\s+much\s+less",
    "rate": r"per|each|every|apiece|a\s+piece|per\s+day|per\s+week|per\s+hour|per\s+month|per\s+year|rate|per\s+minute",
    "money": "dollar|dollars|cent|cents|euro|euros|pound|pounds|rupee|rupees|yen",
    "time": "minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|second|seconds",
    "subtraction": r"spent|spend|lost|lose|loses|gave\s+away|give\s+away|sold|sell|sells|used|uses|use\s+up|used\s+up|ate|eaten|consumed|donated|gave|given",
    "addition": r"also|then|together|as\s+well|additionally|on\s+top\s+of|plus|added|add|combined\s+with",
    "operation": "bought|buy|buys|sold|sell|sells|earned|earn|earns|spent|spend|spends|received|receive|receives|gave|give|gives|took|take|takes|found|find|finds|added|add|adds|subtracted|subtract|subtracts|multiplied|multiply|divided|divide|collected|collect|collects|paid|pay|pays|saved|save|saves|won|win|wins|lost|lose|loses|ate|eat|eats|eaten|used|uses|donated|donate",
}
FINAL_CUE = r"\b(?:final answer|the answer is|therefore|thus|so the|answer:|= \d)"


#: Letters that Java's case-blind matching takes for s, i and k.
_ALIKE = ("\u017f\u0130\u0131\u212a", "siik")


def has_word(text: Column, words: str) -> Column:
    """Whether one of the alternatives stands as a whole word, upper or lower case, with Unicode word boundaries."""
    return text.rlike(rf"(?iU)\b(?:{words})\b")


def distinct_words(text: Column) -> Column:
    """The different runs of word characters of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(F.translate(text, *_ALIKE)), r"(?U)\W+"))


def has_cue(text: Column, words: Column, cues: str) -> Column:
    """has_word by a look-up of the one-word alternatives among the text's words; only the others are searched for, and
    only where the text has the first word of one."""
    plain = [c for c in cues.split("|") if c.isalpha()]
    spaced = [c for c in cues.split("|") if not c.isalpha()]
    found = F.arrays_overlap(words, F.array(*map(F.lit, plain)))
    # an alternative that begins or ends with a plain one, apart by white space, is found with it
    parts = {c: re.split(r"\\s[+*]", c) for c in spaced}
    spaced = [c for c in spaced if r"\s*" in c or not set(parts[c]) & set(plain)]
    if not spaced:
        return found
    joined = [c.replace(r"\s*", "") for c in spaced if r"\s*" in c]
    heads = sorted({parts[c][0] for c in spaced} | set(joined))
    return found | (F.arrays_overlap(words, F.array(*map(F.lit, heads))) & has_word(text, "|".join(spaced)))


def text_parts(text: Column) -> dict[str, Column]:
    """What the features of a text share, to be staged as columns: the text, its words, number tokens and sentences."""
    t = F.coalesce(text, F.lit(""))
    return {"text": t, "words": distinct_words(t), "tokens": number_tokens(t), "sentences": sentences(t)}


def with_parts(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """df with the parts as columns of their own, so that each is computed once a row, and references to them."""
    parts = text_parts(F.col(text))
    return df.withColumns({f"__part_{k}": v for k, v in parts.items()}), {k: F.col(f"__part_{k}") for k in parts}


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles, without their separators."""
    return F.transform(number_tokens(text), lambda x: F.regexp_replace(x, "[,_]", "").cast("double"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda x: x.rlike(r"(?U)\S"))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def query_features(text: Column, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """The 13 question features by name; null text counts as empty. parts: staged ones, see with_parts."""
    p = parts or text_parts(text)
    t, tokens = p["text"], p["tokens"]
    n = F.transform(tokens, lambda x: F.regexp_replace(x, "[,_]", "").cast("double"))
    most, least = F.array_max(n), F.array_min(n)
    return {
        "question_length_chars": F.length(t),
        "question_length_tokens_approx": token_count(t),
        "num_numeric_mentions": F.size(tokens),
        "num_sentences_approx": F.size(p["sentences"]),
        "has_multi_step_cue": has_cue(t, p["words"], WORDS["multi_step"]),
        "has_equation_like_pattern": t.rlike(EQUATION),
        "has_percent_symbol": t.rlike(PERCENT),
        "has_fraction_pattern": t.rlike(FRACTION),
        "has_currency_symbol": t.rlike(CURRENCY),
        "max_numeric_value_approx": F.coalesce(most, F.lit(0.0)),
        "min_numeric_value_approx": F.coalesce(least, F.lit(0.0)),
        "numeric_range_approx": F.when(F.size(tokens) >= 2, most - least).otherwise(0.0),
        "repeated_number_flag": F.size(tokens) != F.size(F.array_distinct(tokens)),
    }


def target_features(text: Column, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """The 11 target-quantity, wording-trap and answer-risk cues. parts: staged ones, see with_parts."""
    p = parts or text_parts(text)
    t, words, s, n = p["text"], p["words"], p["sentences"], F.size(p["tokens"])
    cue = lambda name: has_cue(t, words, WORDS[name])
    verbs = F.array_intersect(words, F.array(*map(F.lit, WORDS["operation"].split("|"))))
    remaining, total = cue("remaining"), cue("total")
    return {
        "asks_remaining_or_left": remaining,
        "asks_total": total,
        "asks_difference": cue("difference"),
        "asks_rate_or_unit": cue("rate"),
        "asks_money": cue("money") | t.rlike(CURRENCY),
        "asks_time": cue("time"),
        "has_subtraction_trap_verb": cue("subtraction"),
        "has_addition_trap_structure": cue("addition"),
        "has_multi_operation_hint": F.size(verbs) >= 2,
        "likely_intermediate_quantity_ask": (F.size(s) >= 3) & (n >= 3) & ~(total | remaining),
        "potential_answer_echo_risk": (n >= 4) & (F.size(s) > 0) & (token_count(F.element_at(s, -1)) <= 12),
    }


def first_pass_features(output: Column, parsed: Column | None = None) -> dict[str, Column]:
    """The 6 features of a first-pass output; with a parsed answer, success means that it isn't blank."""
    t = F.coalesce(output, F.lit(""))
    n = F.size(number_tokens(t))
    return {
        "first_pass_parse_success": n > 0 if parsed is None else F.trim(F.coalesce(parsed, F.lit(""))) != "",
        "first_pass_output_length": F.length(t),
        "first_pass_has_final_answer_cue": t.rlike(rf"(?iU){FINAL_CUE}"),
        "first_pass_has_uncertainty_phrase": has_word(t, WORDS["uncertainty"]),
        "first_pass_num_numeric_mentions": n,
        "first_pass_empty_or_malformed_flag": F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) < 3,
    }


def difficulty_score(text: Column) -> Column:
    f = query_features(text)
    part = lambda name, top: F.least(F.lit(1.0), f[name] / float(top))
    return 0.35 * part("question_length_chars", 1200) + 0.35 * part("num_numeric_mentions", 12) + 0.3 * part("num_sentences_approx", 8)


def hardness_score(text: Column) -> Column:
    f = query_features(text)
    return 0.01 * f["question_length_chars"] + 2.0 * f["num_numeric_mentions"] + 5.0 * f["has_multi_step_cue"].cast("int") + 3.0 * f["has_equation_like_pattern"].cast("int") + 2.0 * f["numeric_range_approx"]
