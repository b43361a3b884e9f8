"""Comparing predicted answers with gold ones, A-D letters, and signals of a first pass, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import text as T
from routeloom.functions.answers import first_filled, let, math_text, numeric_answer
from routeloom.functions.consistency import with_constraints

# Patterns of the A-D letter in the order in which they are tried, and of numbers in an output's tail.
BOXED_LETTER = r"(?i)\\boxed\s*\{\s*\\?(?:mathrm|text|textbf)?\s*([A-D])\s*\}"
SAID_LETTER = r"(?i)(?:final answer|answer)\s*[:.]?\s*([A-D])\b"
BRACKETED_LETTER = r"\(\s*([A-Da-d])\s*\)"
LONE_LETTER = r"^\s*([A-Da-d])\s*[.)]?\s*$"
TAIL_NUMBER = r"-?[0-9,]+(?:\.[0-9]+)?"
PLAIN_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
# What an error message of a model call says, by class, in the order in which classes are tried.
ACCESS_ERRORS = {
    "config": ("missing openai_api_key", "invalid api key"),
    "quota": ("insufficient_quota", "quota"),
    "rate_limit": ("rate limit", "rate_limit"),
    "model_access": ("model_not_found", "does not exist", "not have access", "access to the model", "permission"),
    "network": ("openai api request failed", "timed out"),
}
# Words of a question's pattern, in the order in which patterns are tried.
PATTERNS = {
    "remaining_target": ("remaining", "left", "remain"),
    "capacity_ceiling": ("minimum number", "at most", "capacity", "holds"),
    "rate_total": ("per", "each", "every", "rate"),
    "ratio_transform": ("ratio", "twice", "half", "double"),
}
#: White space as Java's \\s has it with Unicode classes.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def stripped(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))


def stripped_lines(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, LINE_END), stripped), lambda x: x != "")


def letter(raw: Column) -> Column:
    """Upper-case A-D of a text that is one such letter, else empty."""
    c = F.upper(stripped(raw))
    return F.when(c.isin("A", "B", "C", "D"), c).otherwise("")


def option_letter(text: Column) -> Column:
    """A-D of an output: the first boxed letter, the first after "answer", the first in brackets, the last of the last
    five lines that is a letter alone, else the last such character of the last 80; empty if none."""

    def read(t: Column) -> Column:
        lower = F.lower(t)
        lines = F.slice(F.reverse(stripped_lines(t)), 1, 5)
        alone = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, LONE_LETTER, 1)), lambda x: x != "")
        # a pattern is only looked for where the text has what each of its matches has
        return F.upper(first_filled(
            F.when(F.contains(lower, F.lit("\\boxed")), F.regexp_extract(t, BOXED_LETTER, 1)), F.when(F.contains(lower, F.lit("answer")), F.regexp_extract(t, SAID_LETTER, 1)),
            F.when(F.contains(t, F.lit("(")), F.regexp_extract(t, BRACKETED_LETTER, 1)), F.try_element_at(alone, F.lit(1)), F.regexp_extract(F.right(t, F.lit(80)), r"(?s)^.*([A-Da-d])", 1),
        ))

    return let(stripped(text), read)


def decimal_text(raw: Column) -> Column:
    """A number in its shortest decimal form, without "$", "," and an end point; anything else in lower case. Numbers
    with an exponent count as text."""
    c = F.regexp_replace(F.regexp_replace(stripped(raw), "[,$]", ""), r"\.+$", "")
    whole, part = F.regexp_extract(c, r"^[+-]?0*([0-9]*)", 1), F.regexp_replace(F.regexp_extract(c, r"\.([0-9]*)$", 1), "0+$", "")
    number = F.concat(F.when(c.startswith("-"), "-").otherwise(""), F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(c.rlike(PLAIN_DECIMAL), number).otherwise(F.lower(c))


def answers_match(gold: Column, predicted: Column, mode: str) -> Column:
    """Whether a prediction is the gold answer: "numeric" by decimal value, "math" by plain symbolic form, "mcq" by
    letter. A blank prediction never is."""
    if mode == "numeric":
        same = decimal_text(gold) == decimal_text(predicted)
    elif mode == "math":
        g = math_text(F.coalesce(gold, F.lit("")))
        same = (g != "") & (g == math_text(F.coalesce(predicted, F.lit(""))))
    elif mode == "mcq":
        same = (letter(gold) != "") & (letter(gold) == letter(predicted))
    else:
        raise ValueError(f"unknown answer mode {mode}")
    return (stripped(predicted) != "") & same


def exact_match(predicted: Column, gold: Column) -> Column:
    """Equality without case and white space at the ends."""
    return F.lower(stripped(predicted)) == F.lower(stripped(gold))


def tail_disagreement(text: Column, window: int = 400) -> Column:
    """Whether the last characters hold two different numbers."""
    found = F.regexp_extract_all(F.right(stripped(text), F.lit(window)), F.lit(TAIL_NUMBER), F.lit(0))
    return F.size(F.array_distinct(F.filter(F.transform(found, decimal_text), lambda x: x != ""))) >= 2


def final_mismatch(text: Column) -> Column:
    """Whether the last line's number differs from the whole output's, if both have one."""
    whole, last = numeric_answer(text), numeric_answer(F.coalesce(F.try_element_at(stripped_lines(F.coalesce(text, F.lit(""))), F.lit(-1)), F.lit("")))
    return (whole != "") & (last != "") & (decimal_text(whole) != decimal_text(last))


def difficulty_proxy(question: Column) -> Column:
    f = T.query_features(question)
    return 0.01 * f["question_length_chars"] + 2.0 * f["num_numeric_mentions"] + 5.0 * f["has_multi_step_cue"].cast("int")


def first_confidence(parsed: Column, uncertain: Column, n_signals: Column, malformed: Column) -> Column:
    """Confidence in a first output: a product of factors for parsing, hedging, constraint signals and emptiness."""
    c = F.when(parsed, 1.0).otherwise(0.25) * F.when(uncertain, 0.55).otherwise(1.0) * F.greatest(F.lit(0.15), 1.0 - 0.12 * n_signals) * F.when(malformed, 0.4).otherwise(1.0)
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def with_output_router(df: DataFrame, question: str, output: str, answer: str) -> DataFrame:
    """df with `confidence`, `tail_disagrees`, `final_differs` and `escalate`: whether any of six triggers is on - low
    confidence, a differing last line, a constraint signal, disagreeing numbers at the end, hedging, or a failed parse."""
    x = with_constraints(df, question, output, answer, "router")
    fp = T.first_pass_features(F.col(output), F.col(answer))
    x = x.withColumn("router_pass", F.struct(*[c.alias(k) for k, c in fp.items()]))
    p, n = F.col("router_pass"), F.col("router")["n_signals"]
    x = x.withColumns({
        "confidence": first_confidence(p["first_pass_parse_success"], p["first_pass_has_uncertainty_phrase"], n, p["first_pass_empty_or_malformed_flag"]),
        "tail_disagrees": tail_disagreement(F.col(output)), "final_differs": final_mismatch(F.col(output)),
    })
    on = (F.col("confidence") < 0.45) | F.col("final_differs") | (n > 0) | F.col("tail_disagrees") | p["first_pass_has_uncertainty_phrase"] | ~p["first_pass_parse_success"]
    return x.withColumn("escalate", on).drop("router", "router_pass")


def first_pass_signals(question: Column, output: Column, predicted: Column) -> dict[str, Column]:
    """The first-pass features, whether the tail's number differs from the prediction, whether the output is short for
    the question, and proxies of confidence and difficulty."""
    fp = T.first_pass_features(output, F.nullif(predicted, F.lit("")))
    tail = decimal_text(numeric_answer(F.right(F.coalesce(output, F.lit("")), F.lit(400))))
    p = F.coalesce(predicted, F.lit(""))
    short = (T.query_features(question)["num_numeric_mentions"] >= 3) & (fp["first_pass_num_numeric_mentions"] <= 1) & (fp["first_pass_output_length"] < 80)
    return fp | {
        "extraction_tail_mismatch": ((p != "") & (tail != "") & (p != tail)).cast("int"), "reasoning_length_short_vs_question": short.cast("int"),
        "confidence_proxy": 1.0 / (1.0 + fp["first_pass_has_uncertainty_phrase"].cast("double")), "difficulty_proxy": difficulty_proxy(question),
    }


def _first_class(text: Column, classes: dict[str, tuple], other: str) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(other)
    for name, parts in reversed(classes.items()):
        out = F.when(_any_of(t, parts), name).otherwise(out)
    return out


def _any_of(t: Column, parts: tuple) -> Column:
    on = F.contains(t, F.lit(parts[0]))
    for p in parts[1:]:
        on = on | F.contains(t, F.lit(p))
    return on


def access_error(message: Column) -> Column:
    """Class of a model call's error message."""
    return _first_class(message, ACCESS_ERRORS, "unknown")


def pattern_bucket(question: Column) -> Column:
    """Pattern of a question by the words it holds, inside longer words too."""
    return _first_class(question, PATTERNS, "other")
