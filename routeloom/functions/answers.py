"""Answer extraction and normalisation as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define the extractors.
ANSWER_NUMBER = r"-?[$]?[0-9,]+(?:\.[0-9]+)?"
FINAL_CUE = r"(?i)(?:final answer|answer\s*:|so the answer is|therefore|thus|hence|result\s*:)"
CUE_WORDS = ("answer", "therefore", "thus", "hence", "result")
EDGE_SPACE = r"(?U)^\s+|\s+$"
LETTER_FINAL = r"(?i)(?:final answer|answer)\s*:\s*\(?\s*([A-J])\s*\)?"
BOOLEAN = r"(?iU)\b(true|false|yes|no|y|n|0|1)\b"
HEDGES = "maybe|perhaps|possibly|probably|might|could be|not sure|unclear"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def filled(value: Column) -> Column:
    """Null for an empty text; the value is computed once."""
    return F.try_element_at(F.array_remove(F.array(value), F.lit("")), F.lit(1))


def first_filled(*options: Column) -> Column:
    """The first that is neither null nor empty, else empty; those after it aren't computed, and none is twice."""
    return F.coalesce(*map(filled, options), F.lit(""))


def normalized_number(raw: Column) -> Column:
    """Without "$", "," and an end point; leading zeros and trailing decimal zeros go, as "72.0" and "007" are 72 and 7."""
    c = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[$,]", ""), r"\.+$", "")
    c = F.regexp_replace(c, r"^(-?[0-9]+(?:\.[0-9]*[1-9])?)\.?0*$", "$1")
    return F.regexp_replace(c, r"^(-?)0+([0-9]+(?:\.[0-9]+)?)$", "$1$2")


def last_number(text: Column) -> Column:
    """The last number, normalised; empty without one."""
    return F.coalesce(normalized_number(F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER_NUMBER), F.lit(0)), F.lit(-1))), F.lit(""))


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def last_lines(text: Column, n: int) -> Column:
    """The last n lines that aren't blank."""
    return F.array_join(F.reverse(F.slice(F.reverse(non_blank_lines(text)), 1, n)), "\n")


def after_last(text: Column, pattern: str, words: tuple[str, ...] = ()) -> Column:
    """What follows the last match, null without one. The pattern is only looked for in texts that have one of the words,
    in any case, of which each match must have one."""
    found = let(F.split(text, pattern, -1), lambda parts: F.when(F.size(parts) > 1, F.element_at(parts, -1)))
    if not words:
        return found
    lower, some = F.lower(text), F.lit(False)
    for w in words:
        some = some | F.contains(lower, F.lit(w))
    return F.when(some, found)


def after_cue(text: Column) -> Column:
    return after_last(text, FINAL_CUE, CUE_WORDS)


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^\r\n]*", 0)


BOX = "\\boxed{"


def boxed(text: Column) -> Column:
    """Content of the last boxed expression, to the brace that closes it at any depth, without white space at its ends;
    empty without one or if it isn't closed. An expression that isn't closed hides those before it.

    What follows the last mark is cut at its closing braces; after k of them the depth is 1 + opening braces so far - k,
    and the content ends where that first is 0. Texts without the mark are only searched for it.
    """

    def read(parts: Column) -> Column:
        def step(at: Column, part: Column) -> Column:
            depth = at["depth"] + F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit(""))) - 1
            ended = at["depth"] == 0
            return F.struct(F.when(ended, 0).otherwise(depth).alias("depth"), (at["parts"] + F.when(ended, 0).otherwise(1)).alias("parts"))

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("parts"))
        closed = F.slice(parts, 1, F.size(parts) - 1)  # the last part isn't followed by a brace
        end = F.aggregate(closed, start, step)
        return let(end, lambda e: F.when(e["depth"] == 0, F.regexp_replace(F.array_join(F.slice(parts, 1, e["parts"]), "}"), EDGE_SPACE, "")))

    rest = F.when(F.contains(text, F.lit(BOX)), F.split(F.substring_index(text, BOX, -1), r"\}", -1))
    return F.coalesce(let(rest, lambda parts: F.when(F.size(parts) > 1, read(parts))), F.lit(""))


def numeric_answer(text: Column) -> Column:
    """Boxed number, else the last number in the line after the last cue or the 200 characters after it, else in the
    last three lines, else anywhere; empty if there is none."""

    def read(t: Column, trailing: Column) -> Column:
        return first_filled(last_number(boxed(t)), last_number(first_line(trailing)), last_number(F.substring(trailing, 1, 200)), last_number(last_lines(t, 3)), last_number(t))

    return let(F.trim(F.coalesce(text, F.lit(""))), lambda t: let(after_cue(t), lambda trailing: read(t, trailing)))


def choice_letter(text: Column) -> Column:
    """A-J: the last "answer: X", else the last "(X)", else the last lone letter of the last five lines; empty if none."""
    last = lambda x, p: F.try_element_at(F.regexp_extract_all(x, F.lit(p), F.lit(1)), F.lit(-1))

    def read(t: Column) -> Column:
        said = F.when(F.contains(F.lower(t), F.lit("answer")), last(t, LETTER_FINAL))
        bracketed = F.when(F.contains(t, F.lit("(")), last(t, r"\(\s*([A-Ja-j])\s*\)"))
        return F.upper(F.coalesce(said, bracketed, last(last_lines(t, 5), r"(?<![A-Za-z])([A-Ja-j])(?![A-Za-z])"), F.lit("")))

    return let(F.trim(F.coalesce(text, F.lit(""))), read)


def boolean_answer(text: Column) -> Column:
    """"true" or "false" by the last token that says so, else empty."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    token = F.regexp_extract(t, "(?s)^.*" + BOOLEAN, 1)  # from the end backwards
    return let(token, lambda x: F.when(x.isin("true", "yes", "y", "1"), "true").when(x.isin("false", "no", "n", "0"), "false").otherwise(""))


def text_answer(text: Column) -> Column:
    """Lower case, white space collapsed, edge punctuation removed."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(t, r"^[ .,;:!?]+|[ .,;:!?]+$", "")


def calibration(text: Column, answer: Column) -> dict[str, Column]:
    """Format confidence of an answer and its bin."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    pattern = F.lit(r"-?[0-9]+(?:\.[0-9]+)?")
    clean = a.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    many = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(0)))) >= 4
    several = F.size(F.regexp_extract_all(a, pattern, F.lit(0))) > 1
    tenths = F.when(clean, 8).otherwise(3) - 2 * many.cast("int") - 2 * several.cast("int")
    score = F.greatest(F.least(tenths, F.lit(10)), F.lit(0))
    return {
        "predicted_answer_format_confidence": score / 10,
        "calibration_bin": F.when(score >= 7, "high_confidence").when(score >= 5, "medium_confidence").otherwise("low_confidence"),
        "format_clean_numeric": clean,
        "format_many_numeric_candidates": many,
    }


def math_text(raw: Column) -> Column:
    """A symbolic answer in plain form: boxes, dollar signs, spacing and outer parentheses go, numbers inside are normalised."""
    c = let(F.trim(raw), lambda x: first_filled(F.trim(boxed(x)), x))
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)^(\$+)\s*(.*?)\s*\$+$", "$2"), r"[.;,]+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^[:= ]+", ""), r"\\left|\\right|\\[,!;:]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\\[td]frac", r"\\frac"), r"(?U)\s+", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3})", ""), r"(?<![0-9.A-Za-z\\])0+(?=[0-9])", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=[0-9])\.0+(?![0-9])", ""), r"(\.[0-9]*[1-9])0+(?![0-9])", "$1")
    c = F.regexp_replace(c, r"^\(([^,]*)\)$", "$1")
    return let(c, lambda x: F.when(F.regexp_replace(x, r"\$", "").rlike(rf"^{ANSWER_NUMBER}$"), normalized_number(x)).otherwise(x))


def math_answer(text: Column) -> Column:
    """Boxed content, else after the last cue its inline formula or first line, else the same of the last three lines,
    in plain form; empty for blank texts."""
    inline = lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?s)\$(.+?)\$"), F.lit(1)), F.lit(-1))

    def read(t: Column, trailing: Column) -> Column:
        options = [boxed(t), inline(F.substring(trailing, 1, 200)), F.trim(first_line(trailing)), inline(last_lines(t, 3)), last_lines(t, 1)]
        return math_text(first_filled(*options))

    trailing = lambda t: F.regexp_replace(after_cue(t), r"^\s+", "")
    return let(F.trim(F.coalesce(text, F.lit(""))), lambda t: let(trailing(t), lambda x: read(t, x)))
