"""Quality rules: a table of thresholds compiled into one projection over counts of a text's words, symbols and lines.

A rule bounds a percentage of two counts, as in `100 * n_symbols <= 10 * n_words`: integers, so that results don't depend
on rounding. Counts are DataFrame functions over the row's own text: nothing is shuffled and no Python runs.

Repeated three-word windows are found within the row: each window's hash and position are packed into one long, the longs
are sorted, and a window counts as repeated if one of the two before or after it in that order has the same hash bits and
the same words. (Only if two other windows with the same hash bits, 64 less those of the position, lie between two equal
ones are these missed.)
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import table, text_or_empty

# Fixed values.
SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = {
    "en": "the of and a to in is was for on with as by that it at be this are or from have not but",
    "de": "der die das und in zu den von mit ist des im für auf ein eine dem nicht als auch an es",
    "fr": "le la les de des du un une et à en est que qui dans pour par sur au pas plus il ce",
    "es": "el la los las de del y en que a un una es por con para se no su al lo como más",
}
_STOPS = sorted({form for words in STOP_WORDS.values() for w in words.split() for form in (w, w.capitalize(), w.upper())})


class Rule(NamedTuple):
    """100 * count lies between least * per and most * per; a bound that is None holds."""

    name: str
    count: str
    per: str
    least: int | None
    most: int | None


#: Rules that a text must pass at all, and those that judge the rest.
BASE = (Rule("words", "n_words", "one", 5000, None), Rule("repeated_words", "n_repeat_words", "n_words", None, 50))
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def passes(rule: Rule) -> Column:
    """Column of one rule over the columns COUNTS; `one` stands for 1."""
    per = F.lit(1).cast("long") if rule.per == "one" else F.col(rule.per)
    at = 100 * F.col(rule.count)
    bounds = [at >= rule.least * per] * (rule.least is not None) + [at <= rule.most * per] * (rule.most is not None)
    return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else F.lit(True)


def verdict(rules: Sequence[Rule]) -> Column:
    """True if all rules of the table pass."""
    out = F.lit(True)
    for r in rules:
        out = out & passes(r)
    return out


def failures(rules: Sequence[Rule]) -> Column:
    """Names of the rules that fail, comma-separated, in the table's order."""
    return F.concat_ws(",", *(F.when(~passes(r), F.lit(r.name)) for r in rules)) if rules else F.lit("")


def _repeated(words: str, keys: str, bits: str) -> Column:
    """Positions whose three-word window has an equal one, ascending."""
    place = lambda k: k.bitwiseAND(F.expr(f"shiftleft(1L, {bits}) - 1")).cast("int")
    key = lambda k: F.call_function("shiftright", k, F.col(bits))
    word = lambda k, d: F.get(F.col(words), place(k) + d)

    def equal(k, other):
        same = key(other) == key(k)
        for d in range(3):
            same = same & (word(other, d) == word(k, d))
        return same

    def any_near(k, j):
        near = [F.coalesce(equal(k, F.get(F.col(keys), j + d)), F.lit(False)) for d in (1, -1, 2, -2)]
        return near[0] | near[1] | near[2] | near[3]

    return F.sort_array(F.transform(F.filter(keys, any_near), place))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS): counts, as longs, over each whole text.

    Words are runs of other characters than space, tab, LF, VT, FF and CR; lines are \\n-split and count if they have a
    word. A null text counts as empty: all zero. Rows are counted one by one, so null, equal or repeated ids keep their
    rows, an empty table gives an empty table, and other columns aren't read. A text is held with some 60 bytes a word.
    """
    text = F.col("_text")
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n, lines = F.size("words"), F.size("lines")
    count = lambda col, test: F.size(F.filter(col, test)).cast("long")
    d = d.select(
        "doc_id", "words", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.bin(n)).alias("bits"), count("words", lambda w: w.isin(_STOPS)).alias("n_stop_words"),
        lines.cast("long").alias("n_lines"), (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count("lines", lambda x: F.rlike(x, F.lit(f"^[{SPACE}]*[-*•]"))).alias("n_bullet_lines"),
        count("lines", lambda x: F.rlike(x, F.lit(f"(\\.\\.\\.|…)[{SPACE}]*\\z"))).alias("n_ellipsis_lines"),
    )
    window = lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(3)))
    packed = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.call_function("shiftleft", window(i), F.col("bits")).bitwiseOR(i.cast("long")))
    d = d.withColumn("keys", F.when(F.col("n_words") > 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("at", _repeated("words", "keys", "bits"))
    # each window covers three words, less those of the one before
    covered = F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(p - F.get(F.col("at"), j - 1), F.lit(3))))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).select("doc_id", *COUNTS)


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """counted() with base_failed (a rule of `base` fails), kept (all rules pass) and failed_rules, comma-separated. An
    empty table of rules passes all texts."""
    d = counted(docs, id_col, text_col)
    return d.select("*", (~verdict(base)).alias("base_failed"), (verdict(base) & verdict(rules)).alias("kept"), failures([*base, *rules]).alias("failed_rules"))


def rule_table(rules: DataFrame) -> list[Rule]:
    """Rules from a table (name, count, per, least, most) of at most 1,000 rows; counts are those of COUNTS, `one` is 1."""
    rows = rules.select("name", "count", "per", "least", "most").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 rules")
    known = {*COUNTS, "one"}
    for r in rows:
        if r["count"] not in known or r["per"] not in known:
            raise ValueError(f"rule {r['name']}: unknown count")
    return [Rule(r["name"], r["count"], r["per"], r["least"], r["most"]) for r in rows]


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _sql_rule(rule: Rule) -> str:
    per = "1" if rule.per == "one" else rule.per
    bounds = [f"100 * {rule.count} >= {rule.least} * {per}"] * (rule.least is not None) + [f"100 * {rule.count} <= {rule.most} * {per}"] * (rule.most is not None)
    return f"({' AND '.join(bounds)})"


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{SPACE}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM d),
  t AS (SELECT doc_id, unnest(words) AS a, unnest(range(1, len(words) + 1)) AS i FROM w),
  p AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p WHERE c IS NOT NULL),
  r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
  c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(words, lambda x: x IN ({', '.join(f"'{x}'" for x in _STOPS)}))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[{SPACE}]*[-*•]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{SPACE}]*\\z'))) AS n_ellipsis_lines FROM w LEFT JOIN r USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({' AND '.join(map(_sql_rule, BASE))}) AS base_failed, {' AND '.join(map(_sql_rule, [*BASE, *RULES]))} AS kept,
    concat_ws(',', {', '.join(f"CASE WHEN NOT {_sql_rule(r)} THEN '{r.name}' END" for r in [*BASE, *RULES])}) AS failed_rules FROM c"""
