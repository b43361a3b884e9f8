"""Readers of question, outcome and candidate files. All take a path that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BENCHMARK = "dataset string, question_id string, question string, options array<string>, answer string, answer_format string, category string, task string, source_split string, metadata map<string,string>"
CONSISTENCY = "question_id string, question string, gold_answer string, candidate_answers array<struct<answer:string,is_correct:boolean,failure_type:string>>"
CANDIDATES = "prompt_id string, action_name string, action_cost double, final_utility double"
ORACLE = "question_id string, strategy string, correct string"


def numbered(rows: DataFrame, name: str = "ord") -> DataFrame:
    """rows with their number in file order, from 0 without gaps: partitions are numbered each on its own and moved by
    the rows before them (a row for each partition is gathered)."""
    x = rows.withColumn("__id", F.monotonically_increasing_id())
    part, inside = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = x.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("__part", before.alias("__before"))
    return x.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(name, F.col("__before") + inside).drop("__id", "__part", "__before")


def questions(spark: SparkSession, path: str, split: str = "test", multi_line: bool = True, limit: int | None = None, tail: int | None = None, dataset: str | None = None) -> DataFrame:
    """(ord, id, question, answer) of a JSON file or of JSON lines: ids fall back to id and then to the dataset (if given), split and
    ordinal (empty ones count as missing), questions to `problem`; the gold answer, or else the answer, is what follows
    "####", else the whole, without commas. limit takes the first rows, tail the last."""
    raw = spark.read.schema("question_id string, id string, question string, problem string, answer string, gold_answer string").option("multiLine", multi_line).json(path)
    r = numbered(raw)
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    answer = F.coalesce(filled("gold_answer"), filled("answer"), F.lit(""))
    gold = F.regexp_extract(answer, r"(?s)####\s*(.+)", 1)
    ident = F.coalesce(filled("question_id"), filled("id"), F.concat(F.lit(f"{dataset}_{split}_" if dataset else f"{split}_"), F.col("ord").cast("string")))
    out = r.select("ord", ident.alias("id"), F.coalesce("question", "problem").alias("question"), F.trim(F.translate(F.coalesce(F.nullif(gold, F.lit("")), answer), ",", "")).alias("answer"))
    if tail is not None:
        return out.orderBy(F.desc("ord")).limit(tail).orderBy("ord")
    return out.orderBy("ord").limit(limit) if limit is not None else out


def choices(raw: Column) -> Column:
    """Strings of a list in Python or JSON notation, quotes of either kind with escapes; anything else gives an empty list."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    quoted = F.regexp_extract_all(t, F.lit(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""), F.lit(0))
    plain = F.transform(quoted, lambda x: F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return F.when(t.rlike(r"^\[\s*(?:(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")\s*(?:,\s*|(?=\])))*\]$"), plain).otherwise(F.array().cast("array<string>"))


def normalized_rows(rows: DataFrame, prefix: str, questions: tuple = ("question", "problem", "query", "prompt"), answers: tuple = ("answer", "gold_answer", "solution", "target")) -> DataFrame:
    """(id, question, answer) of uploaded rows: the first filled column of each list, names without case; rows that lack
    a question or an answer are left out, and ids fall back to prefix and ordinal."""
    names = {c.lower(): c for c in rows.columns}
    pick = lambda options: F.coalesce(*[F.nullif(F.trim(F.col(names[o]).cast("string")), F.lit("")) for o in options if o in names], F.lit(None).cast("string"))
    r = numbered(rows, "__ord")
    ident = F.coalesce(pick(("question_id", "id")), F.concat(F.lit(f"{prefix}_"), F.col("__ord").cast("string")))
    return r.select(ident.alias("id"), pick(questions).alias("question"), pick(answers).alias("answer")).where("question is not null and answer is not null")


def benchmark_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).json(path)


def consistency_candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per question and candidate, in order."""
    r = spark.read.schema(CONSISTENCY).option("multiLine", True).json(path)
    return r.select("question_id", "question", "gold_answer", F.posexplode("candidate_answers").alias("position", "c")).select("question_id", "question", "gold_answer", "position", "c.*")


def candidate_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATES).option("header", True).csv(path)


def oracle_counts(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, n_correct) of an outcome CSV: blank ids are dropped, values that aren't numbers count 0."""
    r = spark.read.schema(ORACLE).option("header", True).csv(path).where("trim(question_id) <> ''")
    return r.groupBy("question_id").agg(F.sum(F.coalesce(F.expr("try_cast(correct as int)"), F.lit(0))).alias("n_correct"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash order of the key and seed, in key order."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).orderBy(key)


def multiple_choice(problem: str = "problem") -> list:
    """Columns stem, a, b, c, d of a text with options (A) to (D)."""
    p = r"(?s)^(.*?)\(?A[).]\s*(.*?)\s*\(?B[).]\s*(.*?)\s*\(?C[).]\s*(.*?)\s*\(?D[).]\s*(.*)$"
    return [F.trim(F.regexp_extract(problem, p, i)).alias(n) for i, n in enumerate(("stem", "a", "b", "c", "d"), 1)]
