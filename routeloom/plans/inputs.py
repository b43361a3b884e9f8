"""The driver's tables seen as this engine's inputs, in Spark and as SQL common table expressions.

orders are two-action routing rows, lines of an order its candidate actions, events a long log of answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines of orders in a partition, about.
LINES = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("regime"),
        (F.col("o_orderkey") % 10 < 7).cast("int").alias("rg"), (F.col("o_custkey") % 10 < 8).cast("int").alias("dpr"),
        ((F.col("o_orderkey") * 37) % 1000 / 1000).alias("confidence"), ((F.col("o_custkey") * 53) % 1000 / 1000).alias("error"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("tokens"),
    )


OUTCOMES = """o AS (SELECT o_orderkey AS question_id, o_custkey AS instance, o_orderpriority AS regime,
  CAST(o_orderkey % 10 < 7 AS INT) AS rg, CAST(o_custkey % 10 < 8 AS INT) AS dpr,
  CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 1000 AS confidence, CAST((o_custkey * 53) % 1000 AS DOUBLE) / 1000 AS error,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS tokens FROM orders)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, action, action_name, cost, action_cost, correct, final_utility): one row per order and line number. Lines
    are dealt by order once, for all groupings by it, over partitions whose number grows with the table, not their size."""
    l = read(spark, sf_dir, "lineitem")
    l = l.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), l.count() // LINES + 1), "l_orderkey")
    g = l.groupBy(F.col("l_orderkey").alias("prompt_id"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("action")).agg(
        F.min("l_quantity").cast("int").alias("cost"), F.max((F.col("l_suppkey") % 3 == 0).cast("int")).alias("correct"), F.max(F.col("l_partkey") % 100).alias("u"))
    return g.select("prompt_id", "action", F.col("action").alias("action_name"), "cost", F.col("cost").cast("double").alias("action_cost"), "correct", (F.col("u") / 100).alias("final_utility"))


CANDIDATES = """c AS (SELECT l_orderkey AS prompt_id, 'a' || l_linenumber AS action, 'a' || l_linenumber AS action_name,
  CAST(min(l_quantity) AS INT) AS cost, CAST(CAST(min(l_quantity) AS INT) AS DOUBLE) AS action_cost,
  max(CAST(l_suppkey % 3 = 0 AS INT)) AS correct, CAST(max(l_partkey % 100) AS DOUBLE) / 100 AS final_utility
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("question_id"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("answer"), F.col("event_id").alias("position"))


ANSWERS = "v AS (SELECT user_id AS question_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS answer, event_id AS position FROM events)"


_PROBLEMS = [
    "'Ann has ' || n || ' apples and gave away ' || m || '. How many apples are left?'",
    "'Each box holds ' || m || ' books. What is the minimum number of boxes for ' || n || ' books?'",
    "'Tickets cost $' || m || ' each. How much is the total for ' || n || ' people?'",
    "'On what day does the trip of ' || n || ' days end?'",
    "'Bob earned ' || n || ' dollars and spent half of the remaining ' || m || ' dollars. How much more is left?'",
    "'Sam bought three pens and ' || n || ' books, twice as many as Kim. How many in total?'",
]
_REASONINGS = [
    "n || ' - ' || m || ' = ' || (a - b) || '. Final answer: ' || (a - b)",
    "'First ' || n || ', then ' || m || '. So the total is ' || n",
    "'Maybe it is ' || m || ', but I think ' || n || ' is about right'",
    "'Final answer: Monday'",
    "''",
    "'We add ' || n || ' + ' || m || ' = ' || (a + b) || '.' || chr(10) || 'Therefore ' || (a + b) || '.' || chr(10) || 'Answer: ' || n",
    "'Final answer: -' || m || '.5'",
]


def _case(key: str, texts: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


_VALUES = "SELECT o_orderkey AS question_id, o_orderkey % 97 + 3 AS a, o_custkey % 41 + 2 AS b, o_orderkey % 6 AS i, o_custkey % 7 AS j FROM {orders}"
_TEXTS = "SELECT question_id, CAST(a AS {string}) AS n, CAST(b AS {string}) AS m, a, b, i, j FROM p0"


def word_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, q, t): a word problem and a reasoning per order."""
    p = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS question_id", "o_orderkey % 97 + 3 AS a", "o_custkey % 41 + 2 AS b", "o_orderkey % 6 AS i", "o_custkey % 7 AS j")
    p = p.selectExpr("*", "CAST(a AS STRING) AS n", "CAST(b AS STRING) AS m")
    return p.selectExpr("question_id", f"{_case('i', _PROBLEMS)} AS q", f"{_case('j', _REASONINGS)} AS t")


WORD_PROBLEMS = f"""p0 AS ({_VALUES.format(orders='orders')}), p1 AS ({_TEXTS.format(string='VARCHAR')}),
 w AS (SELECT question_id, {_case('i', _PROBLEMS)} AS q, {_case('j', _REASONINGS)} AS t FROM p1)"""
