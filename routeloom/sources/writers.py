"""Writers of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def write_union_csv(tables: list[DataFrame], path: str) -> None:
    """All tables in one, columns sorted by name, missing ones empty."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    write_csv(u.select(*sorted(u.columns)), path)


def write_records(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, partitioned by columns if given."""
    w = rows.write
    (w.partitionBy(*by) if by else w).json(path)


def class_balance(candidates: DataFrame) -> DataFrame:
    """(action_name, n, mean_correct, mean_utility) of candidate rows."""
    return candidates.groupBy("action_name").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("mean_correct"), F.avg("final_utility").alias("mean_utility"))
