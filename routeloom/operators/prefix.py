"""Running sums over sorted rows without a task that holds a whole group.

Rows are dealt to ranges of the sort order, sums of each range give the offset of the next, and running sums inside a
range start there. A group, or a run of one group's rows, may go over many ranges; only rows that are equal in the order
are together in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.sources.scratch import ensure_checkpoints


def unused(columns, name: str) -> str:
    """The name, with underscores added until no column has it (Spark's names don't tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str], following: tuple[str, str] | None = None) -> DataFrame:
    """rows with, for each name: column of `sums`, the sum of that column over its group's rows up to this one by `order`
    (ascending, nulls first); with following = (name, column), also that column of the next row of the group, null at its end.

    `order` should tell rows of a group apart. Null groups are groups. rows are written once to the checkpoint folder,
    sorted into ranges; the table of ranges by group that is joined to them has at most groups + ranges rows.
    """
    ensure_checkpoints(rows.sparkSession)
    part = unused([*rows.columns, *sums], "range_")
    x = rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()).checkpoint()
    inside = W.partitionBy(*by, part).orderBy(*order)
    before = W.partitionBy(*by).orderBy(part)
    ends = [F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(following[1]).alias("value"))).alias("first_")] if following else []
    offsets = x.groupBy(*by, part).agg(*[F.sum(c).alias(f"sum_{i}") for i, c in enumerate(sums.values())], *ends)
    offsets = offsets.select(
        *[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], F.col(part).alias("part_"),
        *[F.coalesce(F.sum(f"sum_{i}").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"offset_{i}") for i in range(len(sums))],
        *([F.lead(F.col("first_")["value"]).over(before).alias("next_first_")] if following else []))
    inner = [F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"inner_{i}") for i, c in enumerate(sums.values())]
    if following:
        inner.append(F.lead(following[1]).over(inside).alias("next_in_"))
        inner.append((F.row_number().over(inside) == F.count(F.lit(1)).over(W.partitionBy(*by, part))).alias("last_"))
    x = x.select("*", *inner)
    on = F.col(part) == F.col("part_")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"by_{i}"))
    j = x.join(offsets, on)
    out = [(F.col(f"inner_{i}") + F.col(f"offset_{i}")).alias(name) for i, name in enumerate(sums)]
    if following:
        out.append(F.when(F.col("last_"), F.col("next_first_")).otherwise(F.col("next_in_")).alias(following[0]))
    return j.select(*rows.columns, *out)
