"""Connected components of an edge table by least neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import collected, drop, saved, scratch_path, shuffles_freed

#: Rows of a partition of the tables that rounds write, about.
ROWS = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges -> (node, root), root being the least node of the component.

    In a round each node goes to its least neighbour if that is less, pointers are followed to their ends, and the edges
    become those between the ends, without loops and repeats; rounds end when none is left. So an edge is joined again
    only while it still connects two groups, and two rounds at least halve the nodes. Rounds write few files, and what
    they no longer need is deleted. A hub's edges meet its label in a join that Spark splits if skewed; the aggregation by
    the greater end is partial before its shuffle. Null ends are ignored, repeated edges and loops do no harm, an empty
    table gives an empty table.
    """
    spark = edges.sparkSession
    ordered = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out, mine = scratch_path(spark, "components"), []

    def kept(df: DataFrame, n: int) -> DataFrame:
        with collected() as written:
            done = saved(df.coalesce(n // ROWS + 1), "round")
        mine.append(written)
        return done

    def forget(n: int) -> None:
        """Delete all tables of the rounds but the last n."""
        for written in mine[: len(mine) - n]:
            drop(spark, written)
        del mine[: len(mine) - n]

    with shuffles_freed(spark):
        with collected() as first:
            left = saved(ordered(edges.where("a is not null and b is not null")), "edges")
        mine.append(first)
        n = left.count()
        labels = left.select(F.col("b").alias("node"), F.col("a").alias("root")).limit(0)
        while n:
            hooks = kept(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), n)
            falling = True
            while falling:
                jump = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
                moved = kept(hooks.select("node", "root").join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("fell")), n)
                falling, hooks = bool(moved.where("fell").limit(1).count()), moved
            far = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            known = labels.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
            labels = kept(known.union(hooks.select("node", "root")), 2 * n)
            ends = left.join(hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b").where("a <> root_b")
            ends = ends.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
            left = kept(ordered(ends.select(F.coalesce("root_a", "a").alias("a"), F.col("root_b").alias("b"))), n)
            forget(2)
            n = left.count()
        labels.union(labels.select(F.col("root").alias("node"), "root").distinct()).coalesce(labels.count() // ROWS + 1).write.parquet(out)
        forget(0)
    return spark.read.schema(labels.schema).parquet(out)
