"""Work on texts, done once for equal ones and by all cores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators.prefix import unused

#: Rows of a partition, about.
ROWS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many partitions as shuffles or cores have, however few files it comes from. Spark merges no
    expressions across this, so what is computed before is not computed again for every use after. The keys are hashed, for
    Spark would leave out a repartition by what it has just grouped by, and so leave small tables in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(*keys))


def once_per_text(df: DataFrame, texts: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `add` gives its distinct texts, null being a text: each is worked on once, not in every row
    that has it. `add` must keep the texts' columns and rows, and depend on nothing else."""
    own = {t: unused(df.columns, f"own_{t}") for t in texts}
    done = add(spread(df.select(*texts).distinct(), *texts)).withColumnsRenamed(own)
    same = reduce(and_, [F.col(t).eqNullSafe(F.col(o)) for t, o in own.items()])
    return df.join(done, same, "left").drop(*own.values())


def partitions_for(df: DataFrame) -> int:
    """Partitions of some ROWS rows each, at least as many as shuffles have: their number grows with the rows, not their size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS + 1)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df with equal keys together, over partitions_for its rows."""
    return df.repartition(partitions_for(df), F.col(key))
