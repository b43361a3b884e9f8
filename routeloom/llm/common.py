"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about, and of the texts that a Python worker takes from it at once.
BATCH_BYTES, SLICE_BYTES = 16 << 20, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at or below BATCH_BYTES, so that a Python worker's memory doesn't follow the length of rows.
    The session keeps this bound; no operator's rows or groups depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b")
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches, column: int, most: int = SLICE_BYTES):
    """Parts of Arrow batches whose strings in a column have at most so many bytes together, or a row each."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            upto = max(at + 1, upto)
            yield b.slice(at, upto - at)
            at = upto


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one is set if Spark runs in
    this one process, as in tests; on a cluster, whose machines wouldn't see it, that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='routeloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/routeloom-{spark.sparkContext.applicationId}"


#: The list that the scratch paths of the present thread or task are added to, if any.
_COLLECTED: ContextVar[list[str] | None] = ContextVar("collected", default=None)


@contextmanager
def collected():
    """A list that gets the scratch paths given out inside, by this thread alone: what other operators write at the same
    time isn't in it."""
    paths: list[str] = []
    token = _COLLECTED.set(paths)
    try:
        yield paths
    finally:
        _COLLECTED.reset(token)


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (paths := _COLLECTED.get()) is not None:
        paths.append(path)
    return path


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch paths whose readers are done."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application's operators have written in the shared folder. Call it once their results, which
    are read from there, have been used."""
    drop(spark, [_own_dir(spark)])


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, Spark deletes a query's shuffle files as it ends, not when the driver happens to collect garbage. For jobs of
    many steps that save what they read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables of iterative jobs; Spark's cleaner removes the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def unused(columns, name: str) -> str:
    """The name, with underscores added until no column has it (Spark's names don't tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
