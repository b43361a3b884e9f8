"""Where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder to the one that spark.checkpoint.dir names. Where it is unset, a temporary one serves if
    Spark runs in this one process; on a cluster that is an error, as its machines wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='routeloom-')}")
