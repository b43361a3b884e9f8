"""Corpus pipeline: quality filter, near-duplicate removal, mixing, piece encoding; each stage reads what the last wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routeloom.llm.common import collected, drop, scratch_path, table
from routeloom.llm.mixing import curriculum
from routeloom.llm.pieces import round_trip
from routeloom.llm.quality import keep_quality
from routeloom.llm.simhash import dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores at least 0.3."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group linked by a Jaccard similarity of at least 0.8 of the sets of five-word shingles."""
    return dedup(docs, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass, sorted by training position."""
    return curriculum(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations: doc_id, n_pieces, ids, lossless."""
    return round_trip(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]
#: The classifier is fitted, so SQL can't express the first stage; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written and read again, and what it and the one before it wrote besides is
    deleted then; what the last reads stays until common.clean."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collected() as written:
            done = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}")
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        drop(spark, [*before, *written])
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
