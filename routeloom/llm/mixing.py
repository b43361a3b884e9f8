"""Mixing sources to target weights with a time-varying curriculum.

Every source has a share of the mix and a weight schedule over training time 0..1. A source's words, documents in
seeded order and pass after pass, meet its cumulative demand, the integral of its schedule; inverting that integral at
a document's first word gives the document's training position. The mix is the documents, range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, checkpointed, saved, table, unused

WEIGHTS = (3.0, 1.0, 2.0)
#: Weight schedules, as (time, weight) knots joined by lines, given to the sources in turn: falling, rising, peak in the middle.
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)))
#: Rows of one source that a window sorts together, about.
BUCKET_ROWS = 50_000
#: Rows alike that a task puts in place.
RUN_ROWS = 10_000


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """sources with `place`: its number by code point, null last, from 0. Ranges are numbered each on its own and moved
    by the rows before them, so no task has all sources."""
    spark = sources.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    part = saved(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    base = part.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = part.withColumn("inside", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    return own.join(F.broadcast(base), "part").withColumn("place", (F.col("base") + F.col("inside")).cast("int")).drop("part", "base", "inside")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, place, target) for sizes (source, size): `share` of all words, dealt by the weights.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times its source's size and
    the excess goes to the others by weight until none is above: each round gives what the full sources leave to the
    others, and ends when no further source is full. A round is two sums; all of them are of whole numbers, so reruns
    agree.
    """
    src = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    src = checkpointed(src.select("source", "source_size", "place", w.alias("w"), (most * F.col("source_size")).alias("cap")))
    level, full_before = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("w") if full_before >= 0 else F.lit(False)
        r = src.agg(F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"), F.sum(full.cast("int")).alias("full")).first()
        if not r.open or r.full == full_before:  # all are full, or none more than before
            break
        level, full_before = (share * r.words - r.caps) / r.open, r.full
    target = F.least(F.col("cap"), level * F.col("w")) if r.open else F.col("cap")
    return src.select("source", "source_size", "place", target.alias("target"))


def inverse_demand(part: Column, place: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source has had the given part (0..1) of its demand: the inverse of its schedule's integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = sum((t2 - t1) * (a + b) / 2 for (t1, a), (t2, b) in zip(knots, knots[1:]))
        done, time = 0.0, F.lit(float(knots[-1][0]))
        pieces = []
        for (t1, a), (t2, b) in zip(knots, knots[1:]):
            here = (t2 - t1) * (a + b) / 2
            need = F.greatest(part * area - done, F.lit(0.0))
            slope = (b - a) / (t2 - t1)
            root = t1 + need / a if slope == 0 else t1 + (F.sqrt(F.greatest(a * a + 2 * slope * need, F.lit(0.0))) - a) / slope
            pieces.append((done + here, F.least(root, F.lit(float(t2)))))
            done += here
        for upto, root in reversed(pieces):
            time = F.when(part * area <= upto, root).otherwise(time)
        out = F.when(place % len(schedules) == k, time).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 42, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, position, later) for every row of docs.

    A source's stream of words has its documents in seeded order, `most` times over, and the mix takes the stream's
    first words up to the rounded target; taken counts a document's words in it, and copies the passes that reach it.
    position and later are the training times of its first word in the first two passes (null where not taken).
    Null texts have size 0 and a null source is a source of its own, the last one. Rows with the same id are ordered by
    size and may share a position; rows alike in id, source and size are counted first and take their places one after the
    other, so that copies of one row, or rows without an id, are no bucket's burden. Running sums go by bucket of a
    source, then over buckets, so a source with most of the rows is spread over as many tasks as it has buckets.
    """
    bounded_batches(docs.sparkSession)
    sizes = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")
    src = targets(sizes, weights, share, float(most))
    rows = sizes.count()
    buckets = max(64, 1 << (max(rows, 1) // BUCKET_ROWS).bit_length())
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    dealt = alike.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    plan = sums.alias("b").join(src.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.bucket", "b.base", "s.source_size", "s.target", "s.place")
    run = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(run), F.lit(0)))
    j = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    j = j.select("d.doc_id", "d.source", "d.size", "d.n", "p.source_size", "p.target", "p.place", (F.col("p.base") + F.col("d.inside")).alias("at"))
    # one row again for each of those alike; many are dealt to tasks in runs first
    j = j.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN_ROWS))))
    if alike.where(F.col("n") > RUN_ROWS).limit(1).count():
        j = j.repartition("doc_id", "size", "run")
    turn = F.explode(F.sequence(F.col("run") * RUN_ROWS, F.least(F.col("n"), (F.col("run") + 1) * RUN_ROWS) - 1))
    j = j.withColumn("turn", turn).withColumn("at", F.col("at") + F.col("turn") * F.col("size"))
    goal = F.bround("target").cast("long")
    taken, copies, times = F.lit(0), F.lit(0), []
    for k in range(most):
        start = F.col("at") + k * F.col("source_size")
        got = F.least(F.greatest(goal - start, F.lit(0)), F.col("size"))
        taken, copies = taken + got, copies + (got > 0).cast("int")
        times.append(F.when(got > 0, inverse_demand(start / goal, F.col("place"), schedules)))
    return j.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.alias("copies"), times[0].alias("position"), (times[1] if most > 1 else F.lit(None).cast("double")).alias("later"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the mix takes, whole, once for each pass that reaches them, range-sorted by training position.

    Documents cut by the target's end are kept whole; those without words aren't taken. Ids should be unique: rows
    that share an id each appear as often as the mix takes any of them.
    """
    ident, position = unused(docs.columns, "mixed_id"), unused(docs.columns, "mixed_position")
    mixed = mix(docs, id_col, **options).groupBy(F.col("doc_id").alias(ident)).agg(F.min("position").alias("first"), F.min("later").alias("later"))
    passes = mixed.select(ident, F.explode(F.array_compact(F.array("first", "later"))).alias(position))
    out = docs.join(passes, F.col(id_col).eqNullSafe(F.col(ident)))
    return out.repartitionByRange(position, ident).sortWithinPartitions(position, ident).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "later")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
