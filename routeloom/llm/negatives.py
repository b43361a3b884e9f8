"""Hard-negative mining by exact search in inverted lists.

K-means over a bounded sample gives centroids; every row joins the list of its nearest one, and each list's radius, the
greatest distance of its rows from the centroid, is stored. For an anchor q, a list with centroid c and radius r holds
only scores between q.c - |q| r and q.c + |q| r (Cauchy-Schwarz). Lists are dealt to shards of about equal numbers of
rows, large lists to several by hash. An anchor goes to the shards that hold a list it may need; there it visits the lists
by descending upper bound, skips those whose bounds lie outside its windows of scores, and stops at the first whose upper
bound falls strictly below its kth score. Kth scores start with those among the sample, whose rows are rows of the table.

A first search finds each anchor's positives (same label), whose scores set the windows of the second, over the other
labels. Components are integers and centroids too, so that scores and bounds are exact; both searches are, whatever the
sample, which decides only how much is skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm.codes import bound, finite, integers, matrix
from routeloom.llm.common import bounded_batches, saved, table

#: Rows that centroids and first kth scores come from, at most (those with the least hash of their id), and their bytes.
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
#: Lists, at most, rows of a list that fewer lists have on average, and rows of a shard, about.
LISTS, LIST_ROWS, SHARD_ROWS = 512, 512, 16384
#: Scores that a worker holds at once.
SCORES = 1 << 20
#: Below and above every score (these are within 2^60), and above every id.
LOW, HIGH, NO_ID = -(1 << 62), 1 << 62, np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where these are exact, else in int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """At most k distinct integer centroids (rounded means) of a bounded sample's rows."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(np.floor(c + 0.5).astype(np.int64), axis=0)


class Lists:
    """Centroids, radii (as exact squares) and shards of the inverted lists."""

    def __init__(self, centroids: np.ndarray, squares: np.ndarray, counts: np.ndarray, rows: int):
        self.centroids, self.squares, self.counts = centroids, squares, counts
        split = np.maximum(1, -(-counts // (2 * rows)))
        first, shard, room = np.zeros(len(counts), np.int64), 0, 0
        for i in np.lexsort((np.arange(len(counts)), products(centroids, centroids[:1])[:, 0])):  # lists near each other go together
            if room + counts[i] > rows and room:
                shard, room = shard + 1, 0
            first[i] = shard
            room += counts[i]
            if split[i] > 1:
                shard, room = shard + split[i], 0
        self.first, self.split, self.total = first, split, int(shard + 1)

    def of_rows(self, lists: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[lists] + mixed % self.split[lists]


def bounds(q: np.ndarray, centroids: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a row of each list can have with each q; reach is rounded up."""
    middle = products(q, centroids)
    reach = np.sqrt((q * q).sum(1).astype(np.float64))[:, None] * np.sqrt(squares.astype(np.float64))
    reach = np.ceil(reach * (1 + 1e-12)).astype(np.int64) + 1
    return middle - reach, middle + reach


class Best:
    """The k best rows so far of each window of each anchor: score descending, id ascending."""

    def __init__(self, n: int, windows: int, k: int):
        self.score = np.full((n, windows, k), LOW)
        self.id = np.full((n, windows, k), NO_ID)

    def kth(self) -> np.ndarray:
        return self.score[:, :, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Rows of one list, ascending by id: scores (anchors x rows) that are allowed and lie in a window [lo, hi]."""
        k = self.score.shape[2]
        for w in range(lo.shape[1]):
            kth = self.score[at, w, -1]
            fits = allowed & (scores >= np.maximum(lo[:, w], kth)[:, None]) & (scores <= hi[:, w][:, None])
            some = np.flatnonzero(fits.any(1))
            if not len(some):
                continue
            left = np.where(fits[some], scores[some], LOW)
            got_s, got_i = np.full((len(some), k), LOW), np.full((len(some), k), NO_ID)
            for r in range(min(k, left.shape[1])):
                best = left.argmax(1)  # the first of equal scores has the least id
                value = left[np.arange(len(some)), best]
                got_s[:, r], got_i[:, r] = value, np.where(value > LOW, ids[best], NO_ID)
                left[np.arange(len(some)), best] = LOW
            s = np.concatenate([self.score[at[some], w], got_s], axis=1)
            i = np.concatenate([self.id[at[some], w], got_i], axis=1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            self.score[at[some], w] = np.take_along_axis(s, order, 1)
            self.id[at[some], w] = np.take_along_axis(i, order, 1)


class Shard:
    """Rows of a shard, by list and id, with the radius that each list has here."""

    def __init__(self, lists: Lists, of: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, of))
        of, self.ids, self.labels, self.x = of[order], ids[order], labels[order], x[order]
        self.lists, starts = np.unique(of, return_index=True)
        self.edges = np.append(starts, len(of))
        self.centroids = lists.centroids[self.lists]
        apart = self.x - self.centroids[np.repeat(np.arange(len(self.lists)), np.diff(self.edges))]
        self.squares = np.maximum.reduceat((apart * apart).sum(1), starts)

    def visit(self, q: np.ndarray, qid: np.ndarray, qlabel: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray, k: int, same: bool) -> Best:
        """The k best rows of each anchor's windows, of those that score at least `kth`, a row of the table's kth score."""
        best = Best(len(q), lo.shape[1], k)
        low, high = bounds(q, self.centroids, self.squares)
        place = np.argsort(-high, axis=1, kind="stable")
        open_ = np.ones(len(q), bool)
        for turn in range(len(self.lists)):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            mine = place[at, turn]
            top = high[at, mine]
            now = np.maximum(np.maximum(kth[at], best.kth()[at]), lo[at])
            open_[at] = (top[:, None] >= now).any(1)  # all later lists have lower bounds still
            inside = ((top[:, None] >= now) & (low[at, mine][:, None] <= hi[at])).any(1)
            at, mine = at[inside], mine[inside]
            for g in np.unique(mine):
                who = at[mine == g]
                for a in range(self.edges[g], self.edges[g + 1], 4096):
                    rows = slice(a, min(a + 4096, self.edges[g + 1]))
                    step = max(1, SCORES // (rows.stop - rows.start))
                    for b in range(0, len(who), step):
                        w = who[b : b + step]
                        allowed = (self.labels[rows][None, :] == qlabel[w][:, None]) == same
                        allowed &= self.ids[rows][None, :] != qid[w][:, None]
                        best.add(w, products(q[w], self.x[rows]), self.ids[rows], allowed, np.maximum(lo[w], kth[w]), hi[w])
        return best


def _fit(v: DataFrame, length: int, n: int, sample: int, lists: int, list_rows: int, shard_rows: int):
    """Sample, its centroids, v with a column `list`, and the Lists; one aggregation over all rows gives counts and radii."""
    drawn = v.orderBy(F.xxhash64("id"), "id", "label", "v").limit(min(sample, max(256, SAMPLE_BYTES // (8 * length)))).collect()
    ids, labels, x = np.array([r.id for r in drawn], np.int64), np.array([r.label for r in drawn], np.int64), np.array([r.v for r in drawn], np.int64)
    c = kmeans(x, max(1, min(lists, -(-n // list_rows), len(x))))
    sent = v.sparkSession.sparkContext.broadcast(c)

    def assign(batches):
        c = sent.value
        half = (c * c).sum(1)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = matrix(part.column(2))
                of = (half - 2 * products(x, c)).argmin(1)
                apart = x - c[of]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of.astype(np.int32)), pa.array((apart * apart).sum(1))], ["id", "label", "v", "list", "square"])

    v = saved(v.select("id", "label", "v").mapInArrow(assign, "id long, label long, v array<long>, list int, square long"), "lists")
    squares, counts = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for r in v.groupBy("list").agg(F.max("square").alias("square"), F.count(F.lit(1)).alias("n")).collect():
        squares[r.list], counts[r.list] = r.square, r.n
    return (ids, labels, x), v, Lists(c, squares, counts, shard_rows)


def _search(v: DataFrame, anchors: DataFrame, lists, drawn, k: int, windows: int, same: bool) -> DataFrame:
    """(anchor, window, score, id): the k best rows of v for each window of each anchor (id, label, v, lo, hi)."""
    spark = v.sparkSession
    sent = spark.sparkContext.broadcast((lists, drawn))
    fields = "shard int, query boolean, id long, label long, v array<long>, list int, lo array<long>, hi array<long>, kth array<long>"
    names = [f.split()[0] for f in fields.split(", ")]

    def rows(batches):
        lists = sent.value[0]
        for b in batches:
            n = b.num_rows
            shard = lists.of_rows(b.column(3).to_numpy(), b.column(0).to_numpy())
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.zeros(n, bool)), *b.columns, none, none, none], names)

    def route(batches):
        lists, (ids, labels, x) = sent.value
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                qid, qlabel, q, lo, hi = part.column(0).to_numpy(), part.column(1).to_numpy(), *(matrix(part.column(i)) for i in (2, 3, 4))
                best = Best(len(q), lo.shape[1], k)
                best.add(np.arange(len(q)), products(q, x), ids, ((labels == qlabel[:, None]) == same) & (ids != qid[:, None]), lo, hi)
                kth = best.kth()
                low, high = bounds(q, lists.centroids, lists.squares)
                need = np.maximum(kth, lo)
                wanted = np.zeros(high.shape, bool)
                for w in range(lo.shape[1]):
                    wanted |= (high >= need[:, w][:, None]) & (low <= hi[:, w][:, None]) & (lo[:, w] <= hi[:, w])[:, None]
                who, of = np.nonzero(wanted & (lists.counts > 0))
                times = lists.split[of]
                inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                pair = np.unique(np.stack([np.repeat(who, times), np.repeat(lists.first[of], times) + inside]), axis=1)
                for s in range(0, pair.shape[1], 4096):
                    who, shard = pair[:, s : s + 4096]
                    take = lambda column: column.take(pa.array(who))
                    flat = pa.ListArray.from_arrays(np.arange(0, len(who) * kth.shape[1] + 1, kth.shape[1], dtype=np.int32), pa.array(kth[who].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.ones(len(who), bool)), *(take(part.column(i)) for i in (0, 1, 2)), pa.nulls(len(who), pa.int32()), take(part.column(3)), take(part.column(4)), flat], names)

    both = v.select("id", "label", "v", "list").mapInArrow(rows, fields).union(anchors.select("id", "label", "v", "lo", "hi").mapInArrow(route, fields))
    dealt = both.repartition(max(1, lists.total), "shard").sortWithinPartitions("shard", "query", "id")

    def run(batches):
        current, parts, shard = None, [], None
        for b in batches:
            number, query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:]):
                if a == e:
                    continue
                part = b.slice(a, e - a)
                if number[a] != current:
                    current, parts, shard = number[a], [], None
                ids, labels, x = part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4))
                if not query[a]:
                    parts.append((part.column(5).to_numpy(), ids, labels, x))
                    continue
                if shard is None and not parts:
                    continue
                if shard is None:
                    shard, parts = Shard(sent.value[0], *(np.concatenate(p) for p in zip(*parts))), []
                for s in range(0, len(ids), 512):
                    some = slice(s, s + 512)
                    best = shard.visit(x[some], ids[some], labels[some], *(matrix(part.column(i).slice(s, 512)) for i in (6, 7, 8)), k, same)
                    who, window, rank = np.nonzero(best.score > LOW)
                    if len(who):
                        yield pa.RecordBatch.from_pydict({"anchor": ids[some][who], "win": window.astype(np.int32), "score": best.score[who, window, rank], "id": best.id[who, window, rank]})

    found = dealt.mapInArrow(run, "anchor long, win int, score long, id long")
    first = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3,
    window: tuple[int, int] = (50, 95), sample: int = SAMPLE, lists: int = LISTS, list_rows: int = LIST_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id satisfies is_anchor. Scores are inner products of floor(256 x). An anchor's positives
    are the best other rows of its label; for each, the best rows of other labels with window[0] * positive_score <= 100 *
    negative_score <= window[1] * positive_score. Ties go to the smaller id; a positive without such rows has no row.

    Rows with a null id, label or vector, an empty vector or null or non-finite components take no part, nor do vectors of
    another length than the commonest (of equally common ones, the least). Components beyond codes.bound(length) count as
    that. Repeated rows count as often as they are there; of several anchors with one id, the one with the least label
    and vector counts, and rows with an anchor's id are never its positives or negatives. Empty tables give no rows; other
    columns aren't read. A task holds one shard, of some shard_rows rows, twice that at most, while its anchors stream past.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).where("id is not null and label is not null").where(finite("v"))
    common = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d = common.d
    v = v.where(F.size("v") == d).withColumn("v", integers("v", bound(d)))
    drawn, v, made = _fit(v, d, common.n, sample, lists, list_rows, min(shard_rows, max(256, (64 << 20) // (8 * d))))
    anchors = v.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.*")
    anchors = saved(anchors, "anchors")
    whole = anchors.select("*", F.array(F.lit(LOW)).alias("lo"), F.array(F.lit(HIGH)).alias("hi"))
    near = saved(_search(v, whole, made, drawn, positives, 1, True), "positives")
    # the least n with 100 n >= least * score, and the greatest with 100 n <= most * score
    lo, hi = F.expr(f"-((-{window[0]} * score - pmod(-{window[0]} * score, 100)) div 100)"), F.expr(f"({window[1]} * score - pmod({window[1]} * score, 100)) div 100")
    ranks = range(1, positives + 1)
    places = near.groupBy("anchor").agg(*(F.max(F.when(F.col("rank") == r, x)).alias(f"{n}{r}") for r in ranks for n, x in (("lo", lo), ("hi", hi))))
    windows = anchors.join(places, F.col("id") == F.col("anchor")).select(
        "id", "label", "v", F.array(*(F.coalesce(f"lo{r}", F.lit(1).cast("long")) for r in ranks)).alias("lo"), F.array(*(F.coalesce(f"hi{r}", F.lit(0).cast("long")) for r in ranks)).alias("hi"))
    far = _search(v, windows, made, drawn, negatives, positives, False)
    found = far.select(F.col("anchor").alias("a"), (F.col("win") + 1).alias("w"), F.col("rank").alias("r"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, (F.col("anchor") == F.col("a")) & (near["rank"] == F.col("w"))).select(
        F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("r").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(e, lambda i: i % 50 == 0)


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
