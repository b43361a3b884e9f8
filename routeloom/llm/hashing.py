"""Approximate nearest neighbours by inner product with multi-index hashing.

Vectors get one more coordinate so that all have the same length (then the order by inner product is that by angle),
are centred and turned by learned rotations, and their signs are 64-bit codes. Codes are cut into four substrings and
each substring has an index over the whole table: its rows are dealt to cells by the substring's leading bits, and a
large cell is split further by hash. A query with radius r goes, in each of the four indexes, only to the cells whose
leading bits differ from its own in at most r // 4 bits, and probes there the values within r // 4 bits of its own; by
the pigeonhole principle that retrieves every code within r bits. A code that several substrings retrieve counts in
the first. These are then ranked by the exact inner product of the original vectors. Queries that find fewer than k
rows are asked again with twice the radius.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, saved, table

BITS, SUBSTRINGS = 64, 4
#: Vectors that the rotation and the radius are learned from, at most (those with the least hash of their id).
SAMPLE = 8192
#: Vectors in a cell, about, and bytes of them at most.
SHARD_ROWS, SHARD_BYTES = 16384, 64 << 20
#: Share of the sample's true neighbours that lie within the learned radius.
COVERED = 0.97


def _orthogonal(rng, d):
    return np.linalg.qr(rng.standard_normal((d, d)))[0]


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """d x bits projection: iterative quantisation (rotate principal axes towards the signs), as often as bits need."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)]
    out = []
    while sum(o.shape[1] for o in out) < bits:
        k = min(d, bits - sum(o.shape[1] for o in out))
        p = axes[:, :k]
        v, r = x @ p, _orthogonal(rng, k)
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(p @ r)
    return np.concatenate(out, axis=1)


class Coder:
    """Mean, greatest length and projection that turn vectors into codes."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        a = self.extend(sample)
        self.mean = a.mean(0)
        self.projection = learn_rotation(a - self.mean)

    def extend(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]], axis=1)

    def _codes(self, a: np.ndarray) -> np.ndarray:
        bits = ((a - self.mean) @ self.projection >= 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self._codes(self.extend(x))

    def query_codes(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.longest / np.maximum(np.sqrt((q * q).sum(1)), 1e-300))[:, None]
        return self._codes(np.concatenate([scaled, np.zeros((len(q), 1))], axis=1))

    def radius(self, sample: np.ndarray, k: int, covered: float = COVERED, queries: int = 256) -> int:
        """Bits within which the given share of the sample's own k nearest lie, over some of its vectors as queries."""
        q = sample[:queries]
        s = q @ sample.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return BITS
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        distance = np.bitwise_count(self.query_codes(q)[:, None] ^ self.codes(sample)[near])
        return int(np.quantile(distance, covered, method="higher"))


_FLIPS = np.arange(1 << 16, dtype=np.uint16)[np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable")]
_UPTO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))))


class Cell:
    """Rows of a cell of one substring's index, ordered by the substring's value."""

    def __init__(self, substring: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        values = codes.view(np.uint16).reshape(-1, SUBSTRINGS)[:, substring]
        order = np.lexsort((ids, values))
        self.substring, self.ids, self.x, self.codes = substring, ids[order], x[order], codes[order]
        self.values, starts = np.unique(values[order], return_index=True)
        self.starts = np.append(starts, len(order))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ in at most `radius` bits, and whose first substring within radius // 4 bits is this one."""
        part = np.array([code], np.uint64).view(np.uint16)[self.substring]
        each = min(radius // SUBSTRINGS, 16)
        if _UPTO[each] < len(self.values):
            probes = part ^ _FLIPS[: _UPTO[each]]
            at = np.minimum(np.searchsorted(self.values, probes), len(self.values) - 1)
            at = np.sort(at[self.values[at] == probes])
        else:  # fewer values than probes: look at the values themselves
            at = np.flatnonzero(np.bitwise_count(self.values ^ part) <= each)
        sizes = self.starts[at + 1] - self.starts[at]
        rows = np.arange(int(sizes.sum())) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        apart = self.codes[rows] ^ code
        keep = np.bitwise_count(apart) <= radius
        rows, apart = rows[keep], apart[keep]
        if self.substring and len(rows):
            parts = np.bitwise_count(apart.view(np.uint16).reshape(-1, SUBSTRINGS)[:, : self.substring])
            rows = rows[(parts > each).all(axis=1)]
        return rows

    def nearest(self, qid: int, q: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows within the radius, or all if fewer; the query's own id is left out."""
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != qid]
        score = np.einsum("ij,j->i", self.x[rows], q)
        if len(rows) > k:
            keep = score >= np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def usable(vec_col: str):
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _doubles(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


class Cells:
    """Numbers of the cells of the four indexes: by substring, leading bits and, in large cells, the id's hash."""

    def __init__(self, bits: int, counts: np.ndarray, rows: int):
        self.bits = bits
        self.split = np.where(counts > 0, np.maximum(1, -(-counts // (2 * rows))), 0)  # 0: an empty cell, no query goes there
        self.first = np.cumsum(self.split) - self.split
        self.total = int(self.split.sum())
        self.substring = np.repeat(np.repeat(np.arange(SUBSTRINGS), 1 << bits), self.split)

    def leading(self, codes: np.ndarray) -> np.ndarray:
        """(rows x 4) cell of each substring before splitting."""
        parts = codes.view(np.uint16).reshape(-1, SUBSTRINGS).astype(np.int64)
        return (parts >> (16 - self.bits)) + (np.arange(SUBSTRINGS) << self.bits)

    def of_rows(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        cell = self.leading(codes)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[cell] + mixed[:, None] % self.split[cell]

    def of_queries(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs: the cells that can hold values within radius // 4 bits."""
        flips = np.flatnonzero(np.bitwise_count(np.arange(1 << self.bits)) <= radius // SUBSTRINGS)
        cell = self.leading(codes)[:, :, None] ^ flips
        query = np.broadcast_to(np.arange(len(codes))[:, None, None], cell.shape).ravel()
        cell = cell.ravel()
        times = self.split[cell]
        ends = np.cumsum(times)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times, times)
        return np.repeat(query, times), np.repeat(self.first[cell], times) + inside


def _cell_counts(v: DataFrame, coder: Coder, bits: int, d: int) -> np.ndarray:
    """Rows of each cell before splitting; at most 4 x 2^bits sums."""
    plain = Cells(bits, np.ones(SUBSTRINGS << bits, np.int64), 1)

    def count(batches):
        total = np.zeros(SUBSTRINGS << bits, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(plain.leading(coder.codes(_doubles(b.column(0), d))).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": some.astype(np.int32), "n": total[some]})

    out = np.zeros(SUBSTRINGS << bits, np.int64)
    for r in v.select("v").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def _pass(v: DataFrame, queries: DataFrame, coder: Coder, cells: Cells, d: int, radius: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows within the radius of each query, those of queries without any left out."""
    spark = v.sparkSession
    kind = dict(v.dtypes)["v"]
    routed = f"cell int, query boolean, id long, code long, v {kind}"

    def route(is_query):
        def run(batches):
            for b in batches:
                x, ids = _doubles(b.column(1), d), b.column(0).to_numpy()
                if is_query:
                    codes = coder.query_codes(x)
                    row, cell = cells.of_queries(codes, radius)
                else:
                    codes = coder.codes(x)
                    row, cell = np.repeat(np.arange(len(ids)), SUBSTRINGS), cells.of_rows(ids, codes).ravel()
                for at in range(0, len(row), 4096):
                    some = row[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at : at + 4096].astype(np.int32)), pa.array(np.full(len(some), is_query)), pa.array(ids[some]), pa.array(codes[some].view(np.int64)), b.column(1).take(pa.array(some))],
                        ["cell", "query", "id", "code", "v"])

        return run

    both = v.mapInArrow(route(False), routed).union(queries.mapInArrow(route(True), routed))
    dealt = both.repartition(max(1, cells.total), "cell").sortWithinPartitions("cell", "query", "id")

    def run(batches):
        current, parts, cell = None, [], None
        for b in batches:
            m = b.num_rows
            number, query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            ids, codes, x = b.column(2).to_numpy(), b.column(3).to_numpy().view(np.uint64), _doubles(b.column(4), d)
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), m]
            for a, e in zip(cuts, cuts[1:]):
                if a == e:
                    continue
                if number[a] != current:
                    current, parts, cell = number[a], [], None
                if not query[a]:
                    parts.append((ids[a:e], x[a:e], codes[a:e]))
                    continue
                if not parts:
                    continue
                if cell is None:
                    cell = Cell(int(cells.substring[current]), *(np.concatenate(p) for p in zip(*parts)))
                out = [cell.nearest(i, q, c, radius, k) for i, q, c in zip(ids[a:e], x[a:e], codes[a:e])]
                sizes = [len(o[0]) for o in out]
                if sum(sizes):
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids[a:e], sizes), "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out])})

    def best(batches):
        """Streams the rows found, sorted by query and best first, and numbers the first k of each query; repeated ones count once."""
        before, rank = None, 0
        for b in batches:
            q, i, s = (b.column(c).to_numpy() for c in range(3))
            if not len(q):
                continue
            again = np.append(before == (q[0], i[0], s[0]), (q[1:] == q[:-1]) & (i[1:] == i[:-1]) & (s[1:] == s[:-1]))
            same = before is not None and before[0] == q[0]
            before = (q[-1], i[-1], s[-1])
            q, i, s = q[~again], i[~again], s[~again]
            if not len(q):
                continue
            new = np.append(not same, q[1:] != q[:-1])
            at = np.arange(len(q))
            r = at - np.maximum.accumulate(np.where(new, at, 0))
            if same:
                r[: int(np.argmax(new)) if new.any() else len(q)] += rank
            rank = int(r[-1]) + 1
            keep = r < k
            yield pa.RecordBatch.from_pydict({"query_id": q[keep], "rank": (r[keep] + 1).astype(np.int32), "vec_id": i[keep], "score": s[keep]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double").repartition(parts, "query_id").sortWithinPartitions("query_id", F.desc("score"), "vec_id")
    return found.mapInArrow(best, "query_id long, rank int, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row for which is_query holds, the k best of all other rows found.

    Vectors that are null, zero or hold null or non-finite values take no part, nor do rows without an id or with a
    length other than the commonest. Score is the inner product in double precision; ties go to the smaller id. A row
    with the query's id is never its neighbour; repeated rows count once. With at most k candidates all are returned.
    A task holds one cell, of about `shard_rows` rows and at most twice that, while its queries stream past.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = vectors.where(usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null")
    stats = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest"))
    common = stats.orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, longest = common.d, common.n, common.longest
    v = v.where(F.size("v") == d)
    drawn = np.array([r.v for r in v.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.float64)
    coder = Coder(drawn, longest)
    radius = coder.radius(drawn, max(1, round(k * len(drawn) / n)))  # as near as the table's k are the sample's share of them
    rows = max(1, min(shard_rows, SHARD_BYTES // (8 * d)))
    # cells of that size, and enough of them for the cores if that leaves each an eighth of it at least
    bits = min(16, max(0, int(np.ceil(np.log2(n / rows))), min(int(np.log2(max(1, 8 * n / rows))), int(np.ceil(np.log2(max(1, spark.sparkContext.defaultParallelism / SUBSTRINGS)))))))
    cells = Cells(bits, _cell_counts(v, coder, bits, d), rows)
    left, out = v.where(is_query(F.col("id"))), None
    while True:
        got = saved(_pass(v, left, coder, cells, d, radius, k), "neighbours")
        if radius >= BITS:
            return got if out is None else out.union(got)
        full = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= min(k, n - 1)).select("query_id")
        short = saved(left.join(full, F.col("id") == F.col("query_id"), "left_anti"), "queries")
        if short.limit(1).count() == 0:
            return got if out is None else out.union(got)
        done = got.join(full, "query_id", "left_semi")
        out = done if out is None else out.union(done)
        left, radius = short, min(BITS, max(2 * radius, SUBSTRINGS))


def op8_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
