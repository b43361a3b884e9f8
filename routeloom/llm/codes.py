"""Vector code compression: product codes of integer vectors by codebooks that a few rounds of k-means refine.

Components become integers, vectors are cut into equal parts, and each part gets the index of the nearest entry of its
position's codebook. Distances are int64 throughout: |x|^2 - 2 x.c + |c|^2, the middle term one integer matrix product
for each part and Arrow batch; the first least wins. A round adds up each task's parts by entry, merges these sums with
one grouped shuffle of at most parts x entries x width rows a task, and gives the driver the new codebooks, whose size
(length x entries numbers) doesn't depend on the rows. Codebooks go to the tasks by broadcast.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, saved, table, unused

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose distances a worker computes at once.
ROWS = 2048


def finite(vec_col: str):
    """Holds for a vector that isn't null or empty and whose components are all finite."""
    v = F.col(vec_col)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def bound(length: int) -> int:
    """Greatest component for which distances and inner products of such vectors are exact in int64."""
    return isqrt(2**60 // max(length, 1))


def integers(vec_col: str, most: int, scale: int = SCALE):
    """Column of floor(scale * x) as longs; components beyond +-most count as +-most."""
    return F.transform(vec_col, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows x parts each, of integer vectors by codebooks (parts x entries x width).
    Vectors shorter than parts x width are filled up with zeros. The first of equally near entries counts."""
    parts, entries, width = books.shape
    n = len(x)
    if x.shape[1] < parts * width:
        x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    pieces = np.ascontiguousarray(x.reshape(n, parts, width).transpose(1, 0, 2))
    codes, least = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        c = books[p]
        d = (c * c).sum(1) - 2 * (pieces[p] @ c.T)
        codes[:, p] = d.argmin(1)
        least[:, p] = d[np.arange(n), codes[:, p]] + (pieces[p] * pieces[p]).sum(1)
    return codes, least


def _first_books(v: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, ascending; null ids last, vectors with the same id in their order."""
    rows = [r.v for r in v.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    x = np.array(rows, np.int64)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width).transpose(1, 0, 2).copy()


def _refined(v: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of the mean of the parts nearest to them; entries without any stay."""
    parts, entries, width = books.shape
    sent = v.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        now = sent.value
        total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = matrix(b.column(0).slice(at, ROWS))
                codes, _ = nearest(x, now)
                x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(p, width).astype(np.int32), "entry": np.repeat(e, width).astype(np.int32), "place": np.tile(np.arange(width), len(p)).astype(np.int32),
                "total": total[p, e].ravel(), "n": np.repeat(count[p, e], width)})

    each = v.select("v").mapInArrow(sums, "part int, entry int, place int, total long, n long")
    merged = each.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in merged.collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    sent.unpersist()
    return out


def fit_codebooks(v: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) over all rows of v (id, v: integers of that length), after so many rounds."""
    books = _first_books(v, parts, entries, -(-length // parts))
    for _ in range(rounds):
        books = _refined(v, books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(v: DataFrame, books: np.ndarray, kept: list[str]) -> DataFrame:
    """The columns `kept` of v, code (hex of each part's index, two digits, or four with more than 256 entries) and error."""
    sent = v.sparkSession.sparkContext.broadcast(books)
    kind = ">u2" if books.shape[1] > 256 else ">u1"
    fields = dict(v.dtypes)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                codes, least = nearest(matrix(part.column(0)), sent.value)
                codes = [r.tobytes().hex() for r in codes.astype(kind)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(codes), pa.array(least.sum(1))], [*kept, "code", "error"])

    return v.select("v", *kept).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", code string, error long")


def decode(codes: DataFrame, books: np.ndarray, length: int, code_col: str = "code") -> DataFrame:
    """codes with a column `decoded`: the integer vector (array<long>) that each code stands for; null for a null code."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    kind = ">u2" if books.shape[1] > 256 else ">u1"

    @F.pandas_udf("array<long>")
    def vectors(col):
        at = np.arange(sent.value.shape[0])
        return col.map(lambda c: sent.value[at, np.frombuffer(bytes.fromhex(c), kind)].ravel()[:length] if c is not None else None)

    return codes.withColumn(unused(codes.columns, "decoded"), vectors(F.col(code_col)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), codebooks) of all vectors.

    Vectors that are null, empty or hold null or non-finite components are left out, and so are those of another length
    than the commonest (of equally common lengths, the least). A length that `parts` doesn't divide is filled up with
    zeros. Components whose square could leave int64 (beyond bound(length)) count as that bound. Fewer rows than
    `entries` give that many entries. Rows with null, equal or repeated ids each keep their row; null ids are the last to
    become entries. An empty table gives an empty table and codebooks of no entries. Other columns aren't read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    fine = vectors.where(finite(vec_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    common = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = common.d if common else parts
    v = fine.where(F.size("v") == d).withColumn("v", integers("v", bound(d)))
    v = saved(v, "integers") if common else v  # read once a round
    if common is None:
        return encode(v, np.zeros((parts, 1, 1), np.int64), ["id", "label"]), np.zeros((parts, 0, 1), np.int64)
    books = fit_codebooks(v, d, parts, entries, rounds)
    return encode(v, books, ["id", "label"]), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = saved(coded, "codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds unrolled: a{r} holds the nearest entry of each part in round r, b{r} the codebooks."""
    w = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      x AS (SELECT vec_id, p, v[1 + p * (len(v) // {PARTS}) : (p + 1) * (len(v) // {PARTS})] AS s FROM k, range({PARTS}) t(p)),
      f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {ENTRIES}),
      b0 AS (SELECT p, e, s AS c FROM x JOIN f USING (vec_id))"""
    for r in range(ROUNDS + 1):
        w += f""",
      a{r} AS (SELECT vec_id, x.p, s, min(struct_pack(d := list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m FROM x JOIN b{r} ON x.p = b{r}.p GROUP BY ALL)"""
        if r < ROUNDS:
            w += f""",
      u{r} AS (SELECT p, e, j, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT p, m.e AS e, unnest(s) AS y, unnest(range(len(s))) AS j FROM a{r}) GROUP BY ALL),
      b{r + 1} AS (SELECT b.p, b.e, coalesce(g.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list(y ORDER BY j) AS c FROM u{r} GROUP BY ALL) g ON b.p = g.p AND b.e = g.e)"""
    return w + f""",
      q AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
      SELECT q.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
      FROM q JOIN k USING (vec_id)"""


ORACLE = _sql()
