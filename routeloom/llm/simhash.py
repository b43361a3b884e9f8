"""SimHash near-duplicates by generalised pigeonhole search over 64-bit fingerprints.

Fingerprints link at a Hamming distance of at most `radius`. The 64 bits are grouped into m parts, correlated bits
together. For parts with thresholds t_1..t_m (each -1 or more) with sum(t_i) = radius - m + 1, two fingerprints within
the radius agree on some part i up to t_i bits. Each fingerprint gets its own thresholds, by dynamic programming over
the candidate counts that the bit frequencies of the whole table let expect, and probes all values of part i within
t_i bits. The number of parts is that of least expected cost; every choice finds every pair. A probe and the rows
whose own value it names are compared; two probes needn't be.
"""

from __future__ import annotations

import math
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, saved, shuffles_freed, table, text_or_empty, unused
from routeloom.llm.components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Columns of a wide fingerprint, 64 bits each.
WIDE = ("fp", "fp1", "fp2", "fp3")
#: A probe (a row that is shuffled and sorted) costs as much as so many comparisons in a bucket; a wide one, which also
#: takes disk in proportion to its length, as WIDE_PROBE_COST.
PROBE_COST, WIDE_PROBE_COST = 40.0, 400.0
#: Deviations by which candidates' fingerprints may be further apart than those of just similar texts are on average.
RADIUS_DEVIATIONS, WIDE_DEVIATIONS = 1.5, 1.7
#: Buckets up to this size are compared by shifting, larger ones by breadth-first search.
SMALL = 8
#: Buckets above this size are first divided by the other bits.
LARGE = 4096
#: Buckets of wide fingerprints are compared by shifting up to this size.
PAIRS = 64
#: Groups whose texts are compared exactly are divided into blocks, each of which meets each: into 8 at most of BLOCK_LEAST
#: rows or more, but for those that would have more than BLOCK_ROWS rows or about BLOCK_BYTES of hashes then.
BLOCK_LEAST, BLOCK_ROWS, BLOCK_BYTES = 128, 2048, 16 << 20


def simhash(text: bytes, shingle: int = 3, words: int = 1) -> np.ndarray:
    """Fingerprint of a UTF-8 text, 64 bits in each of `words`: a bit is 1 if it is set in over half of the shingles' hashes.

    The first 64 bits of a hash are XXH64 (seed 42), the others a mixture of these. Words are split at space, tab, LF, VT,
    FF and CR after lower-casing A-Z. Fewer words than `shingle` make one shingle; no words give 0.
    """
    return _majority(shingle_hashes(text, shingle), words)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a UTF-8 text, in order, repeats included; none for a text without words."""
    split = text.translate(_LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    digest = xxhash.xxh64_intdigest
    if len(split) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - shingle].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def _majority(h: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of hashes: the bits set in over half of them."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 65536):
        some = h[at : at + 65536]
        bits = np.stack([some, *(_mixed(some, k) for k in range(1, words))], axis=1).view(np.uint8).reshape(len(some), -1)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash64(text: bytes, shingle: int = 3) -> int:
    return int(simhash(text, shingle)[0])


def fingerprint_column(text_col: str, shingle: int = 3):
    """Column of signed 64-bit fingerprints; null texts count as empty."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t.encode(), shingle) for t in texts], np.uint64).astype(np.int64))

    return fingerprint(F.coalesce(F.col(text_col), F.lit("")))


def set_column(text_col: str, shingle: int):
    """Struct of the WIDE words, signed, of the fingerprint of a text's distinct shingles, and `key`, a digest of that set
    (the XXH64 of its sorted hashes); null texts count as empty."""

    @F.pandas_udf(", ".join(f"{w} long" for w in (*WIDE, "key")))
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        rows = np.zeros((len(texts), len(WIDE) + 1), np.uint64)
        for i, t in enumerate(texts):
            h = np.unique(shingle_hashes(t.encode(), shingle))
            rows[i, :-1], rows[i, -1] = _majority(h, len(WIDE)), xxhash.xxh64_intdigest(h.tobytes())
        return pd.DataFrame(rows.view(np.int64), columns=[*WIDE, "key"])

    return fingerprint(F.coalesce(F.col(text_col), F.lit("")))


# ---------------------------------------------------------------- search plan


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size: each starts at the most correlated pair left and grows by mean correlation."""
    left, groups = set(range(corr.shape[0])), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        order = sorted(left)
        sub = np.triu(corr[np.ix_(order, order)], 1)
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [order[i]] if size == 1 else [order[i], order[j]]
        left -= set(group)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].mean())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def allocate(bits: np.ndarray, groups: list[list[int]], ones: np.ndarray, total: int, radius: int, probe_cost: float = PROBE_COST) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (n x m, from -1) of least expected cost with sum radius - m + 1, and that cost, for each row of bits."""
    n, m = len(bits), len(groups)
    differ = np.where(bits == 1, 1 - ones / total, ones / total)
    costs = np.zeros((m, radius + 2, n))
    for i, group in enumerate(groups):
        at = np.zeros((radius + 1, n))
        at[0] = 1
        for b in group:
            p = differ[:, b]
            at[1:] = at[1:] * (1 - p) + at[:-1] * p
            at[0] *= 1 - p
        within = np.cumsum(at, axis=0) * total
        probes = np.cumsum([comb(len(group), t) for t in range(radius + 1)])
        costs[i, 1:] = probe_cost * probes[:, None] + within
    budget = radius + 1  # of t_i + 1
    best = np.full((m + 1, budget + 1, n), np.inf)
    best[0, 0] = 0
    took = np.zeros((m, budget + 1, n), np.int8)
    for i in range(m):
        for s in range(budget + 1):
            for t in range(min(s, radius + 1) + 1):
                c = best[i, s - t] + costs[i, t]
                better = c < best[i + 1, s]
                best[i + 1, s] = np.where(better, c, best[i + 1, s])
                took[i, s] = np.where(better, t, took[i, s])
    out, s = np.zeros((n, m), np.int64), np.full(n, budget)
    for i in reversed(range(m)):
        out[:, i] = took[i, s, np.arange(n)]
        s = s - out[:, i]
    return out - 1, best[m, budget]


def _statistics(groups: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, ones per bit and joint ones per pair of bits over all distinct fingerprints; 4160 sums, added up by Spark."""

    def sums(batches):
        joint, n = np.zeros((64, 64)), 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
            joint += b.T @ b
            n += len(b)
        yield pa.RecordBatch.from_pydict({"k": np.arange(4097), "v": np.append(joint.ravel(), float(n))})

    rows = groups.select("fp").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(4097)
    for r in rows:
        v[r.k] = r.v
    joint, n = v[:4096].reshape(64, 64), int(v[4096])
    return n, joint.diagonal().copy(), joint


def plan_parts(groups: DataFrame, radius: int, probe_cost: float = PROBE_COST) -> tuple[list[list[int]], np.ndarray, int]:
    """Bit groups for the number of parts (2 to radius + 1) with the least expected cost over 256 drawn fingerprints."""
    n, ones, joint = _statistics(groups)
    if n == 0:
        return [list(range(64))], ones, 0
    p = ones / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    rng = np.random.default_rng(7)
    drawn = (rng.random((256, 64)) < p).astype(np.uint8)
    options = [group_bits(corr, m) for m in range(2, radius + 2)] if radius else [[list(range(64))]]
    return min(options, key=lambda g: allocate(drawn, g, ones, n, radius, probe_cost)[1].mean()), ones, n


def _probe_fn(parts: list[list[int]], ones: np.ndarray, total: int, radius: int, names: list[str], probe_cost: float):
    masks = [np.array([sum(1 << b for b in c) for t in range(radius + 1) for c in combinations(g, t)], np.uint64) for g in parts]
    upto = [np.cumsum([comb(len(g), t) for t in range(radius + 1)]) for g in parts]
    whole = [np.uint64(sum(1 << b for b in g)) for g in parts]

    def probe(batches):
        for batch in batches:
            words = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(names))]
            fps = words[0]
            if not len(fps):
                continue
            t, _ = allocate(_bits(fps), parts, ones, total, radius, probe_cost)
            for i in range(len(parts)):
                own = fps.view(np.uint64) & whole[i]
                for level in range(-1, radius + 1):
                    rows = np.flatnonzero(t[:, i] == level)
                    if not len(rows):
                        continue
                    flips = masks[i][: upto[i][max(level, 0)]]  # level -1: the index row alone
                    step = max(1, 600_000 // max(6, len(names)) // len(flips))
                    for at in range(0, len(rows), step):
                        some = rows[at : at + step]
                        value = (own[some][:, None] ^ flips[None, :]).ravel()
                        yield pa.RecordBatch.from_pydict({
                            "part": np.full(len(value), i, np.int32),
                            "value": value.view(np.int64),
                            "own": np.tile(np.arange(len(flips)) == 0, len(some)),
                            **{n: np.repeat(w[some], len(flips)) for n, w in zip(names, words)},
                        })

    return probe


# ---------------------------------------------------------------- verification in buckets


def _search(words: list[np.ndarray], own: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row numbers) of a bucket's rows, of which at least one in each compared pair is the bucket's own:
    a row found leaves the set of those still to be found, and is compared with what is left itself."""
    left = np.argsort(~own, kind="stable")  # own rows first
    values = [w[left] for w in words]
    ours = int(own.sum())
    a, b = [], []
    while ours and len(left) > 1:
        front = [left[0]]
        left, values, ours = left[1:], [v[1:] for v in values], ours - 1
        while front and len(left):
            x = front.pop()
            scope = len(left) if own[x] else ours
            hit = np.flatnonzero(np.bitwise_count(values[0][:scope] ^ words[0][x]) <= radius)
            if len(words) > 1 and len(hit):
                apart = sum(np.bitwise_count(v[hit] ^ w[x]).astype(np.int64) for v, w in zip(values, words))
                hit = hit[apart <= wide]
            if len(hit):
                found = left[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found.tolist())
                ours -= int(own[found].sum())
                left, values = np.delete(left, hit), [np.delete(v, hit) for v in values]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _search_large(words: list[np.ndarray], own: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """As _search; at a small radius a large bucket is divided by each of radius + 1 bit slices first (plain pigeonhole),
    so that far ones don't meet."""
    if len(own) <= LARGE or 64 // (radius + 1) < 8:
        return _search(words, own, radius, wide)
    edges = np.linspace(0, 64, radius + 2).astype(int)
    a, b = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        key = (words[0] >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for some in np.split(order, cuts):
            if len(some) > 1:
                x, y = _search([w[some] for w in words], own[some], radius, wide)
                a.append(some[x])
                b.append(some[y])
    return np.concatenate(a), np.concatenate(b)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node but the least to the least of its component."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _links(part: np.ndarray, value: np.ndarray, own: np.ndarray, node: np.ndarray, words: list[np.ndarray], radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (part, value); whole buckets only."""
    first = np.append(True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]))
    bucket = np.cumsum(first) - 1
    sizes = np.bincount(bucket)
    a, b = [], []
    rows = np.flatnonzero(((sizes <= SMALL) & (sizes > 1))[bucket])
    k = bucket[rows]
    for d in range(1, min(SMALL, len(rows))):
        x, y = rows[:-d], rows[d:]
        hit = np.flatnonzero(k[d:] == k[:-d])
        x, y = x[hit], y[hit]
        near = np.bitwise_count(words[0][x] ^ words[0][y]) <= radius
        x, y = x[near], y[near]
        if len(words) > 1 and len(x):
            near = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words) <= wide
            x, y = x[near], y[near]
        a.append(node[x])
        b.append(node[y])
    starts = np.flatnonzero(first)
    for g in np.flatnonzero(sizes > SMALL):
        here = slice(int(starts[g]), int(starts[g] + sizes[g]))
        if own[here].any():
            x, y = _search_large([w[here] for w in words], own[here], radius, wide)
            a.append(node[here][x])
            b.append(node[here][y])
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    return _forest(a, b) if len(a) else (a, b)


def _loose_links(part: np.ndarray, value: np.ndarray, own: np.ndarray, node: np.ndarray, words: list[np.ndarray], radius: int, sure: int, wide: int):
    """(a, b, loose) of the sorted rows of whole buckets: links that span the groups of pairs within `sure` bits, 0 loose,
    and links that join these to the groups of pairs within `wide` bits, 1 loose. There are fewer than nodes."""
    first = np.append(True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]))
    bucket = np.cumsum(first) - 1
    sizes = np.bincount(bucket)
    near, far = [], []
    rows = np.flatnonzero(((sizes <= PAIRS) & (sizes > 1))[bucket])
    k = bucket[rows]
    for d in range(1, min(PAIRS, len(rows))):
        hit = np.flatnonzero(k[d:] == k[:-d])
        if not len(hit):
            break
        x, y = rows[:-d][hit], rows[d:][hit]
        met = (own[x] | own[y]) & (np.bitwise_count(words[0][x] ^ words[0][y]) <= radius)
        x, y = x[met], y[met]
        apart = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words)
        near.append((node[x[apart <= sure]], node[y[apart <= sure]]))
        far.append((node[x[apart <= wide]], node[y[apart <= wide]]))
    starts = np.flatnonzero(first)
    for g in np.flatnonzero(sizes > PAIRS):
        here = slice(int(starts[g]), int(starts[g] + sizes[g]))
        if own[here].any():
            for most, out in ((sure, near), (wide, far)):
                x, y = _search([w[here] for w in words], own[here], radius, most)
                out.append((node[here][x], node[here][y]))
    none = np.zeros(0, np.int64)
    near, far = ([np.concatenate(c) for c in zip(*some)] if some else [none, none] for some in (near, far))
    low, root = _forest(*near) if len(near[0]) else (none, none)
    a, b = (_renamed(c, low, root) for c in far)
    x, y = _forest(a[a != b], b[a != b]) if (a != b).any() else (none, none)
    return np.append(root, y), np.append(low, x), np.append(np.zeros(len(low), np.int64), np.ones(len(x), np.int64))


def _renamed(labels: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The labels, those in `old` (sorted) replaced by their counterparts in `new`."""
    if not len(old):
        return labels
    at = np.minimum(np.searchsorted(old, labels), len(old) - 1)
    return np.where(old[at] == labels, new[at], labels)


def _verify_fn(radius: int, wide: int = 0, sure: int | None = None):
    """Streams rows (part, value, own, node, fingerprint words) sorted by bucket."""

    def verify(batches):
        kept, size, mark = [], 0, 0

        def columns(group):
            return [np.concatenate(c) for c in zip(*group)]

        def out(cols):
            if sure is not None:
                found = _loose_links(*cols[:4], cols[4:], radius, sure, wide)
                return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "apart"])
            a, b = _links(*cols[:4], cols[4:], radius, wide)
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            least = 1_800_000 // max(9, len(got))  # rows that are compared at once, about; fewer with many words
            mark = mark or least
            kept.append(got[:4] + [w.view(np.uint64) for w in got[4:]])
            size += batch.num_rows
            if size < mark:
                continue
            cols = columns(kept)
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield out([c[:cut] for c in cols])
            kept, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
            mark = max(least, 2 * size)  # a bucket that goes on is put together at each doubling, not at each batch
        if size:
            yield out(columns(kept))

    return verify


def hamming_links(distinct: DataFrame, radius: int = 3, partitions: int | None = None, rest: tuple = (), wide: int = 0, sure: int | None = None) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of distinct fingerprints (column fp) within the radius.

    With further fingerprint words (columns `rest`), pairs must also be within `wide` bits over all words, and links are
    between values of the column `key` instead of between values of fp. With `sure`, links have a third column, `apart`:
    those with 0 span the components of the pairs within `sure` bits over all words, and with those with 1 besides all
    components. Either way a task gives fewer links than rows of its buckets, however large a group is.
    """
    spark = distinct.sparkSession
    cost = WIDE_PROBE_COST if rest else PROBE_COST
    parts, ones, total = plan_parts(distinct, radius, cost)
    if total < 2:
        return spark.createDataFrame([], "a long, b long" + ", apart long" * (sure is not None))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["fp", *rest, *["key"] * bool(rest)]
    schema = "part int, value long, own boolean, " + ", ".join(f"{c} long" for c in names)
    probes = distinct.select(*names).mapInArrow(_probe_fn(parts, ones, total, radius, names, cost), schema)
    buckets = probes.repartition(n, "part", "value").sortWithinPartitions("part", "value")
    bucket_rows = buckets.select("part", "value", "own", F.col("key" if rest else "fp").alias("node"), "fp", *rest)
    return bucket_rows.mapInArrow(_verify_fn(radius, wide, sure), "a long, b long" + ", apart long" * (sure is not None))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the least id of all rows whose fingerprint is reachable by links of at most `radius` differing
    bits. Null or empty texts have fingerprint 0 and link like any other. Equal fingerprints meet once, as one row of
    the search. Rows with equal or null ids each keep their row; a null id is never a component's least unless all are
    null. Empty tables give empty tables; other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fps = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(text_col, shingle).alias("fp")), "fingerprints")
    groups = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = connected_components(hamming_links(groups, radius))
    rooted = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def bits_apart(similarity: float, bits: int, deviations: float = 0.0) -> int:
    """Bits in which fingerprints of texts with that Jaccard similarity differ on average, and so many deviations more.

    Sets of similarity s are vectors whose cosine is 2s / (1 + s), and each bit differs with the probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _similar(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the labels of sets with at least that Jaccard similarity. Sets of one side meet those of the other, or
    each other if there is one side. Intersections are products of 0/1 matrices, whose columns are what two sets share."""
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    column = np.bincount(at, minlength=len(values)) > 1
    keep = column[at]
    row, col = np.repeat(np.arange(len(sets)), sizes)[keep], (np.cumsum(column) - 1)[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    left, right = (left, right) if len(left) and len(right) else (np.arange(len(sets)),) * 2
    both, step = np.zeros((len(left), len(right))), max(64, (1 << 22) // len(sets))
    for lo in range(0, int(column.sum()), step):
        some = slice(*np.searchsorted(col, (lo, lo + step)))
        held = np.zeros((len(sets), min(step, int(col[-1]) + 1 - lo)), np.float32)
        held[row[some], col[some] - lo] = 1
        both += held[left] @ held[right].T
    out = [(label[:0], label[:0])]
    for lo in range(0, len(left), 256):
        some, shared = left[lo : lo + 256], both[lo : lo + 256]
        like = shared >= similarity * (sizes[some][:, None] + sizes[right][None, :] - shared) - 1e-9
        x, y = np.nonzero(like & (label[some][:, None] != label[right][None, :]))
        if len(x):
            out.append(_forest(label[some][x], label[right][y]))
            label = _renamed(label, *out[-1])
    a, b = (np.concatenate(c) for c in zip(*out))
    return b, a


def _similar_fn(similarity: float):
    """Streams rows (loose, i, j, side, root, hashes) sorted by loose, i, j: links between the roots of similar sets."""

    def run(batches):
        held, found, many = [], [], 0

        def joined():
            got = pa.Table.from_batches(held)
            side, label = got.column(3).to_numpy(), got.column(4).to_numpy()
            if (label == label[0]).all() or (last[1] != last[2] and (side == side[0]).all()):  # joined, or blocks without rows
                return label[:0], label[:0]
            return _similar([np.frombuffer(x.as_buffer(), np.uint64) for x in got.column(5)], side, label, similarity)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and (ids[lo] != last).any():
                    found.append(joined())
                    held, many = [], many + len(found[-1][0])
                    if many >= 65536:
                        yield out()
                        found, many = [], 0
                held.append(batch.slice(lo, hi - lo))
                last = ids[lo]
        if held:
            found.append(joined())
            yield out()

    return run


def _verified(links: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (a, b) that span the same components as the sure ones of `links` (0 apart) and all pairs of similar sets within
    the groups that all of `links` join. sets_of gives the sets (key, hashes: sorted 64-bit hashes) of the keys it is given.

    A group's sets are dealt to blocks by hash, and each pair of blocks is compared exactly in one place, which gives fewer
    links than it has rows. Groups that the sure links join already are left out.
    """
    roots = connected_components(links.where("apart = 0").select("a", "b"))
    known = roots.where("root < node").select(F.col("root").alias("a"), F.col("node").alias("b"))
    loose = connected_components(links.select("a", "b")).withColumnRenamed("root", "loose")
    rooted = saved(loose.join(roots, "node", "left").select(F.col("node").alias("key"), "loose", F.coalesce("root", "node").alias("root")), "rooted")
    parted = rooted.groupBy("loose").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_ = saved(rooted.join(parted, "loose", "left_semi"), "open")
    if not open_.limit(1).count():
        return known
    sets = saved(sets_of(open_.select("key")), "sets")
    each = open_.join(sets.select("key", F.length("hashes").alias("size")), "key").groupBy("loose").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK_ROWS), F.least(F.lit(8), F.ceil(F.col("n") / BLOCK_LEAST)))
    placed = open_.join(each.select("loose", blocks.alias("blocks")), "loose").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    met = placed.join(sets, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("loose", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("side"), "root", "hashes")
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.union(met.repartition(n, "loose", "i", "j").sortWithinPartitions("loose", "i", "j").mapInArrow(_similar_fn(similarity), "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, key, component_id) for every row of docs: component_id is the least id of all rows reachable by links
    between texts whose sets of shingles have at least that Jaccard similarity.

    Sets, not counts: repeated lines don't matter. Texts with equal sets (`key`, a 64-bit digest) count as one. Candidates
    are pairs of fingerprints of 64 x len(WIDE) bits that are within RADIUS_DEVIATIONS of what that similarity gives in
    the first 64 bits and within WIDE_DEVIATIONS in all. Candidates whose fingerprints say a similarity far above (4
    deviations: one in 30,000 pairs of just that similarity does) are links. Of the others only links that span their
    groups are kept, and in each such group all texts are compared exactly, block by block, but for those that are joined
    already. So a link may be missing between texts of different groups (README.md has the shares by similarity), but
    none is false. Nulls, ids and empty tables as in
    near_duplicates; texts without words have the empty set and are one group.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = text_or_empty(text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.crc32(text.cast("binary")).alias("c"))
    with shuffles_freed(spark):
        fps = saved(named.select("doc_id", "t", "c", set_column("text", shingle).alias("w")).select("doc_id", "t", "c", "w.*"), "fingerprints")
        groups = saved(fps.groupBy("key", *WIDE).agg(F.min("doc_id").alias("least"), F.min(F.struct("t", "c")).alias("of")), "groups")
        bits = 64 * len(WIDE)
        radius, wide = bits_apart(similarity, 64, RADIUS_DEVIATIONS), bits_apart(similarity, bits, WIDE_DEVIATIONS)
        links = saved(hamming_links(groups, radius, rest=WIDE[1:], wide=wide, sure=bits_apart(similarity, bits, -4.0)), "links")

        def sets_of(keys):
            @F.pandas_udf("binary")
            def hashes(texts: pd.Series) -> pd.Series:
                return texts.map(lambda t: np.unique(shingle_hashes(t.encode(), shingle)).tobytes())

            wanted = groups.join(keys, "key", "left_semi").select("key", "of.*")
            texts = named.groupBy("t", "c").agg(F.first("text").alias("text"))
            return texts.join(wanted, ["t", "c"]).select("key", hashes("text").alias("hashes"))

        known = saved(_verified(links, sets_of, similarity), "verified")
        roots = connected_components(known)
    rooted = groups.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("key", "component_id"), "key").select("doc_id", "key", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of docs, with its columns, whose id is the least of their near-duplicate group; of rows with the same id, one.

    Groups are those of near_duplicates, or of near_copies if a similarity is given. Rows without an id stay as they
    are: they can't be named as anything's copy.
    """
    found = near_duplicates(docs, id_col, text_col, radius) if similarity is None else near_copies(docs, id_col, text_col, similarity)
    name = unused(docs.columns, "kept_id")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(keep, F.col(id_col) == F.col(name), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
