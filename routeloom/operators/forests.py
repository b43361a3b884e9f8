"""Forests and boosted trees for two classes, grown over bins.

Trees of pyspark.ml see a feature by its bins, 32 of them, and so do these; but rows with the same bins and label become one
pattern with its count before the first tree, so that trees grow at the cost of the patterns, not of the rows. A bootstrap
draws each row Poisson(1) times, hence a pattern of n rows Poisson(n) times. Patterns are dealt to blocks; each level of all
trees is one job that adds up histograms by node, feature and bin, and chooses each node's split from them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from routeloom.operators.prefix import unused
from routeloom.operators.statistics import exact_quantiles
from routeloom.operators.texts import spread
from routeloom.sources.scratch import ensure_checkpoints

#: Patterns of a block and trees of a task, about; patterns that are broadcast when rows look up their score.
BLOCK, TREES, SMALL = 65_536, 25, 200_000
#: Rounds of boosting after which the margins so far are stored; pairs of bins of a job that a block adds up by, at most.
ROUNDS, CELLS = 10, 100_000


def _missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def bin_starts(rows: DataFrame, features: list[str], bins: int = 32) -> list[tuple[list[float], float]]:
    """For each feature the rising values at which a new bin starts, at most bins - 1, and its median. A feature of at most
    `bins` values has a bin each; else bins hold nearly equal numbers of rows, and a value of several such shares is a bin
    of its own. Exact, so reruns agree. Null and NaN don't count; without other values there is one bin and the median 0."""
    value = {f: F.col(f).cast("double") for f in features}
    known = {f: F.when(~_missing(v), v) for f, v in value.items()}
    about = rows.agg(*[F.approx_count_distinct(known[f]).alias(f"f{i}") for i, f in enumerate(features)]).first()
    few = [f for f, n in zip(features, about) if n <= 2 * bins]
    own = dict(zip(few, rows.agg(*[F.collect_set(known[f]).alias(f"f{i}") for i, f in enumerate(few)]).first())) if few else {}

    def one(f: str) -> tuple[list[float], float]:
        q = exact_quantiles(rows, f, [i / bins for i in range(bins + 1)])
        if q[0] is None:
            return [], 0.0
        if f in own and len(own[f]) <= bins:
            starts = own[f]
        else:
            often = {a for a, b in zip(q, q[1:]) if a == b}
            starts = q[:-1] + [float(np.nextafter(a, np.inf)) for a in often]
        least, most = q[0], q[-1]
        return sorted({x for x in starts if np.isfinite(x) and least < x <= most}), q[bins // 2]

    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(inheritable_thread_target(rows.sparkSession)(one), features))


def _reached(bins: np.ndarray, feature: np.ndarray, upto: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches in at most `depth` steps. The children of node i are 2 i + 1 and 2 i + 2; a row goes
    to the first if its bin of the node's feature is at most `upto`; nodes whose feature is -1 have no children."""
    rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    for _ in range(depth):
        f = feature[node]
        right = bins[rows, np.maximum(f, 0)] > upto[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _followed(bins: np.ndarray, feature: np.ndarray, upto: np.ndarray, of: np.ndarray) -> np.ndarray:
    """of[the node that each row reaches], without a row's way being looked up: cheaper where a tree has few nodes."""

    def at(node):
        return of[node] if feature[node] < 0 else np.where(bins[:, feature[node]] > upto[node], at(2 * node + 2), at(2 * node + 1))

    return np.broadcast_to(at(0), len(bins))


def _histogram(bins: np.ndarray, place: np.ndarray, chosen: np.ndarray | None, places: int, weights: list[np.ndarray], n_bins: int) -> np.ndarray:
    """Sums of each of the weights by place, feature that the place has chosen (all of them if None), and bin."""
    some = bins.shape[1] if chosen is None else chosen.shape[1]
    rows, start, out = np.arange(len(bins)), n_bins * place, np.zeros((places, some, n_bins, len(weights)))
    for j in range(some):
        at = start + (bins[:, j] if chosen is None else bins[rows, chosen[place, j]])
        for i, w in enumerate(weights):
            out[:, j, :, i] = np.bincount(at, weights=w, minlength=places * n_bins).reshape(places, n_bins)
    return out


class _Binned:
    """Bins, blocks and scores, which forests and boosted trees share."""

    features: list[str]
    bins: int

    def _columns(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """rows with each feature's bin, missing values counting as the median, and the names of these columns."""
        names: list[str] = []
        for i in range(len(self.features)):
            names.append(unused([*rows.columns, *names], f"bin_{i}"))
        filled = {n: F.when(_missing(F.col(f).cast("double")), m).otherwise(F.col(f).cast("double")) if s else F.lit(0.0) for n, f, (s, m) in zip(names, self.features, self.starts)}
        x = rows.withColumns(filled)
        cut = [(n, unused([*x.columns, *names], f"cut_{i}"), [-np.inf, *s, np.inf]) for i, (n, (s, _)) in enumerate(zip(names, self.starts)) if s]
        if cut:
            x = Bucketizer(inputCols=[n for n, _, _ in cut], outputCols=[c for _, c, _ in cut], splitsArray=[s for _, _, s in cut]).transform(x)
        now = {n: c for n, c, _ in cut}
        return x.select(*rows.columns, *[F.col(now.get(n, n)).cast("tinyint").alias(n) for n in names]), names

    def _blocks(self, rows: DataFrame, label: str) -> RDD:
        """(number, labels, counts, bins) of blocks of the distinct patterns, dealt by hash and sorted."""
        ensure_checkpoints(rows.sparkSession)
        rows = rows.where(F.col(label).isNotNull())
        self.starts = bin_starts(rows, self.features, self.bins)
        x, names = self._columns(rows.select(F.col(label).cast("tinyint").alias("y"), *self.features))
        x = x.groupBy("y", *names).agg(F.count(F.lit(1)).alias("n")).checkpoint()
        x = x.repartition(x.count() // BLOCK + 1, F.xxhash64("y", *names)).sortWithinPartitions("y", *names).select("y", "n", *names)

        def packed(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                columns = [t.column(i).to_numpy() for i in range(t.num_columns)]
                b = np.stack(columns[2:], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"y": [columns[0].tobytes()], "n": [columns[1].tobytes()], "b": [b.tobytes()]})

        width = len(names)
        of = lambda number, it: ((number, np.frombuffer(r.y, np.int8), np.frombuffer(r.n, np.int64), np.frombuffer(r.b, np.uint8).reshape(-1, width)) for r in it)
        return x.mapInArrow(packed, "y binary, n binary, b binary").rdd.mapPartitionsWithIndex(of).persist()

    def _score(self, bins: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _most_bins(self) -> int:
        return max((len(s) for s, _ in self.starts), default=0) + 1

    def fit(self, rows: DataFrame, label: str = "label"):
        fit_all([self], [rows], label)
        return self

    def transform(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        """rows with the probability of label 1. Distinct patterns are scored once, and rows look theirs up."""
        x, names = self._columns(rows)
        kinds = x.select(*names).distinct().checkpoint()
        score, width = self._score, len(names)

        def scored(batches):
            for b in batches:
                bins = np.stack([b.column(i).to_numpy() for i in range(width)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(bins), pa.float64())], [*names, out])

        done = spread(kinds, *names).mapInArrow(scored, ", ".join(f"`{n}` tinyint" for n in names) + f", `{out}` double")
        return x.join(F.broadcast(done) if kinds.count() <= SMALL else done, names).select(*rows.columns, out)


class BinnedForest(_Binned):
    """Trees over bootstrap samples, split by Gini impurity with weighted classes; `some` is the number of features that a
    node may choose from, drawn for each. Children hold at least `least` drawn rows; leaves beside each other that say the same class are
    one, as in pyspark.ml. The probability is the mean over the trees of the weighted share of label 1 in the leaf."""

    def __init__(self, features: list[str], trees: int, depth: int, some: int | None = None, least: int = 1, weights: dict[int, float] | None = None, seed: int = 42, bins: int = 32, bootstrap: bool = True):
        self.features, self.trees, self.depth, self.some, self.least = features, trees, depth, some or len(features), least
        self.weights, self.seed, self.bins, self.bootstrap = np.array([(weights or {}).get(c, 1.0) for c in (0, 1)]), seed, bins, bootstrap

    def _chosen(self, tree: int, level: int) -> np.ndarray:
        """The features that each node of the level may choose from."""
        drawn = np.random.default_rng([self.seed, tree, level]).random((1 << level, len(self.features)))
        return np.sort(drawn.argsort(axis=1)[:, : self.some], axis=1)

    def _best(self, sums: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature or -1, bin up to which rows go left, counts by side and label) of each node of a histogram."""
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        both = sums.sum(axis=2)[:, :, None]
        right = both - left

        def impurity(s):
            w = s * self.weights
            n = w.sum(-1)
            return n, 1 - ((w / np.where(n > 0, n, 1)[..., None]) ** 2).sum(-1)

        (n, whole), (l, of_left), (r, of_right) = impurity(both), impurity(left), impurity(right)
        n = np.where(n > 0, n, 1)
        gain = whole - l / n * of_left - r / n * of_right
        gain = np.where((left.sum(-1) >= self.least) & (right.sum(-1) >= self.least), gain, -1.0).reshape(len(sums), -1)
        best, node = gain.argmax(axis=1), np.arange(len(sums))
        j, at = np.divmod(best, left.shape[2])
        return np.where(gain[node, best] > 0, chosen[node, j], -1), at, np.stack([left[node, j, at], right[node, j, at]], axis=1)

    @staticmethod
    def _grow(models: list[BinnedForest], blocks: list[RDD]) -> None:
        spark = SparkSession.active()
        with ThreadPoolExecutor(len(models)) as pool:
            list(pool.map(inheritable_thread_target(spark)(BinnedForest._grow_one), models, blocks))

    def _grow_one(self, blocks: RDD) -> None:
        sc, n_bins = blocks.context, self._most_bins()
        size = (2 << self.depth) - 1
        feature, upto = np.full((self.trees, size), -1, np.int16), np.zeros((self.trees, size), np.int16)
        held = np.zeros((self.trees, size, 2))
        drawn = self._drawn
        of_all = lambda b: np.array([[np.sum(d[b[1] == c]) for c in (0, 1)] for d in (drawn(t, b) for t in range(self.trees))], float)
        held[:, 0] = blocks.map(of_all).fold(np.zeros((self.trees, 2)), add)
        tasks = sc.parallelize(range(0, self.trees, TREES), -(-self.trees // TREES)).cartesian(blocks)
        for level in range(self.depth if n_bins > 1 else 0):
            first, last = (1 << level) - 1, (2 << level) - 1
            now = held[:, first:last]
            open_ = (now.min(-1) > 0) & (now.sum(-1) >= 2 * self.least)  # pure ones and ones without room for two aren't split
            if not open_.any():
                break
            state = sc.broadcast((feature, upto, open_))
            for t, f, at, sides in self._level(tasks, state, level, n_bins).collect():
                of = np.flatnonzero(open_[t])
                split, node = f >= 0, first + of
                feature[t, node], upto[t, node] = f, at
                held[t, 2 * node[split] + 1], held[t, 2 * node[split] + 2] = sides[split, 0], sides[split, 1]
            state.unpersist()
        self._prune(feature, held * self.weights)
        w = held * self.weights
        n = w.sum(-1)
        self.model = feature, upto, np.where(n > 0, w[..., 1] / np.where(n > 0, n, 1), 0.5)

    def _drawn(self, tree: int, block) -> np.ndarray:
        number, _, n, _ = block
        return np.random.default_rng([self.seed, tree, number, len(n)]).poisson(n) if self.bootstrap else n

    def _level(self, tasks: RDD, state, level: int, n_bins: int) -> RDD:
        """(tree, feature, bin, counts) of the splits of a level's open nodes."""
        first, trees, chosen, drawn, best = (1 << level) - 1, self.trees, self._chosen, self._drawn, self._best

        def sums(task):
            at, block = task
            feature, upto, open_ = state.value
            for t in range(at, min(at + TREES, trees)):
                if not open_[t].any():
                    continue
                place = np.cumsum(open_[t]) - 1
                node = _reached(block[3], feature[t], upto[t], level) - first
                n = drawn(t, block)
                use = (node >= 0) & (n > 0)
                use[use] = open_[t][node[use]]
                y, n = block[1][use], n[use]
                yield t, _histogram(block[3][use], place[node[use]], chosen(t, level)[open_[t]], int(open_[t].sum()), [n * (y == 0), n * (y == 1)], n_bins)

        return tasks.flatMap(sums).reduceByKey(add, numPartitions=tasks.getNumPartitions()).map(lambda x: (x[0], *best(x[1], chosen(x[0], level)[state.value[2][x[0]]])))

    def _prune(self, feature: np.ndarray, weighed: np.ndarray) -> None:
        says = weighed[..., 1] > weighed[..., 0]
        for level in reversed(range(self.depth)):
            node = np.arange((1 << level) - 1, (2 << level) - 1)
            left, right = 2 * node + 1, 2 * node + 2
            same = (feature[:, node] >= 0) & (feature[:, left] < 0) & (feature[:, right] < 0) & (says[:, left] == says[:, right])
            feature[:, node] = np.where(same, -1, feature[:, node])

    def _score(self, bins: np.ndarray) -> np.ndarray:
        return sum(p[_reached(bins, f, u, self.depth)] for f, u, p in zip(*self.model)) / self.trees


class BinnedBoosting(_Binned):
    """Regression trees boosted on the logistic loss as in pyspark.ml: the first tree fits labels -1 and 1 and counts whole,
    each later one the loss's gradient, and counts by `rate`; the probability is a logistic curve of twice the margin.

    Rounds follow each other, so their number of jobs is what takes time: models that are fitted together share each job,
    and a job that also adds up by pairs of bins gives the splits of two levels, where such sums are few enough."""

    def __init__(self, features: list[str], rounds: int, rate: float, depth: int, least: int = 1, weights: dict[int, float] | None = None, bins: int = 32):
        self.features, self.rounds, self.rate, self.depth, self.least, self.bins = features, rounds, rate, depth, least, bins
        self.weights = np.array([(weights or {}).get(c, 1.0) for c in (0, 1)])
        self.pairs = list(combinations(range(len(features)), 2))

    @staticmethod
    def _grow(models: list[BinnedBoosting], blocks: list[RDD]) -> None:
        one, sc = models[0], blocks[0].context
        for m in models:
            m.model = []
        held = [(k, b) for k, b in enumerate(blocks) if not b.isEmpty()]
        if not held:
            return
        depth, size, n_bins = one.depth, (2 << one.depth) - 1, max(m._most_bins() for m in models)
        number = lambda k, b: b.map(lambda x: (k, (*x[:3], np.asfortranarray(x[3])), np.zeros(len(x[1]))))
        state, recent = sc.union([number(k, b) for k, b in held]).persist(), []
        for r in range(one.rounds):
            trees = {k: (np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size)) for k, _ in held}
            level = 0
            while level < max(depth, 1):
                first = (1 << level) - 1
                inner = np.arange((first - 1) // 2, first) if level else []
                nodes = {k: [2 * p + side for p in inner for side in (1, 2) if t[0][p] >= 0] if level else [0] for k, t in trees.items()}
                if not any(nodes.values()):
                    break
                two = level + 1 < depth and (1 << level) * len(one.pairs) * n_bins**2 <= CELLS
                got = state.map(_sums_of([m.weights for m in models], nodes, trees, tuple(recent), one.pairs if two else None, n_bins, r == 0)).treeReduce(_merged)
                for k, (single, double) in got.items():
                    for i, node in enumerate(nodes[k]):
                        split = models[k]._split(trees[k], node, single[i])
                        if two and split:
                            for side, child in ((0, 2 * node + 1), (1, 2 * node + 2)):
                                models[k]._split(trees[k], child, models[k]._side(single[i], double[i], *split, side))
                level += 2 if two else 1
            done = {k: (f, u, v if r == 0 else one.rate * v) for k, (f, u, v) in trees.items()}
            for k, t in done.items():
                models[k].model.append(t)
            recent.append(done)
            if len(recent) == ROUNDS:
                new = state.map(lambda x, seen=tuple(recent): (x[0], x[1], _margin(x, seen))).persist()
                new.count()
                state.unpersist()
                state, recent = new, []
        state.unpersist()

    def _split(self, tree, node: int, sums: np.ndarray) -> tuple[int, int] | None:
        """Sets a node's value from its sums by feature and bin and, where it gains, its split and its children's values."""
        feature, upto, value = tree
        left = np.cumsum(sums, axis=1)[:, :-1]
        both = sums.sum(axis=1)[:, None]
        right = both - left
        mean = lambda s: s[..., 1] ** 2 / np.where(s[..., 0] > 0, s[..., 0], 1)
        if node == 0:
            value[0] = both[0, 0, 1] / both[0, 0, 0]
        gain = np.where((left[..., 2] >= self.least) & (right[..., 2] >= self.least), mean(left) + mean(right) - mean(both), -1.0)
        if not self.depth or not gain.size or gain.max() <= 1e-12 * both[0, 0, 0]:
            return None
        f, at = (int(i) for i in np.unravel_index(gain.argmax(), gain.shape))
        feature[node], upto[node] = f, at
        for child, s in ((2 * node + 1, left[f, at]), (2 * node + 2, right[f, at])):
            value[child] = s[1] / s[0]
        return f, at

    def _side(self, single: np.ndarray, double: np.ndarray, f: int, at: int, side: int) -> np.ndarray:
        """Sums by feature and bin of the rows whose bin of feature f is at most `at`, or above it for side 1."""
        part, out = slice(at + 1, None) if side else slice(at + 1), np.zeros_like(single)
        out[f, part] = single[f, part]
        for sums, (a, b) in zip(double, self.pairs):
            if a == f:
                out[b] = sums[part].sum(axis=0)
            elif b == f:
                out[a] = sums[:, part].sum(axis=1)
        return out

    def _score(self, bins: np.ndarray) -> np.ndarray:
        at = sum((_followed(bins, f, u, v) for f, u, v in self.model), np.zeros(len(bins)))
        return 1 / (1 + np.exp(-2 * np.clip(at, -300, 300)))


def _margin(x, seen) -> np.ndarray:
    """A block's margins with the trees seen since they were stored."""
    k, block, at = x
    return at + sum((_followed(block[3], *trees[k]) for trees in seen), np.zeros(len(at)))


def _sums_of(weights, nodes, trees, seen, pairs, n_bins, start):
    """Of a block: {model: (sums of weight, weight x aim and rows by node, feature and bin; the same by pairs of bins)}."""

    def sums(x):
        k, block, _ = x
        sign = 2.0 * block[1] - 1
        aim = sign if start else 4 * sign / (1 + np.exp(np.minimum(2 * sign * _margin(x, seen), 700)))
        w, (feature, upto, value) = block[2] * weights[k][block[1]], trees[k]
        number = np.full(len(value), -1, np.int64)
        number[nodes[k]] = range(len(nodes[k]))
        place, bins, stats = _followed(block[3], feature, upto, number), block[3], [w, w * aim, block[2]]
        if place.min() < 0:  # rows of nodes that weren't split
            use = place >= 0
            place, bins, stats = place[use], bins[use], [v[use] for v in stats]
        single = _histogram(bins, place, None, len(nodes[k]), stats, n_bins)
        if pairs is None:
            return {k: (single, None)}
        double = np.zeros((len(nodes[k]), len(pairs), n_bins, n_bins, len(stats)))
        for i, (f, g) in enumerate(pairs):
            at = (place * n_bins + bins[:, f]) * n_bins + bins[:, g]
            for j, v in enumerate(stats):
                double[:, i, ..., j] = np.bincount(at, weights=v, minlength=len(nodes[k]) * n_bins**2).reshape(-1, n_bins, n_bins)
        return {k: (single, double)}

    return sums


def _merged(a: dict, b: dict) -> dict:
    plus = lambda x, y: tuple(u if u is None else u + v for u, v in zip(x, y))
    return a | {k: plus(a[k], v) if k in a else v for k, v in b.items()}


def fit_all(models: list[BinnedForest] | list[BinnedBoosting], rows: list[DataFrame], label: str = "label") -> None:
    """Fits models of one kind and size, each to its rows, side by side."""
    if not models:
        return
    with ThreadPoolExecutor(len(models)) as pool:
        target = inheritable_thread_target(rows[0].sparkSession)
        blocks = list(pool.map(target(lambda m, r: m._blocks(r, label)), models, rows))
    type(models[0])._grow(models, blocks)
    for b in blocks:
        b.unpersist()
