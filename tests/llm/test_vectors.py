"""Vector codes and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from routeloom.llm import codes, negatives

BAD = [(901, None, 1), (902, [], 1), (903, [1.0, None, 0.0, 0.0], 1), (904, [math.nan] * 4, 1), (905, [1.0, math.inf, 0.0, 0.0], 2), (906, [1.0, 2.0], 2)]


def table(spark, rows, extra=True):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return d.selectExpr("*", "1 AS id", "2 AS v", "3 AS of", "4 AS code") if extra else d


def ints(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def plain_codes(rows, parts, entries, rounds):
    """Straight from the definition, with Python integers."""
    rows = sorted(((i, ints(v), lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts)
    cut = lambda v: [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, s: min(range(len(books[p])), key=lambda e: (far(books[p][e], s), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = [near(p, cut(v)[p]) for _, v, _ in rows]
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), o in zip(rows, of) if o == e]
                if mine:
                    new[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = []
    for i, v, lab in rows:
        c = [near(p, s) for p, s in enumerate(cut(v))]
        out.append((i, lab, "".join(f"{x:02x}" for x in c), sum(far(books[p][x], s) for (p, s), x in zip(enumerate(cut(v)), c))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("length", [4, 6])
def test_codes(spark, length):
    rng = random.Random(length)
    rows = [(i, [rng.gauss(0, 1) for _ in range(length)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[5][1], 4), (7, rows[8][1], 1)] + [(100 + i, [0.5] * length, 3) for i in range(40)]  # repeated ids, ties
    for entries, parts in ((8, 2), (200, 4)):
        got, books = codes.compress(table(spark, [*rows, *BAD]).repartition(3), parts=parts, entries=entries)
        want, digest = plain_codes(rows, parts, entries, codes.ROUNDS)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        assert codes.books_digest(books) == digest
        back = codes.decode(got, books, length).collect()
        exact = {r.id: r.decoded for r in back if r.error == 0}
        assert all(exact[i] == ints(v) for i, v, _ in rows if i in exact and i not in (None, 3, 7)) and len(back) == len(rows)


def test_codes_of_none_and_large(spark):
    got, books = codes.compress(table(spark, BAD[:5]))
    assert got.count() == 0 and books.shape[1] == 0
    assert codes.compress(table(spark, []))[0].columns == ["id", "label", "code", "error"]
    most = codes.bound(2)
    got, books = codes.compress(table(spark, [(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1), (3, [-0.001, 0.0], 2)]), parts=2, rounds=0)
    assert books.tolist() == [[[most], [0], [-1]], [[-most], [0], [0]]] and {r.code for r in got.collect()} == {"0000", "0101", "0201"}


def plain_negatives(rows, every, k=5, n=3):
    rows = [(i, ints(v), lab) for i, v, lab in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    anchors = {}
    for i, v, lab in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    for a, (lab, v) in anchors.items():
        scored = sorted(((-dot(v, w), i, m) for i, w, m in rows if i != a))
        for s, i, _ in [x for x in scored if x[2] == lab][:k]:
            fit = [(-t, j) for t, j, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, i, r + 1, j, -s, t) for r, (t, j) in enumerate(fit[:n])]
    return out


def clustered(rng, n, d, groups):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("lists", "shard_rows", "sample"), [(1, 4000, 4000), (12, 40, 64), (40, 8, 300)])
def test_negatives(spark, lists, shard_rows, sample):
    rng = random.Random(lists)
    rows = clustered(rng, 300, 4, 6)
    rows += [(300 + i, rows[1][1], i % 3) for i in range(90)]  # a third of all rows alike
    rows += [rows[50], rows[50], (50, rows[7][1], 0), (-10, rows[10][1], 2)] + [(400 + i, [0.0] * 4, 1) for i in range(4)]
    d = table(spark, [*rows, *BAD, (None, [1.0] * 4, 1), (910, [1.0] * 4, None)])
    got = negatives.mine(d, lambda i: i % 10 == 0, sample=sample, lists=lists, list_rows=1, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, 10))


def test_negatives_of_few(spark):
    cases = [[], BAD[:5], [(0, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.6, 0.0], 2)], [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.6, 0.0], 2)]]
    for rows in cases:
        got = negatives.mine(table(spark, rows), lambda i: i % 10 == 0)
        assert sorted(map(tuple, got.collect())) == sorted(plain_negatives([r for r in rows if r not in BAD], 10))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * 1e5 * rng.random() for _ in range(4)], i % 2) for i in range(40)]
    got = negatives.mine(table(spark, rows), lambda i: i % 10 == 0, list_rows=4)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, 10))


def test_bounds_hold_and_visits_stop():
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (20, 8))
    x = centres[rng.integers(0, 20, 2000)] + rng.integers(-20, 20, (2000, 8))
    c = negatives.kmeans(x, 30)
    of = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
    apart = x - c[of]
    squares = np.array([((apart * apart).sum(1))[of == i].max(initial=0) for i in range(len(c))])
    low, high = negatives.bounds(x[:50], c, squares)
    scores = x[:50] @ x.T
    assert (scores <= high[:, of]).all() and (scores >= low[:, of]).all()
    lists = negatives.Lists(c, squares, np.bincount(of, minlength=len(c)), 300)
    shard = negatives.Shard(lists, of, np.arange(2000), np.zeros(2000, np.int64), x)
    seen = []
    plain, negatives.products = negatives.products, lambda a, b: seen.append(len(a) * len(b)) or plain(a, b)
    try:
        whole = lambda v: np.full((50, 1), v)
        best = shard.visit(x[:50], np.arange(50), np.zeros(50, np.int64), whole(negatives.LOW), whole(negatives.HIGH), whole(negatives.LOW), 5, True)
    finally:
        negatives.products = plain
    for i in range(50):
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if j != i)[:5]
        assert list(zip((-best.score[i, 0]).tolist(), best.id[i, 0].tolist())) == want
    assert sum(seen) < 0.5 * 50 * 2000  # clusters beyond the bound aren't scored
