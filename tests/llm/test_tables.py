from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from routeloom.llm import common, hashing, mixing, simhash, urls, warc
from routeloom.llm.components import connected_components


def brute_components(fps, radius=3):
    u = sorted(fps)
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in u}


def test_simhash_by_definition():
    for text in ("", "one", "Two words", "A b\tc\nd  e É", "x y " * 500):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.simhash64(text.encode()) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_links_span_all_pairs_within_the_radius(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):  # dense groups, chains and pairs at every distance
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(links).collect()}
    want = brute_components(fps, radius)
    groups = lambda m: sorted(sorted(g) for g in _classes({f: m.get(f, f) for f in fps}))
    assert groups(got) == groups(want)


def _classes(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out.values()


def test_allocation_is_complete_and_best():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (20, 64)).astype(np.uint8)
    ones = rng.random(64) * 1000
    for m in (2, 3, 4):
        groups = simhash.group_bits(np.abs(rng.standard_normal((64, 64))), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        t, cost = simhash.allocate(bits, groups, ones, 1000, 3)
        assert (t.sum(1) == 3 - m + 1).all() and (t >= -1).all() and np.isfinite(cost).all()


def test_near_duplicates_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base), (5, base + " extra"), (9, None), (8, ""), (2, "short"), (2, "short"), (None, "short"), (11, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS fp", "doc_id AS component_id")
    got = simhash.near_duplicates(docs).collect()
    fp = {r.doc_id: r.fp % (1 << 64) for r in got if r.doc_id is not None}
    root = brute_components(set(fp.values()))
    least = defaultdict(lambda: 1 << 60)
    for d, f in fp.items():
        least[root[f]] = min(least[root[f]], d)
    assert len(got) == len(rows) and all(r.component_id == least[root[r.fp % (1 << 64)]] for r in got)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def exact_components(texts, least=0.8):
    """Of all pairs with that Jaccard similarity or more."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and root[a] != root[b] and jaccard(sets[a], sets[b]) >= least:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return root


def replaced(rng, words, share):
    copy = list(words)
    for _ in range(round(share * len(words))):
        copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
    return copy


def test_near_copies_against_jaccard(spark):
    """Copies with replaced words, of every similarity: no link below 0.8 by the shingle sets, nearly all from there on."""
    rng = random.Random(21)
    rows, pairs = [], []
    for g in range(400):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([60, 200, 900]))]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(replaced(rng, base, rng.uniform(0, 0.06))))]
        pairs.append(jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])))
    lines = "\n".join(["one line that is here again and again"] * 50)  # repeats don't count
    extra = [(900, None), (901, ""), (902, "only four words here"), (903, "only four words here"), (None, "only four words here"), (3, rows[3][1]), (904, "z" * 200_000), (905, lines), (906, lines + "\n" + lines), (907, lines + " x" * 100)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "text AS fp", "doc_id AS key", "1 AS t")
    got = simhash.near_copies(docs).collect()
    root = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) + len(extra) and root[901] == 900 and root[903] == 902 and root[904] == 904 and root[906] == 905 and root[907] in (905, 907)
    linked = [root[2 * g + 1] == 2 * g for g in range(400)]
    assert not any(hit for hit, j in zip(linked, pairs) if j < 0.8) and all(hit for hit, j in zip(linked, pairs) if j >= 0.95)
    border = [hit for hit, j in zip(linked, pairs) if 0.8 <= j < 0.85]
    assert len(border) >= 30 and sum(border) >= 0.93 * len(border)
    assert all(root[i] in (i, i - 1) for i in range(800))


def test_near_copies_of_a_large_group(spark):
    """Buckets above PAIRS rows: hundreds of copies of one text, most a little below or above 0.8 from each other."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
    texts = {i: " ".join(replaced(rng, base, share)) for i, share in enumerate([0.003] * 60 + [0.012] * 60 + [0.02] * 60 + [0.05] * 60)}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = exact_components(texts)
    assert all(want[i] == want[got[i]] for i in texts)  # no false link
    assert sum(got[i] == want[i] for i in texts) >= 0.97 * len(texts)


def test_each_nearest_candidate_first(spark):
    """With more than 4 candidate pairs a text, verification goes on until none is left that could join two groups."""
    rng = random.Random(6)
    sets = {k: np.unique(rng.sample(range(100), 60 if k < 20 else 95)).astype(np.uint64) for k in range(30)}
    links = [(a, b, rng.randint(1, 9)) for a in range(30) for b in range(a + 1, 30)]
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    all_sets = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "key long, hashes binary")
    asked = []
    got = simhash._verified(spark.createDataFrame(links, "a long, b long, apart long"), lambda keys: asked.append(1) or all_sets.join(keys, "key"), 0.8)
    roots = {r.node: r.root for r in connected_components(got).collect()}
    root = {k: k for k in sets}
    for a, b, _ in links:
        if like(a, b) and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    assert {k: roots.get(k, k) for k in sets} == root and len(asked) == 1


def joined(nodes, pairs):
    """The least node that each reaches."""
    root = {i: i for i in nodes}
    for a, b in pairs:
        if root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return root


def test_links_of_a_group_are_fewer_than_its_rows(spark):
    """Not a link for each pair, and the sure ones span what pairs within `sure` do."""
    rng = random.Random(8)
    flipped = lambda most: sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
    for n in (50, 200):
        words = [[flipped(3) for _ in range(4)] for _ in range(n)]
        rows = [(*[w - (1 << 64) if w >= 1 << 63 else w for w in four], i) for i, four in enumerate(words)]
        distinct = spark.createDataFrame(rows, "fp long, fp1 long, fp2 long, fp3 long, key long")
        links = simhash.hamming_links(distinct, 6, rest=("fp1", "fp2", "fp3"), wide=24, sure=4, partitions=1).collect()
        assert len(links) < n
        far = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(words[i], words[j]))
        for apart, most in ((0, 4), (1, 24)):
            want = joined(range(n), [(i, j) for i in range(n) for j in range(i + 1, n) if far(i, j) <= most])
            assert joined(range(n), [(r.a, r.b) for r in links if r.apart <= apart]) == want


def test_pairs_of_a_group_are_compared_without_candidates(spark, monkeypatch):
    """All pairs of a group that links only span, in one block and in several, with long and empty sets."""
    rng = random.Random(9)
    sets = {k: np.unique(rng.sample(range(k % 3 * 1000, k % 3 * 1000 + 100), rng.choice([84, 88, 92]))).astype(np.uint64) for k in range(60)}
    sets |= {60: np.arange(0, 0, dtype=np.uint64), 61: np.arange(60_000, dtype=np.uint64), 62: np.arange(11_000, 60_000, dtype=np.uint64)}
    links = [(0, k, 1) for k in range(1, 63)] + [(70, 71, 0)]
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    root = joined([*sets, 70, 71], [(a, b) for a in sets for b in sets if a < b and like(a, b)] + [(70, 71)])
    assert 5 < len(set(root.values())) < 60 and root[62] == 61
    all_sets = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "key long, hashes binary")
    for least, size in ((1000, 16 << 20), (10, 16 << 20), (1000, 50_000)):
        monkeypatch.setattr(simhash, "BLOCK_LEAST", least)
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
        got = simhash._verified(spark.createDataFrame(links, "a long, b long, apart long"), lambda keys: all_sets.join(keys, "key"), 0.8)
        assert joined(root, [(r.a, r.b) for r in got.collect()]) == root


def test_near_copies_of_none(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_copies(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (None, 1), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 200))


def test_components_of_random_edges_leave_one_table(spark):
    """Edges are contracted, and only the result is left of what the rounds write, on disk as in the list of paths."""
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    with common.collected() as paths:
        got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert len(paths) == 1 and all(paths[0].split("/")[-1] in f for f in got.inputFiles())
    assert {r.node: r.root for r in got.collect()} == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def waterfill(sizes, weights, total, most=2.0):
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > most * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_cases(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 80, 2000]))), rng.choice(["a"] * 6 + ["b", "é", None, ""])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "only empty"), (3, "again here", "b"), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "source AS target", "doc_id AS size")
    got = mixing.mix(docs.select("doc_id", "text", "source", "target")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = waterfill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    clash = docs.selectExpr("*", "doc_id AS mixed_id", "text AS mixed_position", "0 AS first")
    assert mixing.curriculum(clash).columns == clash.columns
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns and out.count() >= sum(r.copies for r in got if r.doc_id is not None) - 4
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_one_repeated_row(spark):
    """A third of all rows alike, without an id: each has its place, as if they came one by one."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a b' ELSE concat('w ', id) END AS text", "CASE WHEN id % 3 = 0 THEN 'x' ELSE concat('s', id % 2) END AS source")
    got = mixing.mix(rows)
    assert got.count() == 30_000
    r = got.where("source = 'x'").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count_distinct("position").alias("places"), F.count("position").alias("placed")).first()
    assert r.n == 10_000 and abs(r.taken - r.target) <= 1 and r.places == r.placed > 0
    assert got.where("taken > 2 * size").count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_targets_of_many_sources(spark, n):
    """Targets and places against the rule applied round by round, with more sources than partitions."""
    rng = random.Random(n)
    sizes = {f"s{rng.random()}" if i else None: rng.choice([0, 1, 7, 50, 5000]) for i in range(n)}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame([(s, x) for s, x in sizes.items()], "source string, size long")).collect()}
    order = sorted(s for s in sizes if s is not None) + [None]
    want = waterfill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert [got[s].place for s in order] == list(range(n)) and all(abs(got[s].target - want[s]) < 1e-6 for s in sizes)


def test_inverse_demand(spark):
    x = spark.range(101).select((F.col("id") / 100).alias("part"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("place"))
    for r in x.select("part", "place", mixing.inverse_demand(F.col("part"), F.col("place")).alias("t")).collect():
        knots = mixing.SCHEDULES[r.place]
        ts = np.linspace(0, 1, 20001)
        w = np.interp(ts, [k[0] for k in knots], [k[1] for k in knots])
        area = np.append(0, np.cumsum((w[1:] + w[:-1]) / 2))
        assert abs(np.interp(r.t, ts, area / area[-1]) - r.part) < 1e-4


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_round_trip_with_magic_inside(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", "same"), (5, "http://b/", "same"), (0, None, "same"), (2, "http://c\r\nX: y", fake), (3, "", None), (4, "x", ""), (6, "x", "é\r\n\r\n" + fake + fake), (None, "x", "n"), (7, "x", "long " * 50_000), (7, "x", "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html AS payload", "url AS digest", "page_id AS first")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(x for x in (least.get(h or ""), i) if x is not None) if i is not None or (h or "") in least else None
    want = Counter((None if i is None else str(i), len((h or "").encode()), b32((h or "").encode()), "response" if least[h or ""] == i else "revisit", None if least[h or ""] == i else str(least[h or ""])) for i, _, h in rows)
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and len(warc.candidates(data)[0]) > len(rows)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    (tmp_path / "none").mkdir()
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    small = warc.records(pages, min_bytes=5).where("record like '%WARC-Type: revisit%'").count()
    assert small == 0


def test_warc_of_other_writers(spark, tmp_path):
    def record(kind, ident, content_type, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nContent-Type: {content_type}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    text = b"first part\r\n\r\nsecond part"
    made = [record("warcinfo", "<urn:uuid:i>", "application/warc-fields", text), record("resource", "<urn:uuid:r>", "text/plain", text), record("response", "<urn:uuid:h>", "Application/HTTP;msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + text)]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "c.txt").write_bytes(made[0])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert Counter((r.file[-1], r.id, r.record_type, r.payload_bytes, r.payload_digest) for r in got) == Counter((f, i, k, len(text), b32(text)) for f in "cz" for i, k in (("<urn:uuid:i>", "warcinfo"), ("<urn:uuid:r>", "resource"), ("<urn:uuid:h>", "response")))
    assert warc.read_archives(spark, str(tmp_path), "*.txt").count() == 1


def test_warc_damaged_and_nested(spark, tmp_path):
    """A damaged gzip stream gives what stands before it; payloads that nest magics with long lengths are hashed once."""
    def record(i, payload):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: text/plain\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    nested = b"core"
    for k in range(300):
        nested = record(1000 + k, nested)[:-4] + b"\r\n\r\n"
    whole = record(1, b"first") + record(2, nested) + record(3, b"last")
    (tmp_path / "a.warc").write_bytes(whole)
    first = gzip.compress(record(1, b"first"))
    damaged = bytearray(first + gzip.compress(record(2, b"second " * 900)))
    damaged[len(first) + 10] = 0xFF  # no such block type
    (tmp_path / "b.warc.gz").write_bytes(bytes(damaged))
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted((r.file[-1], r.id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [("c", "1", 5, b32(b"first")), ("c", "2", len(nested), b32(nested)), ("c", "3", 4, b32(b"last")), ("z", "1", 5, b32(b"first"))]
    assert len(warc.candidates(whole)[0]) == 303


def test_warc_repeats_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, f"p{i % 3}") for i in range(40)] + [(40, "single")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    want = {i: None if i < 3 or i == 40 else str(i % 3) for i, _ in rows}
    for limit in (200_000, 1):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
        warc.write_archives(pages, str(tmp_path / str(limit)))
        assert {int(r.id): r.refers_to for r in warc.read_archives(spark, str(tmp_path / str(limit))).collect()} == want


def test_buckets_that_go_on_over_batches():
    """A bucket of many batches is found whole."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    fps = np.unique(rng.integers(0, 1 << 62, 2000))
    near = fps[:50] ^ 5
    every = np.concatenate([fps, near])
    value = np.where(np.arange(len(every)) < 30, 1, 2)
    own = np.arange(len(every)) < 2000  # the near ones are probes
    batches = (pa.RecordBatch.from_pydict({"part": np.zeros(min(64, len(every) - i), np.int32), "value": value[i : i + 64], "own": own[i : i + 64], "node": every[i : i + 64], "fp": every[i : i + 64]}) for i in range(0, len(every), 64))
    found = {tuple(sorted(x)) for b in simhash._verify_fn(3)(batches) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert {tuple(sorted(map(int, x))) for x in zip(fps[30:50], near[30:50])} <= found


def test_pointer_jumping():
    rng = random.Random(4)
    for _ in range(50):
        at = np.array(sorted(rng.sample(range(1, 200), 40)) + [0])
        nxt = np.array([rng.choice([a for a in [*at.tolist(), 999] if a > x]) for x in at.tolist()])
        rng_order = np.array(rng.sample(range(len(at)), len(at)))
        want, x = set(), 0
        jump = dict(zip(at.tolist(), nxt.tolist()))
        while x in jump:
            want.add(x)
            x = jump[x]
        got = warc.reachable(at[rng_order], nxt[rng_order])
        assert set(at[rng_order][got].tolist()) == want


def test_urls_cases(spark):
    rows = [(1, "HTTP://A.Example.COM/en/70?x", ""), (2, "http://com/en/", ""), (3, "http://example.com/en/7#f", None), (4, "http://xexample.net/de/8", ""), (5, None, ""), (6, "no scheme", ""), (7, "http://h.org", ""),
            (8, "http://linker.io/a", '<a href="http://bad.org/x">'), (9, "http://bad.org/es/1", ""), (10, "http://leaf.io/", ""), (11, "http://good.example.com/en/7", '<a href="//leaf.io/z"> <A HREF=http://other.io/>'), (1, "HTTP://A.Example.COM/en/70?x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS host", "html AS rule", "url AS verdict")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/70", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict, got[4].rule, got[4].verdict) == ("com/en/", "block", "net/de/", "allow")  # xexample.net is no subdomain of example.net
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("", "", None, "allow") and got[6].host == ""
    assert got[8].verdict == "block" and got[8].distrust > 0 and got[8].rule is None  # it links to a blocked host
    assert got[10].verdict == "allow" and got[10].trust > 0 and got[7].path == ""
    assert urls.judge(pages.limit(0)).count() == 0


def test_rules_are_those_of_the_contract(spark):
    """Contract: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    cases = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://x.example.net/de/80": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow"), "http://o.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).collect()} == dict(enumerate(cases.values()))


def test_judge_against_brute_force(spark):
    """Whole verdicts, trust and distrust over linked pages, with the query's own parameters."""
    rng = random.Random(11)
    hosts = [f"h{i}.{tld}" for i in range(14) for tld in ("example.com", "net", "org")]
    rows = []
    for i in range(300):
        links = "".join(f'<a href="https://{rng.choice(hosts[: 30])}/x{i}">' for _ in range(rng.choice([0, 0, 1, 3])))
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}", links))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    ruled, seeds, out = {}, {"allow": Counter(), "block": Counter()}, Counter()
    for i, url, html in rows:
        host, path = url[7:].split("/", 1)[0], "/" + url[7:].split("/", 1)[1]
        fit = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled[i] = (host, max(fit)[1] if fit else None)
        if fit:
            seeds[ruled[i][1]][host] += 1
        for part in html.split('href="https://')[1:]:
            out[(host, part.split("/")[0])] += part.split("/")[0] != host

    def rank(seed, edges):
        r0 = np.array([seed[h] for h in hosts], float) / sum(seed.values())
        m = np.zeros((len(hosts), len(hosts)))
        for (a, b), w in edges.items():
            m[hosts.index(b), hosts.index(a)] += w
        total = m.sum(0)
        m /= np.where(total, total, 1)
        r = r0.copy()
        for _ in range(300):
            r = 0.15 * r0 + 0.85 * (m @ r + r0 * r[total == 0].sum())
        return dict(zip(hosts, r))

    trust, distrust = rank(seeds["allow"], out), rank(seeds["block"], {(b, a): w for (a, b), w in out.items()})
    assert len(got) == 300 and any(v is None for _, v in ruled.values())
    for i, (host, v) in ruled.items():
        assert abs(got[i].trust - trust[host]) < 1e-5 and abs(got[i].distrust - distrust[host]) < 1e-5
        if abs(trust[host] - distrust[host]) > 1e-5:
            assert got[i].verdict == (v or ("block" if distrust[host] > trust[host] else "allow"))


def test_pagerank_against_brute_force(spark):
    rng = random.Random(6)
    hosts = [f"h{i}" for i in range(12)]
    links = {(a, b): rng.randint(1, 4) for a in hosts[:9] for b in rng.sample(hosts, 3) if a != b}
    seeds = {"h0": 2.0, "h3": 1.0}
    rank = urls.propagate(spark.createDataFrame([("trust", h, m) for h, m in seeds.items()], "kind string, host string, mass double"), spark.createDataFrame([("trust", a, b, float(w)) for (a, b), w in links.items()], "kind string, src string, dst string, weight double"), rounds=60, tolerance=1e-10)
    got = {r.host: r["rank"] for r in rank.collect()}
    s = np.array([seeds.get(h, 0) for h in hosts]) / 3
    m = np.zeros((12, 12))
    for (a, b), w in links.items():
        m[hosts.index(b), hosts.index(a)] = w
    out = m.sum(0)
    m = m / np.where(out, out, 1)
    r = s.copy()
    for _ in range(400):
        r = 0.15 * s + 0.85 * (m @ r + s * r[out == 0].sum())
    assert all(abs(got.get(h, 0) - r[i]) < 1e-6 for i, h in enumerate(hosts)) and abs(sum(got.values()) - 1) < 1e-9


def test_pagerank_reaches_far_hosts_by_default(spark):
    """A chain of 25 links from the only seed: the defaults of the query, no round given."""
    seeds = spark.createDataFrame([("trust", "h0", 1.0)], "kind string, host string, mass double")
    links = spark.createDataFrame([("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(25)], "kind string, src string, dst string, weight double")
    got = {r.host: r["rank"] for r in urls.propagate(seeds, links).collect()}
    first = 0.15 / (1 - 0.85**26)  # ranks fall by the damping along the chain, and add up to 1
    assert len(got) == 26 and all(abs(got[f"h{i}"] - first * 0.85**i) < 1e-5 for i in range(26))


def test_search_cases(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[700] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0] * 3), (5080, [None] + [1.0] * 23), (None, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS shard", "embedding AS v")
    got = defaultdict(list)
    for r in hashing.search(v, lambda i: i % 20 == 0, shard_rows=400).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        hit += len(set(want) & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    few = hashing.search(v.where("vec_id < 5"), lambda i: i % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert hashing.search(v.limit(0), lambda i: i % 20 == 0).count() == 0


def test_cells_retrieve_every_code_within_the_radius_once():
    """Over the cells that a query is sent to, split ones too: all codes within the radius, each once."""
    rng = np.random.default_rng(9)
    x, codes = rng.standard_normal((600, 4)), rng.integers(0, 1 << 63, 600).astype(np.uint64)
    codes[:300] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    ids = np.arange(600)
    for bits in (0, 2, 5):
        counts = np.bincount(hashing.Cells(bits, np.ones(4 << bits, np.int64), 1).leading(codes).ravel(), minlength=4 << bits)
        cells = hashing.Cells(bits, counts, 40)
        dealt = cells.of_rows(ids, codes)
        made = {c: hashing.Cell(int(cells.substring[c]), *(y[np.flatnonzero((dealt == c).any(1))] for y in (ids, x, codes))) for c in range(cells.total)}
        assert sum(len(c.ids) for c in made.values()) == 4 * 600
        for radius in (0, 1, 3, 8, 17, 30, 64):
            queries, sent = cells.of_queries(codes[[0, 5, 400]], radius)
            for k, q in enumerate((0, 5, 400)):
                found = [i for c in sent[queries == k].tolist() for i in made[c].ids[made[c].within(codes[q], radius)].tolist()]
                assert sorted(found) == np.flatnonzero(np.bitwise_count(codes ^ codes[q]) <= radius).tolist()


def test_search_of_clusters(spark):
    """Small radius: queries meet few cells, small clusters are asked again, and copies beyond k go by id."""
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 3000)] + 0.05 * rng.standard_normal((3000, 32))
    x[:5] = 8 * rng.standard_normal(32)  # a cluster of fewer than k
    x[100:400] = x[100]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hashing.search(v, lambda i: i % 20 == 0, shard_rows=200).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20)) and all(len(f) == 20 for f in got.values())
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found.sort()
        want = np.sort(s)[-20:][::-1]
        hit += sum(f[2] >= want[-1] - 1e-9 for f in found)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
    assert hit / (20 * len(got)) >= 0.9
