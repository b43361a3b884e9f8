"""The pipeline on a small fixture: after each stage the rows that a plain Python version gives."""

from __future__ import annotations

import random
import threading
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from routeloom.llm import mixing, pieces, quality
from routeloom.llm.common import clean, collected, saved, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("st", "wa", "lo", "mi") for b in ("o", "e", "ai") for c in ("ne", "ter", "nd", "rk", "ly")]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    texts = [line(rng.randint(30, 400)) for _ in range(160)]
    texts += [texts[5], texts[5], texts[6] + " one more", " ".join(texts[7].split()[:-1])]  # exact and near copies
    texts += [" ".join(w.upper() + "!!" for w in line(120).split()) for _ in range(12)] + ["| | | 88 99 ## " * 60 for _ in range(6)]
    texts += [None, "", line(9000)]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 164), 0) for i in range(0, 182, 2)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = by_id(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "mixing", "pieces"]

    def stage(name, before):
        path = scratch_path(spark, f"test-{name}")
        stages[name](spark, before, folder).write.parquet(path)
        return spark.read.parquet(path)

    kept = stage("quality", docs)
    scored = by_id(quality.op2_quality(spark, folder))
    assert kept.columns == COLUMNS and set(by_id(kept)) == {i for i, r in scored.items() if r.predicted == 1}
    assert len(set(range(164)) & set(by_id(kept))) >= 162 and not set(range(164, 182)) & set(by_id(kept))
    assert {5, 6, 7} <= set(by_id(kept))

    single = stage("near_duplicates", kept)
    texts = {i: r.text for i, r in by_id(kept).items()}
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert single.columns == COLUMNS and set(by_id(single)) == set(root.values())
    assert not {160, 161} & set(by_id(single)) and all(every[i] == r for i, r in by_id(single).items())

    mixed = stage("mixing", single)
    size = {i: len((r.text or "").split()) for i, r in by_id(single).items()}
    total = Counter()
    for i, r in by_id(single).items():
        total[r.source] += size[i]
    order = sorted(s for s in total if s is not None) + [None]
    weight, target, open_, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * total[s]]
        for s in over or open_:
            target[s] = 2 * total[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    hashes = {r.doc_id: r.h for r in single.selectExpr("doc_id", "xxhash64(doc_id, 42) AS h").collect()}
    want, at = Counter(), Counter()
    for i in sorted(size, key=lambda i: (hashes[i] % 64, hashes[i], i)):
        s = every[i].source
        want[i] += sum(size[i] > 0 and at[s] + k * total[s] < round(target[s]) for k in (0, 1))
        at[s] += size[i]
    assert mixed.columns == COLUMNS and Counter(r.doc_id for r in mixed.collect()) == +want

    last = stages["pieces"](spark, mixed, folder).collect()
    surface = pieces.Vocabulary(pieces.read_model(pieces.MODEL), 0.5).surface
    assert Counter(r.doc_id for r in last) == +want and all(r.lossless and r.n_pieces == len(r.ids) for r in last)
    assert all(pieces.decode_ids(surface, np.array(r.ids)) == every[r.doc_id].text for r in last)


def test_run_is_the_stages_and_cleans_up(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    first = Counter((r.doc_id, tuple(r.ids)) for r in got.collect())
    assert got.columns == ["doc_id", "n_pieces", "ids", "lossless"]
    assert first == Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    clean(spark)


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.targets(spark.createDataFrame([], "source string, size long")).count() == 0


def test_scratch_of_others_is_left(spark):
    """Paths are collected for the run that asked for them only, also from another thread."""
    other = []
    with collected() as mine:
        path = scratch_path(spark, "mine")
        t = threading.Thread(target=lambda: other.append(saved(spark.range(3), "other")))
        t.start()
        t.join()
    assert mine == [path] and other[0].count() == 3
