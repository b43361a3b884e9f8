from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import chat, packing, pieces, quality

BITS = st.sampled_from(["</s>", "[INST]", "\\", "<", "/s>", "<|im_end|>", "<|im_start|>", "\n", "a", "é", '"', "|", "<s", ">"])


@settings(max_examples=200, deadline=None)
@given(st.lists(BITS, max_size=8).map("".join), st.lists(BITS, max_size=4).map("".join))
def test_turn_round_trip(text, role):
    out, level = chat.render(role, text)
    assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2
    assert not any(c in out[len(chat.START) : -len(chat.END) - 1] for c in chat.CONTROLS)
    _, _, a, b = chat.parse(out)[0]
    assert chat.unescape(out[a:b], level) == text
    assert chat.unescape(chat.escape(text, 2), 2) == text


def test_escapes_only_conflicts():
    assert chat.render("user", "a\\b")[1] == 0 and chat.render("user", "</s>")[1] == 1
    with pytest.raises(chat.GrammarError):
        chat.parse("<|im_start|>user\n</s><|im_end|>\n")


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "hi"), (1, 2, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "x" * 200_000), (3, None, "assistant", "\\")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role AS formatted", "turn AS level")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(c)).collect()}
    assert len(got) == 4 and got[2].n_turns == 2
    turns = [("user", "hi"), ("assistant", "yes </s>"), ("", "")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"yes </s>").hexdigest() and got[1].loss_chars == 8
    assert got[1].formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in turns)
    assert chat.read_back(chat.format_turns(c.limit(0))).count() == 0


def test_pieces_lossless_and_stable(spark):
    texts = [None, "", " ", "  two  spaces ", "▁ literal ▁▁", "日本語テキスト 😀 end", "a\n\tb\r\n", "word", "word", "x" * 5000, "the quick brown fox " * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])], "doc_id long, text string").selectExpr("*", "text AS ids")
    got = pieces.round_trip(docs).collect()
    assert all(r.lossless for r in got) and len(got) == len(texts) + 2
    again = {(r.doc_id, tuple(r.ids)) for r in pieces.round_trip(docs.repartition(5)).collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == again
    assert pieces.round_trip(docs.limit(0)).count() == 0


def test_pieces_sample_the_lattice():
    """Frequencies of segmentations against the products of weights over all paths."""
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), 0.3)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    word, by_text = "▁them", {sp.id_to_piece(i): i for i in range(sp.get_piece_size())}
    paths = {}

    def walk(at, ids, logw):
        if at == len(word):
            paths[tuple(ids)] = np.exp(logw)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in by_text:
                i = by_text[word[at:end]]
                walk(end, [*ids, i], logw + v.log_weight[i])

    walk(0, [], 0.0)
    total, n = sum(paths.values()), 40_000
    with np.errstate(over="ignore"):
        ends, ids = pieces.sample_batch(pieces.Lattices(v), ["them"] * n, np.arange(n).astype(np.uint64))
    seen: dict[tuple, int] = {}
    for a, b in zip(ends[:-1], ends[1:]):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    assert set(seen) <= set(paths)
    for p, w in paths.items():
        assert abs(seen.get(p, 0) / n - w / total) < 0.012


def test_pieces_sample_runs_of_spaces():
    """As above over whole texts with runs of spaces: in front, between words and at the end."""
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), 0.3)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    by_text = {sp.id_to_piece(i): i for i in range(sp.get_piece_size())}
    n = 40_000
    for text in ("a   b", " a", "if  ", "  "):
        whole, paths = "▁" + text.replace(" ", "▁"), {}

        def walk(at, ids, logw):
            if at == len(whole):
                paths[tuple(ids)] = np.exp(logw)
            for end in range(at + 1, len(whole) + 1):
                if whole[at:end] in by_text:
                    i = by_text[whole[at:end]]
                    walk(end, [*ids, i], logw + v.log_weight[i])

        walk(0, [], 0.0)
        total, seen = sum(paths.values()), {}
        with np.errstate(over="ignore"):
            ends, ids = pieces.sample_batch(pieces.Lattices(v), [text] * n, np.arange(n).astype(np.uint64))
        for a, b in zip(ends[:-1], ends[1:]):
            seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
        assert set(seen) <= set(paths) and any("▁▁" in sp.id_to_piece(i) for p in seen for i in p)
        for p, w in paths.items():
            assert abs(seen.get(p, 0) / n - w / total) < 0.012


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(sizes):
    items = [(k, 0, b"xx" * n) for k, n in enumerate(sorted(sizes, reverse=True))]
    rows = packing.pack_shard(iter(items), 64)
    room: list[int] = []
    for _, _, ids in items:  # plain best fit: the least sufficient room
        n = len(ids) // 2
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(64 - n)
    assert sorted(64 - sum(len(p[2]) // 2 for p in r) for r in rows) == sorted(room)


def test_packing_is_lossless(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a", "  odd  space\n\n x ", "mot été " * 9000] + [" ".join(rng.choice(["the", "of", "zq", "été"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "text AS shard", "text AS pieces")
    tok = packing.Tokenizer(open(packing.RANKS, "rb").read())
    got: dict[int, dict[int, np.ndarray]] = {}
    rows = packing.pack(docs, length=256, shard_bytes=20_000).collect()
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256 and len(r.doc_ids) == r.n_segments
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
            got.setdefault(d, {})[p] = ids[a:b]
    for d, t in enumerate(texts):
        whole = np.concatenate([got[d][p] for p in sorted(got[d])])
        assert whole[-1] == packing.END_ID and tok.encoding.decode(whole[:-1].tolist()) == (t or "")
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_empty_texts(spark):
    """Shards are bounded by rows too: texts without a byte count PIECE_BYTES each."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' END AS text")
    rows = packing.pack(docs, shard_bytes=100 * packing.PIECE_BYTES).select("shard", "n_segments", "doc_ids").collect()
    by = Counter()
    for r in rows:
        by[r.shard] += r.n_segments
    assert sorted(d for r in rows for d in r.doc_ids) == list(range(4000)) and len(by) >= 38 and max(by.values()) < 200


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(5)
    words = ["the", "of", "and", "there", "onward", "reader", "stone", "in", "a", "letter"]
    clean = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(20, 300))) for _ in range(600)]
    junk = [" ".join(rng.choice(words).upper() + "!!" for _ in range(200)) for _ in range(60)] + [" | ".join(rng.choice(words) for _ in range(200)) for _ in range(60)]
    texts = clean + junk + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "text AS x", "doc_id AS score")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)] + [(None, 1, 0), (5, None, 0), (700, 0, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_quality(docs, labels).collect()}
    assert len(kept & set(range(600))) >= 594 and len(kept & set(range(600, 720))) <= 3
    assert quality.keep_quality(docs.limit(0), labels).count() == 0
    assert quality.keep_quality(docs, labels.limit(0)).count() == len(texts)
    assert quality.features("") == [0.0] * len(quality.FEATURES)


def _matrix(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    m = np.abs(rng.standard_normal((n, len(quality.FEATURES)))) * rng.uniform(0.1, 2, len(quality.FEATURES))
    m[:, 0] = rng.uniform(0, 1, n)
    m[:20] = 0  # empty texts
    m = m.astype(np.float32).astype(np.float64)
    return m, spark.createDataFrame([(r,) for r in m.tolist()], "x array<float>").repartition(5)


def test_quality_scale_against_plain_moments(spark):
    m, x = _matrix(spark, 1)
    scale = quality.Scale.of(x)
    near = m[:, :1]
    typical = (near * m).sum(0) / near.sum()
    drawn = m.copy()
    for i, f in enumerate(quality.FEATURES):
        if f in quality.CHANCE:
            drawn[:, i] = typical[i] + near[:, 0] * (m[:, i] - typical[i])
    assert np.allclose(scale.typical, typical) and np.allclose(scale.mean, drawn.mean(0)) and np.allclose(scale.sd, drawn.std(0), atol=1e-6)
    z = np.clip((drawn - drawn.mean(0)) / drawn.std(0), -6, 6)
    assert np.allclose(scale.design(m)[:, 1 : 1 + len(quality.FEATURES)], z, atol=1e-4)


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_quality_risk_and_gradient_against_brute_force(spark, prior):
    """The risk by its definition over all rows, its gradient by differences, and the branch where the negative part is below 0."""
    m, x = _matrix(spark, 2)
    scale = quality.Scale.of(x)
    positives = m[30:90]
    rng = np.random.default_rng(3)
    w = rng.standard_normal(1 + len(quality.FEATURES) + len(quality._SQUARED)) * 0.1
    w[0] = 2.0 if prior > 0.9 else -1.0

    def parts(w):
        loss = lambda g: np.log1p(np.exp(-g))
        g, gp = scale.design(m) @ w, scale.design(positives) @ w
        return prior * loss(gp).mean(), loss(-g).mean() - prior * loss(-gp).mean()

    positive, negative = parts(w)
    got = quality.evaluate(x, positives, scale, prior, w, 0.01)
    assert abs(got[0] - negative) < 1e-9 and abs(got[1] - (positive + max(0.0, negative) + 0.005 * (w[1:] ** 2).sum())) < 1e-9
    for i in (0, 1, 7, len(w) - 1):
        e = np.zeros(len(w))
        e[i] = 1e-5
        up, down = parts(w + e), parts(w - e)
        assert abs((up[0] - down[0]) / 2e-5 - got[2][i]) < 1e-6 and abs((up[1] - down[1]) / 2e-5 - got[3][i]) < 1e-6
    if prior > 0.9:
        fitted = quality.minimise(x, positives, scale, prior, 8, 0.01)
        assert quality.evaluate(x, positives, scale, prior, fitted, 0.01)[1] <= quality.evaluate(x, positives, scale, prior, np.zeros(len(w)), 0.01)[1]


def test_quality_minimum_against_gradient_descent(spark):
    m, x = _matrix(spark, 4)
    scale = quality.Scale.of(x)
    positives = m[m[:, 3] > np.median(m[:, 3])][:120]
    w = quality.minimise(x, positives, scale, 0.4, 12, 0.01)
    a, p = scale.design(m), scale.design(positives)

    def risk(v):
        negative = np.logaddexp(0, a @ v).mean() - 0.4 * np.logaddexp(0, p @ v).mean()
        return 0.4 * np.logaddexp(0, -(p @ v)).mean() + max(0.0, negative) + 0.005 * (v[1:] ** 2).sum(), negative

    v = np.zeros(len(w))
    for _ in range(6000):
        s, sp = 1 / (1 + np.exp(-(a @ v))), 1 / (1 + np.exp(-(p @ v)))
        grad = -0.4 * (p * (1 - sp)[:, None]).mean(0) + ((a * s[:, None]).mean(0) - 0.4 * (p * sp[:, None]).mean(0) if risk(v)[1] > 0 else 0)
        v = v - 0.05 * (grad + np.append(0.0, 0.01 * v[1:]))
    assert risk(w)[0] <= risk(v)[0] + 2e-3


def test_best_bin():
    """A mixture of known prior: scores of positives near 1, of the rest near 0."""
    rng = np.random.default_rng(5)
    edges = np.linspace(0, 1, 401)
    for prior in (0.2, 0.6, 0.9):
        positive, negative = rng.beta(6, 2, 20_000), rng.beta(2, 6, 20_000)
        n = int(20_000 * prior)
        every = np.histogram(np.concatenate([positive[:n], negative[: 20_000 - n]]), edges)[0]
        assert abs(quality.best_bin(every, np.histogram(rng.beta(6, 2, 5000), edges)[0]) - prior) < 0.06


def test_quality_clashing_names(spark):
    docs = spark.createDataFrame([(i, "plain words in a line. " * 30, "a", 0.5) for i in range(40)], "doc_id long, text string, features string, __score double")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = quality.keep_quality(docs, labels)
    assert got.columns == docs.columns and {r.features for r in got.collect()} <= {"a"}


def test_long_words(spark):
    """Texts without spaces: lossless, stable, and drawn from the same distribution as short ones."""
    texts = ["日本語テキスト" * 8000, "x" * 4000, "xyzab" * 3000, " " * 900 + "end", "ab" + "▁" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    again = {r.doc_id: r.ids for r in pieces.round_trip(docs.repartition(3)).collect()}
    assert all(r.lossless and again[i] == r.ids for i, r in got.items())
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), 0.3)
    n = 3000
    with np.errstate(over="ignore"):  # each of many repetitions in one long word against the same word many times
        _, alone = pieces.sample_batch(pieces.Lattices(v), ["日them"] * n, np.arange(n).astype(np.uint64))
        _, joined = pieces.sample_batch(pieces.Lattices(v), ["日them" * n], np.zeros(1, np.uint64))
    a, b = np.bincount(alone, minlength=v.size) / n, np.bincount(joined, minlength=v.size) / n
    common = np.flatnonzero(a > 0.05)
    assert len(common) > 3 and sum(abs(a[i] - b[i]) < 0.05 for i in common) >= len(common) - 2  # only each word's dummy space differs


def test_stretch_alone_is_the_same_filter():
    """Probabilities of a long stretch filtered by itself equal those of stretches filtered together."""
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), 0.5)
    words = ["x" * 60, "the" * 15]
    old = pieces.LONG
    with np.errstate(over="ignore"):
        a = pieces.Lattices(v)
        a.add(words)
        try:
            pieces.LONG = 2
            b = pieces.Lattices(v)
            b.add(words)
        finally:
            pieces.LONG = old
    for w in words:
        def chain(t, s):
            e = range(int(t.first[s]), int(t.first[s + 1]) if s + 1 < len(t.first) else len(t.cum))
            return [(int(t.piece[k]), round(float(t.cum[k]), 5)) for k in e]

        assert chain(a, a.end[w]) == chain(b, b.end[w])


def test_equal_hashes_are_compared_by_character():
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), 0.5)
    n = 3
    hs, xs, characters = v.tables[n]
    v.tables[n] = (hs, xs, characters + 1)  # as if each hash belonged to other characters
    with np.errstate(over="ignore"):
        cps = np.array([ord(c) for c in "▁them"], np.int64)
        _, lengths, _ = v.matches(cps, np.arange(5, 0, -1))
    assert n not in lengths.tolist()
