"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is a dummy prefix space and its words, each word with the whole run of spaces before it (U+2581 in the model), so
that pieces of several spaces are edges; no piece of the model has a space after another character. A word's lattice has
an edge for each vocabulary piece that matches; characters without a piece have one edge through the
UTF-8 byte pieces. A piece with rank r has the weight ((r + 10) * H) ** -sharpness. Forward filtering gives the total
weight of all paths to each position; backward sampling draws, from the end, an edge with the probability of all paths
through it. The draws come from a counter-based generator over (seed, row key, word, step), so a row's segmentation
doesn't depend on partitioning or batches.
"""

from __future__ import annotations

import math
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, slices, table

MODEL = os.path.join(os.environ.get("ROUTELOOM_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
SPACE, MASKED = 0x2581, 0x110000
#: Lattice states kept between batches, at most; beyond, the table starts anew.
KEPT_STATES = 2_000_000
#: Characters between two places that no piece crosses, up to which such stretches are filtered together, and
#: characters of a word from which its stretches are drawn each on its own.
LONG, LONG_WORD = 64, 256
#: Bytes of text that are segmented at once, about.
BATCH_TEXT = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r" +[^ ]*")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A number in 0..1 for each seed and step."""
    with np.errstate(over="ignore"):
        return (_mix(seed + _M * (np.uint64(2) * step + np.uint64(1))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


class Vocabulary:
    """Pieces of a serialised SentencePiece model with their weights, and lookup of many substrings at once."""

    def __init__(self, model: bytes, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.bytes_at = {}
        self.surface: list[bytes] = []
        texts, ids = [], []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:-1], 16)] = i
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace("▁", " ").encode())
                texts.append(piece)
                ids.append(i)
        if len(self.bytes_at) != 256:
            raise ValueError("the model has no byte pieces")
        order = sorted(range(len(ids)), key=lambda k: -sp.get_score(ids[k]))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        norm = math.log((len(ids) + 10) / 10) or 1.0
        self.log_weight = np.full(self.size, -sharpness * math.log((len(ids) + 10) * norm))
        self.log_weight[ids] = -sharpness * np.log((rank + 10) * norm)
        self.rare = float(self.log_weight.min()) * 3  # of a character through its bytes
        self.longest = max(map(len, texts))
        by_length: dict[int, tuple[list, list]] = {}
        for t, i in zip(texts, ids):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in t:
                    h = h * _M + np.uint64(ord(c))
            x = by_length.setdefault(len(t), ([], []))
            x[0].append(h)
            x[1].append(i)
        self.tables, self.maybe, self.begins = {}, np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        for n, (hs, xs) in by_length.items():
            hs, xs = np.array(hs, np.uint64), np.array(xs, np.int64)
            o = np.argsort(hs)
            if len(np.unique(hs)) < len(hs):
                raise ValueError("piece hashes collide")
            characters = np.frombuffer("".join(sp.id_to_piece(int(x)) for x in xs[o]).encode("utf-32-le"), np.uint32).astype(np.int64)
            self.tables[n] = (hs[o], xs[o], characters.reshape(-1, n))
            self.maybe[self._slot(hs, n)] = True
            h = np.zeros(len(hs), np.uint64)
            for k in range(1, n):  # the beginnings of longer pieces
                with np.errstate(over="ignore"):
                    h = h * _M + self.tables[n][2][:, k - 1].astype(np.uint64)
                self.begins[self._slot(h, k)] = True
        self.single, self.begins_with = np.full(MASKED + 1, -1, np.int32), np.zeros(MASKED + 1, bool)
        for n, (_, xs, characters) in self.tables.items():
            if n == 1:
                self.single[characters[:, 0]] = xs
            else:
                self.begins_with[characters[:, 0]] = True

    @staticmethod
    def _slot(h: np.ndarray, n: int) -> np.ndarray:
        return (_mix(h + np.uint64(n)) >> np.uint64(44)).astype(np.int64)

    def matches(self, cps: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in an array of code points; room: characters left in the word at each start."""
        one = self.single[cps]
        found = np.flatnonzero(one >= 0)
        starts, lengths, pieces = [found], [np.ones(len(found), np.int64)], [one[found].astype(np.int64)]
        at = np.flatnonzero(self.begins_with[cps])
        wide = cps.astype(np.uint64)
        h = wide[at]
        for n in range(2, self.longest + 1):
            ok = room[at] >= n
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * _M + wide[at + n - 1]
            slot = self._slot(h, n)
            if n in self.tables:
                hs, xs, characters = self.tables[n]
                some = np.flatnonzero(self.maybe[slot])
                pos = np.minimum(np.searchsorted(hs, h[some]), len(hs) - 1)
                hit = hs[pos] == h[some]
                some, pos = some[hit], pos[hit]
                for k in range(n):  # equal hashes aren't trusted: the characters decide
                    same = characters[pos, k] == cps[at[some] + k]
                    if not same.all():
                        some, pos = some[same], pos[same]
                starts.append(at[some])
                lengths.append(np.full(len(some), n))
                pieces.append(xs[pos])
            on = self.begins[slot]
            at, h = at[on], h[on]
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)


class Lattices:
    """Backward-sampling tables of words. A state is an end position in a word; its edges lie together, longest first,
    each with the cumulative probability, its piece and the state before it (-1 at the word's start)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self):
        self.end: dict[str, int] = {}  # of a long word -2 and less: its number
        self.long: list[tuple[np.ndarray, np.ndarray]] = []  # (end states, sizes) of the stretches of each long word
        none = np.zeros(0, np.int32)
        self.first, self.cum, self.piece, self.prev = none, none.astype(np.float32), none, none

    def add(self, words: list[str]):
        """Forward filtering of new words, all at once, in logarithms. A word has the spaces of its run but the first,
        which every word has. Words are cut where no piece crosses: what lies between two cuts is a lattice of its own,
        whose first states follow the last of the one before. Short ones go depth by depth together, long ones alone."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        offs = np.cumsum(lengths) - lengths
        full = np.full(int(lengths.sum()), SPACE, np.int64)
        inner = np.ones(len(full), bool)
        inner[offs] = False
        full[inner] = np.where(cps == SPACE, MASKED, np.where(cps == 32, SPACE, cps))
        size = len(full)
        at = np.arange(size)
        start, n, piece = self.v.matches(full, np.repeat(offs + lengths, lengths) - at)
        crossed = np.bincount(start + 1, minlength=size + 1) - np.bincount(start + n, minlength=size + 1)
        cut = np.cumsum(crossed)[:-1] == 0
        single = np.zeros(size, bool)
        single[start[n == 1]] = True
        bare = np.flatnonzero(~single)
        start = np.concatenate([start, bare])[::-1]
        n = np.concatenate([n, np.ones(len(bare), np.int64)])[::-1]
        logw = np.concatenate([self.v.log_weight[piece], np.full(len(bare), self.v.rare)])[::-1]
        piece = np.concatenate([piece, self.v.size + full[bare]])[::-1]
        # short segments by falling length: the states of one depth are those of the first segments, and depths follow
        # each other; then the long ones, a state for each character
        begins = np.flatnonzero(cut)
        sizes = np.diff(np.append(begins, size))
        order = np.argsort(np.where(sizes > LONG, 0, -sizes), kind="stable")
        short = int((sizes <= LONG).sum())
        falling = sizes[order[:short]]
        deep = int(falling[0]) if short else 0
        at_depth = np.searchsorted(-falling, -np.arange(1, deep + 1), side="right")
        level = np.append(0, np.cumsum(at_depth))
        long_sizes = sizes[order[short:]]
        long_base = int(level[-1]) + np.cumsum(long_sizes) - long_sizes
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        segment = np.cumsum(cut) - 1
        depth = at - begins[segment]
        place = rank[segment]
        state_of = np.where(place < short, level[np.minimum(depth, max(deep - 1, 0))] + place, 0)
        if len(long_sizes):
            late = place >= short
            state_of[late] = long_base[place[late] - short] + depth[late]
        state = state_of[start + n - 1]
        by_state = np.argsort(state * (self.v.longest + 1) - n)  # the longest first; no two are equal
        state, logw, piece, start = state[by_state], logw[by_state], piece[by_state], start[by_state]
        head = np.zeros(size, bool)
        head[offs] = True
        apart = np.repeat(lengths > LONG_WORD, lengths)  # stretches of long words end at their own start
        prev = np.where(head[start] | (apart[start] & (depth[start] == 0)), -1, state_of[start - 1])
        own = np.where(depth[start] == 0, size, prev)  # a segment's start has the weight 1, whatever lies before it
        counts = np.bincount(state, minlength=size)
        first = np.cumsum(counts) - counts
        log_alpha = np.zeros(size + 1)
        cum = np.empty(len(state), np.float32)
        bounds = np.append(first, len(state))
        for j in range(deep):
            lo, hi = int(level[j]), int(level[j + 1])
            a, b = int(bounds[lo]), int(bounds[hi])
            heads, many = first[lo:hi] - a, counts[lo:hi]
            x = logw[a:b] + log_alpha[own[a:b]]
            top = np.maximum.reduceat(x, heads)
            x = np.exp(x - np.repeat(top, many))
            total = np.add.reduceat(x, heads)
            log_alpha[lo:hi] = top + np.log(total)
            run = x / np.repeat(total, many)
            for r in range(1, int(many.max())):  # summed state by state, so that no other word matters
                more = heads[many > r] + r
                run[more] += run[more - 1]
            cum[a:b] = run
        for base, long in zip(long_base.tolist(), long_sizes.tolist()):
            self._alone(base, base + long, bounds, logw, own, cum)
        cum[np.append(first[1:], len(state)) - 1] = 2
        states, edges = len(self.first), len(self.cum)
        ends = states + state_of[offs + lengths - 1]
        for w in np.flatnonzero(lengths > LONG_WORD).tolist():
            a, b = np.searchsorted(begins, [offs[w], offs[w] + lengths[w]])
            ends[w] = -2 - len(self.long)
            self.long.append((states + state_of[begins[a:b] + sizes[a:b] - 1], sizes[a:b]))
        self.end.update(zip(words, ends.tolist()))
        self.first = np.concatenate([self.first, (edges + first).astype(np.int32)])
        self.cum = np.concatenate([self.cum, cum])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.prev = np.concatenate([self.prev, np.where(prev < 0, -1, states + prev).astype(np.int32)])

    @staticmethod
    def _alone(lo: int, hi: int, bounds: np.ndarray, logw: np.ndarray, own: np.ndarray, cum: np.ndarray):
        """Forward filtering of the states lo to hi of one long segment, in turn."""
        a = int(bounds[lo])
        cuts = (bounds[lo : hi + 1] - a).tolist()
        weights = logw[a : a + cuts[-1]].tolist()
        before = (own[a : a + cuts[-1]] - lo).tolist()
        alpha, out, exp, log = [0.0] * (hi - lo), [], math.exp, math.log
        for k in range(hi - lo):
            x = [weights[e] + (alpha[before[e]] if before[e] < k else 0.0) for e in range(cuts[k], cuts[k + 1])]
            top = max(x)
            x = [exp(y - top) for y in x]
            total = sum(x)
            alpha[k] = top + log(total)
            run = 0.0
            for y in x:
                run += y / total
                out.append(run)
        cum[a : a + len(out)] = out

    def ends(self, words: list[str]) -> np.ndarray:
        """The end states of words, or the numbers of long ones."""
        got = list(map(self.end.get, words))
        if None in got:
            if len(self.first) > KEPT_STATES:
                self.reset()
                got = [None] * len(words)
            self.add(list(dict.fromkeys(w for w, g in zip(words, got) if g is None)))
            got = [self.end[w] if g is None else g for w, g in zip(words, got)]
        return np.array(got, np.int64)

    def alone(self, end: int, size: int, seed: np.uint64) -> np.ndarray:
        """Pieces drawn for one stretch of many characters, from its end."""
        lo = end - size + 1
        a, b = int(self.first[lo]), int(self.first[end + 1]) if end + 1 < len(self.first) else len(self.cum)
        first, cum, prev = (self.first[lo : end + 1] - a).tolist(), self.cum[a:b].tolist(), (self.prev[a:b] - lo).tolist()
        k = np.arange(size, dtype=np.uint64)
        u = _uniform(seed, k).tolist()
        at, drawn = size - 1, []
        for x in u:
            e = first[at]
            while x >= cum[e]:
                e += 1
            drawn.append(e)
            at = prev[e]
            if at < 0:
                break
        return self.piece[a + np.array(drawn)]

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state, by a uniform number."""
        edge = self.first[state]
        beyond = np.flatnonzero(u >= self.cum[edge])
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[u[beyond] >= self.cum[edge[beyond]]]
        return edge


def split_words(text: str) -> list[str]:
    """The words of a text with the dummy prefix, each with the spaces before it but one."""
    if "  " not in text and not text.startswith(" "):
        return text.split(" ") if text else []
    return [w[1:] for w in _WORD.findall(" " + text)]


def sample_batch(lattices: Lattices, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the sampled segmentations of some texts; keys: a 64-bit number for each."""
    parts = [split_words(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    words = [w for p in parts for w in p]
    if not words:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    state = lattices.ends(words)
    within = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    seed = _mix(np.repeat(keys.astype(np.uint64), counts) + _M * (within.astype(np.uint64) + np.uint64(1)))
    size = np.zeros(len(words), np.int64)
    if state.min() < -1:  # the stretches of long words stand in their place
        units = [lattices.long[-2 - s] if s < -1 else (np.array([s]), np.zeros(1, np.int64)) for s in state.tolist()]
        many = np.fromiter((len(u[0]) for u in units), np.int64, len(units))
        state, size = (np.concatenate(x) for x in zip(*units))
        inside = np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many)
        seed = np.where(inside == 0, np.repeat(seed, many), _mix(np.repeat(seed, many) ^ _mix(inside.astype(np.uint64))))
        counts = np.add.reduceat(np.append(many, 0), np.append(0, np.cumsum(counts))[:-1]) * (counts > 0)
    steps = np.zeros(len(state), np.int64)
    alone = {i: lattices.alone(int(state[i]), int(size[i]), seed[i]) for i in np.flatnonzero(size > LONG).tolist()}
    for i, p in alone.items():
        steps[i] = len(p)
    active, got, k = np.flatnonzero(size <= LONG), [], 0
    state = state[active]
    while len(active):
        edge = lattices.draw(state, _uniform(seed[active], np.uint64(k)))
        got.append((active, lattices.piece[edge]))
        steps[active] += 1
        state = lattices.prev[edge]
        active, state = active[state >= 0], state[state >= 0]
        k += 1
    last = np.cumsum(steps)
    ids = np.empty(int(last[-1]), np.int64)
    for k, (rows, p) in enumerate(got):
        ids[last[rows] - 1 - k] = p
    for i, p in alone.items():
        ids[last[i] - len(p) : last[i]] = p[::-1]
    ends = np.append(0, last)[np.append(0, np.cumsum(counts))]
    rare = np.flatnonzero(ids >= lattices.v.size)
    if len(rare):
        ids, ends = _spell(lattices.v, ids, rare, ends)
    return ends, ids


def _spell(v: Vocabulary, ids: np.ndarray, rare: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece, as byte pieces."""
    spelt = [[v.bytes_at[b] for b in chr(SPACE if c == MASKED else c).encode()] for c in (ids[rare] - v.size).tolist()]
    size = np.ones(len(ids), np.int64)
    size[rare] = [len(s) for s in spelt]
    pos = np.cumsum(size)
    out = np.repeat(ids, size)
    for r, s in zip((pos - size)[rare].tolist(), spelt):
        out[r : r + len(s)] = s
    return out, np.append(0, pos)[ends]


def decode_ids(v_surface: list[bytes], ids: np.ndarray) -> str:
    """The text of a segmentation, without the dummy prefix."""
    return b"".join(map(v_surface.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[tuple, Vocabulary] = {}
_LATTICES: dict[tuple, Lattices] = {}


def _vocabulary(model: bytes, sharpness: float) -> Vocabulary:
    key = (hash(model), sharpness)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model, sharpness)
    return _LOADED[key]


def _rows(docs: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"))
    return rows, dict(rows.dtypes)["doc_id"]


def _segmented(lattices: Lattices, b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    texts = [t or "" for t in b.column(1).to_pylist()]
    with np.errstate(over="ignore"):
        ends, ids = sample_batch(lattices, texts, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
    return texts, ends, ids


def _lists(ends: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _lattices(model: bytes, sharpness: float) -> Lattices:
    """A worker's lattices, kept from task to task."""
    key = (hash(model), sharpness)
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattices(_vocabulary(model, sharpness))
    return _LATTICES[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, sharpness: float = 0.5, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text, ids): a sampled segmentation of each whole text. Null and empty texts have no ids. The draws
    depend on the seed, the id and the text's words alone: repeated rows agree, and rows with a null id share the key 42.
    The model (some 500 kB) is read by the driver and sent with the function."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        lattices = _lattices(model.value, sharpness)
        for b in slices(batches, 1, BATCH_TEXT):
            _, ends, ids = _segmented(lattices, b)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(ends, ids)], ["doc_id", "text", "ids"])

    rows, kind = _rows(docs, id_col, text_col, seed)
    return rows.mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decoded_column(ids_col: str, model_path: str = MODEL):
    """Text column of an id column; null stays null."""
    model = SparkSession.getActiveSession().sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        surface = _vocabulary(model.value, 0.5).surface
        return ids.map(lambda x: None if x is None else decode_ids(surface, x))

    return decode(F.col(ids_col))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, sharpness: float = 0.5, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless): the ids of each text, as `encode` gives them, and whether decoding them gives
    the text again (null: the empty text)."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        lattices = _lattices(model.value, sharpness)
        v = lattices.v
        for b in slices(batches, 1, BATCH_TEXT):
            texts, ends, ids = _segmented(lattices, b)
            same = [decode_ids(v.surface, ids[a:e]) == t for t, a, e in zip(texts, ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), _lists(ends, ids), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "lossless"])

    rows, kind = _rows(docs, id_col, text_col, seed)
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, lossless boolean")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
