"""Token ids packed into rows of a fixed length by best-fit decreasing.

Each document's ids (and an end id) are cut into pieces of at most `length`, which lose nothing. Pieces are dealt by
hash to shards of a bounded number of bytes; each shard takes its pieces by falling length and puts each into the row
with the least room that still holds it, found in a segment tree over the amounts of room.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, table

RANKS = os.path.join(os.environ.get("ROUTELOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID, LENGTH = 50256, 2048
#: UTF-8 bytes of text per shard, about; ids take at most two bytes for each.
SHARD_BYTES = 32 << 20
#: Bytes that a piece counts besides its text.
PIECE_BYTES = 200
#: Words whose ids a worker remembers, at most.
REMEMBERED = 600_000


#: White space besides the space and line feed.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _plain(text: str) -> bool:
    """Whether each space stands alone between two characters that aren't white space."""
    if text[:1] in ("", " ") or text[-1] == " " or "  " in text or "\n " in text or " \n" in text:
        return False
    return not _OTHER_SPACE.search(text)


class Tokenizer:
    """Byte-level BPE ids of whole texts as 16-bit values; words between single spaces are looked up when seen before.

    The pattern joins no characters across a single space between two others that aren't white space, so such a text's
    ids are those of its first word and of a space with each further word.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.sizes = np.zeros(max(pairs.values()) + 1, np.int64)
        for token, i in pairs.items():
            self.sizes[i] = len(token)
        self.seen: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint16)

    def __call__(self, text: str) -> bytes:
        if not _plain(text):
            return self._ids(text).tobytes()
        first, *rest = text.split(" ")
        out = list(map(self.seen.get, rest))
        if None in out:
            new = list(dict.fromkeys(w for w, ids in zip(rest, out) if ids is None))
            ids = self._ids(" " + " ".join(new))
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in new])) + 1
            raw, cuts = ids.tobytes(), [0, *(2 * ends).tolist()]
            known = {w: raw[a:b] for w, a, b in zip(new, cuts, cuts[1:])}
            out = [known[w] if ids is None else ids for w, ids in zip(rest, out)]
            if len(self.seen) < REMEMBERED:
                self.seen.update((w, ids) for w, ids in known.items() if len(w) <= 64)
        return b"".join([self._ids(first).tobytes(), *out])


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, piece, ids, turn): a row for each piece of a document, ids as little-endian 16-bit values, the last ending
    in END_ID. turn counts the task's pieces in 4,096s, so that equal rows can be told apart when they are dealt."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        tok = Tokenizer(ranks.value)
        end, seen = np.uint16(END_ID).tobytes(), 0
        for b in batches:
            rows, pieces, ids = [], [], []
            for k, t in enumerate(b.column(1)):
                got = tok(t.as_py() or "") + end
                cut = [got[i : i + 2 * length] for i in range(0, len(got), 2 * length)]
                rows += [k] * len(cut)
                pieces += range(len(cut))
                ids += cut
            turns = np.arange(seen, seen + len(rows), dtype=np.int64) >> 12
            seen += len(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), pa.array(ids, pa.binary()), pa.array(turns)], ["doc_id", "piece", "ids", "turn"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, ids binary, turn long")


class Rooms:
    """Rows by room left: a segment tree whose leaf r counts the open rows with room r; `best` finds the least room >= need."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int):
        self.rows.setdefault(room, []).append(row)
        i = self.base + room
        while i:
            self.count[i] += 1
            i >>= 1

    def best(self, need: int) -> tuple[int, int] | None:
        i, n = self.base + need, self.count
        if not n[i]:
            while i > 1 and (i & 1 or not n[i + 1]):  # up to the first right neighbour with rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if n[2 * i] else 2 * i + 1
        room = i - self.base
        row = self.rows[room].pop()
        while i:
            n[i] -= 1
            i >>= 1
        return room, row


def pack_shard(pieces, length: int):
    """Rows of (doc_id, piece, ids), by falling length -> lists of pieces, in order of their first."""
    rooms, rows = Rooms(length), []
    for p in pieces:
        n = len(p[2]) // 2
        found = rooms.best(n)
        if found is None:
            rows.append([p])
            room, row = length, len(rows) - 1
        else:
            room, row = found
            rows[row].append(p)
        if room > n:
            rooms.put(room - n, row)
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks_path: str = RANKS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per packed row: shard, row, n_tokens, input_ids and position_ids (little-endian 16-bit, `length` long,
    padded by END_ID and 0), cu_seqlens (0, then the end of each segment), doc_ids and pieces of the segments.

    Null and empty texts are a piece with the end id alone. Every row of docs is packed, repeated ids too; pieces of one
    document may lie in several rows, and putting them together by number gives its ids again.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # a piece is held as a tuple, whatever its length: tables of short texts get more shards
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + PIECE_BYTES)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    pieces = tokenized_pieces(docs, id_col, text_col, length, ranks_path)
    key = F.xxhash64("doc_id", "piece", "ids", "turn", F.spark_partition_id())  # repeated rows go to many shards
    dealt = pieces.withColumn("key", key).repartition(shards, "key").select("doc_id", "piece", "ids").sortWithinPartitions(F.octet_length("ids").desc(), "doc_id", "piece", "ids")
    kind = dict(docs.dtypes)[id_col]
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    ints = pa.list_(pa.int32())

    def run(batches):
        shard, rows = 0, []

        def stream():
            nonlocal shard
            for b in batches:
                shard = b.column(3)[0].as_py() if b.num_rows else shard
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

        rows = pack_shard(stream(), length)
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            ids = np.full((len(some), length), END_ID, "<u2")
            pos = np.zeros((len(some), length), "<u2")
            ends = []
            for i, row in enumerate(some):
                sizes = [len(p[2]) // 2 for p in row]
                got = np.frombuffer(b"".join(p[2] for p in row), "<u2")
                ids[i, : len(got)] = got
                pos[i, : len(got)] = np.concatenate([np.arange(n) for n in sizes])
                ends.append([0, *np.cumsum(sizes).tolist()])
            yield pa.RecordBatch.from_arrays([
                pa.array([shard] * len(some), pa.int32()), pa.array(range(at, at + len(some)), pa.int32()),
                pa.array([e[-1] for e in ends], pa.int32()), pa.array([len(r) for r in some], pa.int32()),
                pa.array([r.tobytes() for r in ids], pa.binary()), pa.array(ends, ints), pa.array([r.tobytes() for r in pos], pa.binary()),
                pa.array([[p[0] for p in r] for r in some], pa.list_(doc_type)), pa.array([[p[1] for p in r] for r in some], ints),
            ], ["shard", "row", "n_tokens", "n_segments", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "pieces"])

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(docs.schema[id_col].dataType)
    return dealt.mapInArrow(run, f"shard int, row int, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, pieces array<int>")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
