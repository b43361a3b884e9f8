"""Media columns: GIF files, written and read with LZW code streams, palettes, disposal, transparency and frame times.

`encode_many` stores bytes losslessly as 8-bit samples of animated GIFs; `decode_many` reads any GIF87a/89a files into
their index samples and their timed frames, composed on the canvas, each with a 64-bin colour histogram. Code streams
are written and expanded many at once, as arrays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, slices, table

#: Samples are laid out in rows of 24; a frame of the stored form has up to 384 rows (16 units of 576 bytes).
UNIT, WIDTH, ROWS = 576, 24, 384
DELAY_MS = 100
#: Bytes after which the writer clears its table, and blocks that are written together, at most.
BLOCK, LANES = 1152, 2048
#: Codes that the reader takes from each stream in a round.
AHEAD = 1024
#: Pixels of a canvas or a frame, at most; a file that claims more has `error` set.
MAX_PIXELS = 1 << 25
#: Pixels of frames that are written or expanded together, about.
GROUP_PIXELS = 1 << 21
GREY = bytes(v for i in range(256) for v in (i, i, i))
FRAMES = "array<struct<frame:int,start_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,transparent:int,interlaced:boolean,local_palette:boolean,xxh64:string,histogram:array<int>>>"
DECODED = f"struct<width:int,height:int,loops:int,samples:binary,frames:{FRAMES},histogram:array<long>,error:string>"


@lru_cache(16)
def _widths(min_code: int, n: int) -> np.ndarray:
    """Bits of the i-th code after a clear code: the reader adds an entry for each code but the first, up to 4096."""
    size = (1 << min_code) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(np.minimum(size, 4095) + 1)).astype(np.int64), min_code + 1, 12)


# ---------------------------------------------------------------- LZW, many streams at once


def _parse(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the greedy parse of each block, all blocks a byte at a time.

    A block's known strings lie in a hash table of one place each; a string whose place is taken anew is forgotten by
    the writer alone, which makes codes fewer bytes long but never wrong.
    """
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    order = np.argsort(-sizes, kind="stable")
    n, deep = len(blocks), int(sizes.max())
    there = np.arange(deep) < sizes[order, None]
    rows = np.zeros((n, deep), np.uint8)
    rows[there] = np.frombuffer(b"".join([blocks[k] for k in order]), np.uint8)
    columns = np.ascontiguousarray(rows.T).astype(np.uint32)
    active = there.sum(0)
    bits = (BLOCK - 1).bit_length()
    known = np.full(n << bits, 0xFFFFFFFF, np.uint32)
    base, multiplier, shift = np.arange(n) << bits, np.uint32(2654435761), np.uint32(32 - bits)
    eight, twelve, low, one = np.uint32(8), np.uint32(12), np.uint32(4095), np.uint32(1)
    out, written = np.zeros((deep + 1, n), np.uint16), np.zeros((deep + 1, n), bool)
    w, new, upto = columns[0], np.full(n, 258, np.uint32), n
    for t in range(1, deep):
        m = int(active[t])
        if m < upto:
            out[t, m:upto], written[t, m:upto] = w[m:], True
            w, new, base, upto = w[:m], new[:m], base[:m], m
        c = columns[t, :m]
        key = (w << eight) | c
        place = ((key * multiplier) >> shift) + base
        entry = known[place]
        miss = (entry >> twelve) != key
        out[t, :m], written[t, :m] = w, miss
        some = np.flatnonzero(miss)
        known[place[some]] = (key[some] << twelve) | new[some]
        w = entry & low
        w[some] = c[some]
        new[some] += one
    out[deep, :upto], written[deep, :upto] = w, True
    found, mask = np.ascontiguousarray(out.T), np.ascontiguousarray(written.T)
    counts = np.empty(n, np.int64)
    counts[order] = mask.sum(1)
    flat = found[mask]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    starts = np.cumsum(counts[order]) - counts[order]
    return flat[_ranges(starts[back], counts)], counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at starts and hold counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def lzw_compress_many(samples: list[bytes]) -> list[bytes]:
    """GIF's LZW code streams of 8-bit samples: a clear code first and again after every BLOCK bytes."""
    out, some, size = [], [], 0
    for s in samples:
        if some and size + len(s) > GROUP_PIXELS:
            out += _compress(some)
            some, size = [], 0
        some.append(s)
        size += len(s)
    return out + (_compress(some) if some else [])


def _compress(samples: list[bytes]) -> list[bytes]:
    blocks, owner = [], []
    for k, s in enumerate(samples):
        cut = [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]
        blocks += cut
        owner += [k] * len(cut)
    codes, counts = [], []
    for at in range(0, len(blocks), LANES):
        c, n = _parse(blocks[at : at + LANES])
        codes.append(c)
        counts.append(n)
    owner = np.array(owner, np.int64)
    counts = np.concatenate([*counts, np.zeros(0, np.int64)])
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    # each block's codes and its clear or end code; before the first block of a stream a clear code of nine bits
    width_at = _widths(8, BLOCK + 2)
    with_stop = counts + 1
    ends = np.cumsum(with_stop)
    all_codes = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    stop = np.zeros(len(all_codes), bool)
    stop[ends - 1] = True
    all_codes[stop] = np.where(last, 257, 256)
    all_codes[~stop] = np.concatenate([*codes, np.zeros(0, np.uint16)])
    widths = width_at[_ranges(np.zeros(len(counts), np.int64), with_stop)]
    block_bits = np.add.reduceat(widths, ends - with_stop) if len(counts) else np.zeros(0, np.int64)
    stream_bits = 9 + np.bincount(owner, block_bits, len(samples)).astype(np.int64)
    empty = np.bincount(owner, minlength=len(samples)) == 0
    stream_bits[empty] += 9  # clear and end code alone
    sizes = (stream_bits + 7) // 8
    begins = np.cumsum(sizes) - sizes
    raw = np.zeros(int(sizes.sum()) + 4, np.uint8)
    inside = np.cumsum(widths) - widths
    base = np.cumsum(block_bits) - block_bits  # bits before each block, over all streams
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    shift = (8 * begins + 9)[owner[first]] - base[first]
    at = inside + np.repeat(np.repeat(shift, np.diff(np.append(np.flatnonzero(first), len(owner)))), with_stop)
    begin = begins.tolist()
    at = np.concatenate([at, 8 * begins, 8 * begins[empty] + 9])
    all_codes = np.concatenate([all_codes, np.full(len(samples), 256), np.full(int(empty.sum()), 257)])
    order = np.argsort(at, kind="stable")
    at, value = at[order], all_codes[order] << (at[order] & 7)
    byte = at >> 3
    for k in range(3):  # codes have nine bits at least, so no two begin in the same byte
        raw[byte + k] |= ((value >> (8 * k)) & 255).astype(np.uint8)
    data = raw.tobytes()
    return [data[a : a + n] for a, n in zip(begin, sizes.tolist())]


def lzw_compress(data: bytes) -> bytes:
    return lzw_compress_many([data])[0]


@lru_cache(16)
def _layout(min_code: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the i-th code after a clear code, and of those before it, for i below 4200 + AHEAD; further ones have 12."""
    width = _widths(min_code, 4200 + AHEAD)
    return width, np.cumsum(width) - width


def _unpack(streams: list[bytes], min_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, segment, code) of all codes but clear and end codes, in order; a segment is what follows a clear code."""
    raw = np.frombuffer(b"".join([s + b"\0\0\0" for s in streams]), np.uint8).astype(np.uint32)
    three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    begin = 8 * (np.cumsum(sizes + 3) - sizes - 3)
    got: list[tuple] = []
    for m in sorted(set(min_codes.tolist())):
        width_at, before = _layout(m)
        live = np.flatnonzero(min_codes == m)
        # where the next code and the stream's end stand, codes read since the last clear code, and clear codes so far
        at, end, read, segment = begin[live], (begin + 8 * sizes)[live], np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        ahead = 1  # nearly all streams begin with a clear code
        while len(live):
            since = np.minimum(read, 4200)
            room = np.clip((end - at) // (m + 1), 0, ahead - 1) + 1  # one more than can be whole, at least
            heads = np.cumsum(room) - room
            local = np.arange(int(room.sum())) - np.repeat(heads, room)
            i = local + np.repeat(since, room) if since.any() else local
            pos = before[i] + np.repeat(at - before[since], room)
            width = width_at[i]
            code = (three[np.minimum(pos >> 3, len(three) - 1)] >> (pos & 7).astype(np.uint32)).astype(np.int64) & ((1 << width) - 1)
            stops = np.flatnonzero((code >> 1 == 1 << (m - 1)) | (pos + width > np.repeat(end, room)))
            first = np.searchsorted(stops, heads)
            place = np.append(stops, len(code))[first]
            none = place >= heads + room  # no stop among these codes: go on behind them
            stop = np.where(none, room, place - heads)
            keep = local < np.repeat(stop, room)
            got.append((np.repeat(live, stop), np.repeat(segment, stop), code[keep]))
            place = np.where(none, heads + room - 1, place)
            after = pos[place] + width[place]
            go = none | ((after <= end) & (code[place] == 1 << m))
            live, at, end, read, segment = live[go], after[go], end[go], np.where(none, since + room, 0)[go], (segment + ~none)[go]
            ahead = AHEAD
    stream, seg, code = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
    order = np.argsort(stream, kind="stable")
    return stream[order], seg[order], code[order]


def lzw_expand_many(streams: list[bytes], min_codes: list[int], limits: list[int]) -> list[bytes | None]:
    """Samples of each code stream, at most its limit; None where a code isn't known yet. Deferred clear codes and
    streams without an end code are read too.

    An entry is the output where its first code stands and one sample more. So a code's length is one more than that of
    the code its entry began with, and each sample comes from an earlier one: both chains are followed by doubling.
    """
    if not streams:
        return []
    roots, limit = np.array(min_codes, np.int64), np.array(limits, np.int64)
    stream, seg, code = _unpack(streams, roots)
    n = len(code)
    me = np.arange(n)
    new = np.append(True, (stream[1:] != stream[:-1]) | (seg[1:] != seg[:-1]))[:n]
    head = np.maximum.accumulate(np.where(new, me, 0))
    clear = (1 << roots)[stream]
    entry = code - clear - 2
    literal = code < clear
    bad = ~literal & (entry >= me - head)
    wrong = np.zeros(len(streams), bool)
    wrong[stream[bad]] = True
    literal |= wrong[stream]
    parent = np.where(literal, me, head + entry)
    length, up = np.where(literal, 0, 1), parent
    while True:
        above = up[up]
        length = length + length[up]
        if (above == up).all():
            break
        up = above
    length += 1
    starts = np.searchsorted(stream, np.arange(len(streams)))
    before = np.append(0, np.cumsum(length))
    offset = before[:-1] - before[starts][stream]
    length = np.clip(limit[stream] - offset, 0, length)
    length[wrong[stream]] = 0
    ends = np.cumsum(length)
    offset = ends - length
    total = int(ends[-1]) if n else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    source = np.arange(total, dtype=kind) + np.repeat((offset[parent] - offset).astype(kind), length)
    value = np.zeros(total, np.uint8)
    seen = literal & (length > 0)
    value[offset[seen]] = code[seen]
    for _ in range((2 * int(length.max(initial=0))).bit_length()):  # a chain has no more than a code's samples and an entry's last
        source = source[source]
    data = value[source].tobytes()
    cut = np.append(offset, total)[np.append(starts, n)].tolist()
    return [None if w else data[a:b] for w, a, b in zip(wrong.tolist(), cut, cut[1:])]


def lzw_expand(stream: bytes, min_code: int, limit: int) -> bytes:
    got = lzw_expand_many([stream], [min_code], [limit])[0]
    if got is None:
        raise ValueError("bad LZW code")
    return got


# ---------------------------------------------------------------- files


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Animated GIFs whose index samples, frame after frame, are the payloads (positive multiples of 24 bytes)."""
    if any(not p or len(p) % WIDTH for p in payloads):
        raise ValueError("the payload must be a positive multiple of 24 bytes")
    size = WIDTH * ROWS
    parts = [[p[i : i + size] for i in range(0, len(p), size)] for p in payloads]
    streams = iter(lzw_compress_many([x for p in parts for x in p]))
    files = []
    for p in parts:
        out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(p[0]) // WIDTH, 0xF7, 0, 0), GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
        for x in p:
            out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_MS // 10, 0) + b"\0\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(x) // WIDTH, 0) + b"\x08")
            stream = next(streams)
            for i in range(0, len(stream), 255):
                block = stream[i : i + 255]
                out += [bytes((len(block),)), block]
            out.append(b"\0")
        out.append(b"\x3b")
        files.append(b"".join(out))
    return files


def encode_gif(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def read_frames(data: bytes) -> tuple[int, int, int, list[dict]]:
    """(width, height, loops, frames) of a file; frames in file order, their code streams as they stand."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MAX_PIXELS:
        raise ValueError("the canvas is too large")
    at, palette, frames = 13, None, []
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        palette, at = data[at : at + n], at + n
    control, loops = (0, 0, -1), 1
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                f, delay, index = struct.unpack("<BHB", body[:4])
                control = ((f >> 2) & 7, delay * 10, index if f & 1 else -1)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                loops = struct.unpack("<H", body[12:14])[0]
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack("<HHHHB", data[at : at + 9])
            at += 9
            if w * h > MAX_PIXELS:
                raise ValueError("a frame is too large")
            colours, local = palette, bool(f & 0x80)
            if local:
                n = 3 * (2 << (f & 7))
                colours, at = data[at : at + n], at + n
            min_code = data[at]
            if not 2 <= min_code <= 8:
                raise ValueError("bad LZW code size")
            stream, at = _blocks(data, at + 1)
            frames.append(dict(left=left, top=top, w=w, h=h, min_code=min_code, stream=stream, colours=GREY if colours is None else colours, local=local, interlaced=bool(f & 0x40), disposal=control[0], delay=control[1], transparent=control[2]))
            control = (0, 0, -1)
        else:
            raise ValueError("unknown block")
    return width, height, loops, frames


@lru_cache(64)
def _palette(colours: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 256 colours as opaque 32-bit pixels, black where the palette is short, and their bins of 4 x 4 x 4."""
    rgba = np.zeros((256, 4), np.uint8)
    rgb = np.frombuffer(colours, np.uint8).reshape(-1, 3)
    rgba[: len(rgb), :3] = rgb
    rgba[:, 3] = 255
    return rgba.view("<u4").ravel(), colour_bins(rgba)


def colour_bins(colours: np.ndarray) -> np.ndarray:
    """Bin of each colour among 4 x 4 x 4 of red, green and blue."""
    c = colours >> 6
    return c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2]


def histogram64(canvas: np.ndarray) -> np.ndarray:
    """Counts of visible pixels in colour_bins."""
    flat = np.ascontiguousarray(canvas).view(np.uint8).reshape(-1, 4)
    return np.bincount(colour_bins(flat)[flat[:, 3] > 0], minlength=64)


def _compose(width: int, height: int, loops: int, frames: list[dict], samples: list[bytes]) -> dict:
    canvas = np.zeros((height, width), "<u4")
    out, stored, total, clock = [], [], np.zeros(64, np.int64), 0
    for f, raw in zip(frames, samples):
        w, h, top, left = f["w"], f["h"], f["top"], f["left"]
        index = np.frombuffer(raw, np.uint8).reshape(h, w)
        if f["interlaced"]:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(index)
            plain[order] = index
            index, raw = plain, plain.tobytes()
        pixels, bins_of = _palette(f["colours"])
        shown = index[: max(0, height - top), : max(0, width - left)]
        if shown.shape == canvas.shape and f["transparent"] < 0:  # all of the canvas is this frame
            before = canvas if f["disposal"] == 3 else None
            canvas = pixels[shown]
            bins = np.bincount(bins_of, np.bincount(shown.ravel(), minlength=256), 64).astype(np.int64)
            area = (slice(None), slice(None))
        else:
            area = (slice(top, top + shown.shape[0]), slice(left, left + shown.shape[1]))
            before = canvas[area].copy() if f["disposal"] == 3 else None
            canvas[area] = pixels[shown] if f["transparent"] < 0 else np.where(shown != f["transparent"], pixels[shown], canvas[area])
            bins = histogram64(canvas)
        total += bins
        out.append((len(out), clock, f["delay"], left, top, w, h, f["disposal"], f["transparent"], f["interlaced"], f["local"], xxhash.xxh64_hexdigest(canvas), bins.tolist()))
        stored.append(raw)
        clock += f["delay"]
        if f["disposal"] == 2:
            canvas[area] = 0
        elif before is not None:
            canvas[area] = before
    return dict(width=width, height=height, loops=loops, samples=b"".join(stored), frames=out, histogram=total.tolist(), error=None)


def _failed(why: Exception) -> dict:
    return dict(width=None, height=None, loops=None, samples=None, frames=None, histogram=None, error=str(why) or type(why).__name__)


def decode_many(files: list[bytes]) -> list[dict]:
    """Fields of DECODED for each file: samples are the index values of all frames, in order; each frame's hash and
    histogram are of the RGBA canvas while it is shown. Disposal 2 clears the frame's area, 3 brings back what was
    there before. Code streams of many files are expanded together."""
    out: list[dict] = []
    group: list[tuple] = []

    def flush():
        streams = [(f["stream"], f["min_code"], f["w"] * f["h"]) for x in group if not isinstance(x, Exception) for f in x[3]]
        got = iter(lzw_expand_many(*map(list, zip(*streams))) if streams else [])
        for x in group:
            if isinstance(x, Exception):
                out.append(_failed(x))
                continue
            samples = [next(got) for _ in x[3]]
            if any(s is None for s in samples):
                out.append(_failed(ValueError("bad LZW code")))
            elif any(len(s) < f["w"] * f["h"] for s, f in zip(samples, x[3])):
                out.append(_failed(ValueError("too few samples")))
            else:
                out.append(_compose(*x, samples))
        group.clear()

    pixels = 0
    for data in files:
        try:
            found = read_frames(data)
        except (ValueError, IndexError, struct.error) as e:
            group.append(e)
            continue
        own = sum(f["w"] * f["h"] for f in found[3])
        if pixels and pixels + own > GROUP_PIXELS:
            flush()
            pixels = 0
        group.append(found)
        pixels += own
    flush()
    return out


def decode_gif(data: bytes) -> dict:
    got = decode_many([data])[0]
    if got["error"]:
        raise ValueError(got["error"])
    return got


def padded(text: str) -> bytes:
    """UTF-8 with bytes 255, which UTF-8 never has, up to a positive multiple of 576."""
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def gif_column(text_col: str) -> Column:
    """Binary column: the text's padded payload as a GIF. Null texts count as empty; equal texts give equal files."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_many([padded(t) for t in texts]), index=texts.index, dtype=object)

    return encode(F.coalesce(F.col(text_col), F.lit("")))


def decoded_column(media_col: str) -> Column:
    """DECODED struct of a binary column. Null stays null; a file that isn't a valid GIF, or whose canvas or a frame has
    more than MAX_PIXELS, has only `error` set."""

    @F.pandas_udf(DECODED)
    def decode(media: pd.Series) -> pd.DataFrame:
        rows = decode_many([b"" if m is None else bytes(m) for m in media])
        fields = ["width", "height", "loops", "samples", "frames", "histogram", "error"]
        return pd.DataFrame(rows, columns=fields).astype({"width": "Int32", "height": "Int32", "loops": "Int32"})

    return F.when(F.col(media_col).isNotNull(), decode(F.col(media_col)))


def gif_frames(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame: id, then the fields of FRAMES. Rows whose media is null or invalid, or has no frame, give none."""
    d = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).select("id", decoded_column("media").alias("gif"))
    return d.select("id", F.explode("gif.frames").alias("f")).select("id", "f.*")


TIMED = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("xxh64", pa.string()), ("histogram", pa.list_(pa.int32()))]))
_STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<frame:int,start_ms:long,delay_ms:int,xxh64:string,histogram:array<int>>>"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs, repeated ones too: its text's payload stored as a GIF, read back from the stored bytes.

    doc_id; of what was read back the unpadded and whole length, SHA-256 and CRC-32 of the last 32 bytes; length and
    SHA-256 of the file; frames with their times, hashes and colour histograms, and a summary of these as `feature`.
    Null texts count as empty. One pass in each task, a few MB of frames at a time.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in slices(batches, 1):
            media = encode_many([padded(t or "") for t in b.column(1).to_pylist()])
            back = decode_many(media)
            samples = [d["samples"] for d in back]
            last = [d["frames"][-1] for d in back]
            feature = [f"frames={len(d['frames'])};ms={f[1] + f[2]};hist={','.join(map(str, d['histogram']))}" for d, f in zip(back, last)]
            timed = [[dict(frame=f[0], start_ms=f[1], delay_ms=f[2], xxh64=f[11], histogram=f[12]) for f in d["frames"]] for d in back]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s.rstrip(b"\xff")) for s in samples], pa.int64()), pa.array([len(s) for s in samples], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples], pa.string()), pa.array([zlib.crc32(s[-32:]) for s in samples], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array(feature, pa.string()), pa.array(timed, TIMED),
            ], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {_STORED}")


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))
