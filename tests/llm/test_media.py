from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert gif.lzw_expand(gif.lzw_compress(data), 8, len(data)) == data


def test_lzw_full_table_and_long_input():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), b"ab" * 40_000, b"\0" * 50_000):
        assert gif.lzw_expand(gif.lzw_compress(data), 8, len(data)) == data


def test_deferred_clear():
    """A stream that goes on with 12-bit codes after its table is full, as some writers do."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 9000).astype(np.uint8).tobytes()
    known, codes, w = {bytes([i]): i for i in range(256)}, [256], b""
    for c in data:
        x = w + bytes([c])
        if x in known:
            w = x
            continue
        codes.append(known[w])
        if len(known) + 2 < 4096:
            known[x] = len(known) + 2
        w = bytes([c])
    codes += [known[w], 257]
    widths = np.append(9, gif._widths(8, len(codes) - 1))
    bits = "".join(format(c, f"0{n}b")[::-1] for c, n in zip(codes, widths))
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert gif.lzw_expand(stream, 8, len(data)) == data


@pytest.mark.parametrize("text", ["", "a", "é" * 300, "x" * 576, "word " * 40_000])
def test_payload_round_trip(text):
    p = gif.padded(text)
    d = gif.decode_gif(gif.encode_gif(p))
    assert p and len(p) % 576 == 0 and d["samples"] == p and sum(d["histogram"]) == sum(sum(f[-1]) for f in d["frames"])
    assert d["frames"][-1][1] == 100 * (len(d["frames"]) - 1)


def frame(index, left=0, top=0, disposal=0, transparent=None, delay=5, interlaced=False, palette=None):
    h, w = index.shape
    rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(h)
    flags = (0x40 if interlaced else 0) | (0x80 | 1 if palette is not None else 0)
    stream = gif.lzw_compress(index[rows].astype(np.uint8).tobytes())
    blocks = b"".join(bytes([len(x)]) + x for x in (stream[i : i + 255] for i in range(0, len(stream), 255)))
    return (
        b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0\x2c"
        + struct.pack("<HHHHB", left, top, w, h, flags) + (bytes(palette) if palette is not None else b"") + b"\x08" + blocks + b"\0"
    )


def image(width, height, *frames):
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + gif.GREY + b"".join(frames) + b"\x3b"


def test_disposal_transparency_and_palettes():
    full, patch = np.full((16, 16), 200), np.full((4, 4), 10)
    patch[0, 0] = 7
    d = gif.decode_gif(image(16, 16, frame(full, interlaced=True), frame(patch, 2, 2, 3, 7), frame(patch, 8, 8, 2), frame(patch % 4, 0, 0, 0, palette=[255, 0, 0] * 4)))
    hist = [np.array(f[-1]) for f in d["frames"]]
    assert [h.sum() for h in hist] == [256, 256, 256, 240]  # disposal 2 left a hole of 16
    grey = lambda v: (v >> 6) * 21
    assert hist[0][grey(200)] == 256
    assert hist[1][grey(10)] == 15 and hist[1][grey(200)] == 241  # one pixel is transparent
    assert hist[2][grey(10)] == 16 and hist[2][grey(200)] == 240  # the patch before was taken back
    assert hist[3][3 << 4] == 16 and d["frames"][3][10]


def test_query_and_bad_media(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 3000, "x"), (3, "word " * 3000, "y"), (None, "é", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = docs.select("doc_id", gif.gif_column("text").alias("m")).select("doc_id", "m", gif.decoded_column("m").alias("g")).select("doc_id", "g.*").collect()
    assert sorted(hashlib.sha256(r.samples).hexdigest() for r in got) == sorted(hashlib.sha256(gif.padded(t or "")).hexdigest() for _, t, _ in rows)
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"GIF89a"), (4, gif.encode_gif(b"a" * 24)[:-6]), (5, gif.encode_gif(b"a" * 24))], "id long, media binary")
    found = {r.id: r.g for r in bad.select("id", gif.decoded_column("media").alias("g")).collect()}
    assert found[1] is None and found[2].error and found[3].error and not found[5].error
    assert gif.gif_frames(bad, "id", "media").where("id = 5").count() == 1
    assert docs.limit(0).select(gif.gif_column("text").alias("m")).count() == 0


def plain_reader(data):
    """Samples of all frames of a GIF, read bit by bit with plain lists: independent of the module."""
    at = 13 + (3 * (2 << (data[10] & 7)) if data[10] & 0x80 else 0)
    out = b""
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            at += 10 + (3 * (2 << (data[at + 9] & 7)) if data[at + 9] & 0x80 else 0)
            low, body, k = data[at], b"", at + 1
            while data[k]:
                body += data[k + 1 : k + 1 + data[k]]
                k += 1 + data[k]
            bits, pos = int.from_bytes(body, "little"), 0
            clear, end, width, strings, before = 1 << low, (1 << low) + 1, low + 1, [], None
            while True:
                code = bits >> pos & ((1 << width) - 1)
                pos += width
                if code == end:
                    break
                if code == clear:
                    strings, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], low + 1, None
                    continue
                now = strings[code] if code < len(strings) else before + before[:1]
                if before is not None and len(strings) < 4096:
                    strings.append(before + now[:1])
                width = min(12, max(width, len(strings).bit_length()))
                out, before = out + now, now
            at += 1
        while data[at]:
            at += 1 + data[at]
        at += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "no \u00e9 " * 700, "x" * 9300, "the quick brown fox " * 900, "".join(map(chr, range(1, 3000)))])
def test_files_read_by_a_plain_reader(text):
    p = gif.padded(text)
    assert plain_reader(gif.encode_gif(p)) == p


def test_many_streams_are_those_of_each_alone():
    rng = np.random.default_rng(3)
    many = [rng.integers(0, k + 1, int(n)).astype(np.uint8).tobytes() for k, n in zip(rng.integers(0, 255, 120), rng.integers(0, 6000, 120))]
    streams = gif.lzw_compress_many(many)
    assert streams == [gif.lzw_compress(x) for x in many]
    assert gif.lzw_expand_many(streams, [8] * len(many), [len(x) for x in many]) == many
    assert gif.lzw_expand_many(streams, [8] * len(many), [7] * len(many)) == [x[:7] for x in many]
    broken = [streams[0], b"\x00\xff\xff\xff", streams[1], b"", streams[2][:-4]]
    got = gif.lzw_expand_many(broken, [8] * 5, [10_000] * 5)
    assert got[0] == many[0] and got[1] is None and got[2] == many[1] and got[3] == b"" and many[2].startswith(got[4])


def test_oversize_files_have_an_error(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    frame_ = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x00\x3b"
    got = spark.createDataFrame([(huge,), (frame_,)], "m binary").select(gif.decoded_column("m").alias("g")).select("g.*").collect()
    assert all("too large" in r.error and r.frames is None for r in got)


def test_stored_texts(spark):
    texts = [None, "", "abc", "word " * 4000, "word " * 4000, "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "text AS frames", "text AS feature")
    got = {r.doc_id: r for r in gif.stored_texts(docs).collect()}
    for i, t in enumerate(texts):
        p, r = gif.padded(t or ""), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(gif.encode_gif(p)).hexdigest()
        assert [f.start_ms for f in r.frames] == list(range(0, 100 * len(r.frames), 100)) and sum(sum(f.histogram) for f in r.frames) >= len(p)
    assert got[3][1:] == got[4][1:] and gif.stored_texts(docs.limit(0)).count() == 0
