"""WARC archives: written by Spark, read back with boundary-chain verification.

A record is a header, a blank line, a block of Content-Length bytes and two line ends. Reading tasks take every place
of a file where the magic stands and a whole header follows as a candidate, with the offset of the record after it.
Pointer jumping from the file's start then keeps the candidates that the chain of records reaches; magic inside of
payloads isn't on it. Only then are the reached records' payloads hashed, so that magics nested in payloads cost no
more than their headers.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, saved, scratch_path, table

#: Bytes of payload per archive file, about.
FILE_BYTES = 16 << 20
#: Distinct repeated payloads (some 60 bytes each, without the payload) that are broadcast, at most.
BROADCAST_ROWS = 200_000
#: Names of archive files: those that Spark writes, and the usual ones.
FILES = "{part-*,*.warc,*.warc.gz}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(text: Column) -> Column:
    """Base32 SHA-1 of a string's UTF-8 bytes: each five hexadecimal digits are four letters."""
    digest = F.sha1(text.cast("binary"))
    letters = []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), (F.shiftright(v, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(record): a WARC record per row, without its last line end. Of rows with equal payloads of at least min_bytes,
    that with the least id is a response and the others revisit it; shorter payloads are all responses.

    First ids come from digests alone, and only those of payloads that occur twice meet the rows again, without a
    shuffle of payloads while they are at most BROADCAST_ROWS.

    Null payloads are empty; null urls have no Target-URI; line ends in urls are percent-encoded. Rows that share the
    least id are all responses. A null id is the least only among null ids.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    seen = p.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"))
    again = saved(seen.where("times > 1").select("digest", "n", "first"), "repeated")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)  # else payloads are shuffled by digest, and Spark splits a digest with many rows
    j = p.join(again, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    eol = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("n").cast("string"), F.lit(eol * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(eol))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{eol}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("id")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.lit(f"WARC-Date: 2024-01-01T00:00:00Z{eol}"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("first")), F.lit(f"WARC-Profile: {PROFILE}{eol}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{eol}"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return j.select(F.concat(head, F.lit(eol), block, F.lit(eol)).alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Gzipped WARC files of about FILE_BYTES each; the text writer's line end closes each record."""
    payload = options.get("payload_col", "html")
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(payload)).cast("long"))).first()
    per_file = max(1, int(n * FILE_BYTES / (size or 1))) if n else 1
    records(pages, **options).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", min(per_file, 100_000)).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def _named(v: str | None) -> str | None:
    """A record id as it stands; of those written here, the row's id."""
    return (v[len("<urn:page:") : -1] if v and v.startswith("<urn:page:") else v) or None


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, dict[str, str]]]]:
    """(offsets, successors, (block's offset, header) of each) of every place in a file that could begin a record: a
    magic, a header with a length, and the two line ends where the block stops."""
    at, after, heads = [], [], []
    for m in MAGIC.finditer(data):
        end = data.find(b"\r\n\r\n", m.start())
        if end < 0:
            break
        h = _headers(data[m.start() : end])
        size = h.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            continue
        stop = end + 4 + int(size)
        if data[stop : stop + 4] != b"\r\n\r\n":
            continue
        at.append(m.start())
        after.append(stop + 4)
        heads.append((end + 4, h))
    return np.array(at, np.int64), np.array(after, np.int64), heads


def _fields(data: bytes, begin: int, stop: int, h: dict[str, str]) -> tuple:
    """What a record says of itself, and length and digest of its payload."""
    is_http = h.get("content-type", "").partition(";")[0].strip().lower() == "application/http"
    body = data.find(b"\r\n\r\n", begin, stop) if is_http else -1
    http, payload = ({}, memoryview(data)[begin:stop]) if body < 0 else (_headers(data[begin:body]), memoryview(data)[body + 4 : stop])
    kind = h.get("warc-type")
    if kind == "revisit":
        n = http.get("content-length", "")
        n, digest = int(n) if n.isascii() and n.isdigit() else None, h.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _named(h.get("warc-record-id")), n, digest, kind, _named(h.get("warc-refers-to")), h.get("warc-target-uri")


_RECORD = "file string, at long, id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping: every round doubles the jumps."""
    if not len(at):
        return np.zeros(0, bool)
    order = np.argsort(at)
    pos = np.searchsorted(at[order], after)
    hit = np.minimum(pos, len(at) - 1)
    end = len(at)
    jump = np.append(np.where((pos < len(at)) & (at[order][hit] == after), pos, end)[order], end)
    seen = np.zeros(len(at) + 1, bool)
    seen[0] = at[order][0] == 0
    while (jump[:-1] != end).any():
        seen[jump[seen]] = True
        jump = jump[jump]
    out = np.zeros(len(at), bool)
    out[order] = seen[:-1]
    return out


def read_archives(spark: SparkSession, path: str, pattern: str = FILES) -> DataFrame:
    """The records of all archive files in a folder: file, at, id, payload_bytes, payload_digest, record_type, refers_to, url.

    Files are those whose name fits the pattern. Ids of records not written here are given as they stand. The payload of
    an application/http block is what follows its HTTP header; any other block is payload as a whole. Length and digest
    are of the payload as read; a revisit's are those that it states. A file is one task's unit (up to
    spark.sql.files.maxPartitionBytes of files a task), so its chain is followed where its bytes are and nothing is
    shuffled. What follows a break in the chain, or in a gzip stream, isn't reached. Repeated records are all kept.
    """
    arrow = pa.schema([pa.field(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _RECORD.split(", "))])

    def scan(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = _gunzip(data)
                at, after, heads = candidates(data)
                reached = np.flatnonzero(reachable(at, after)).tolist()
                for some in (reached[i : i + 4096] for i in range(0, len(reached), 4096)):
                    rows = [(name.as_py(), int(at[k]), *_fields(data, heads[k][0], int(after[k]) - 4, heads[k][1])) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(scan, _RECORD)


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file; of a truncated or damaged one, what comes before."""
    out = []
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f, contextlib.suppress(EOFError, zlib.error, gzip.BadGzipFile):
        while part := f.read1(1 << 20):
            out.append(part)
    return b"".join(out)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    r = read_archives(spark, path)
    return r.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
