"""WARC archives: a writer of one gzip member per record and a sequential reader.

Writer and reader go through Spark's own file sources, so archives can lie in any store that Spark reaches and
files of a lost or repeated task never count. The text sink ends each row with a separator; it is a zero byte
here, which gzip allows between and after members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stable, whole

#: Bytes of finished members that are handed on together, how many of these in a file, bytes decompressed at once, and made of them at most.
CHUNK, CHUNKS_A_FILE, SLICE, PIECE = 4 << 20, 8, 1 << 16, 1 << 20
ZERO_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit holds the HTTP header of the response, with the ``size`` of its payload but without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class BadRecord(ValueError):
    pass


@dataclass
class WarcRecord:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def members(archive: bytes) -> Iterator[Iterator[bytes]]:
    """For each gzip member its decompressed pieces, a slice of input at a time; zero bytes between them are padding.

    A member's pieces must be used up before the next member is asked for.
    """
    view, at, n = memoryview(archive), 0, len(archive)

    def pieces() -> Iterator[bytes]:
        nonlocal at
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= n and not z.unconsumed_tail:
                raise BadRecord("the archive ends within a member")
            piece = z.unconsumed_tail or view[at : at + SLICE]
            fresh = not z.unconsumed_tail
            try:
                out = z.decompress(piece, PIECE)
            except zlib.error as e:
                raise BadRecord(f"damaged member: {e}") from e
            if fresh:
                at += len(piece)
            if out:
                yield out
        at -= len(z.unused_data)

    while at < n:
        if view[at] == 0:
            at += 1
            continue
        yield pieces()


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines:
        k, colon, v = x.decode("utf-8", "replace").partition(":")
        if not colon:
            raise BadRecord(f"header line without a colon: {x[:80]!r}")
        out[k.strip().lower()] = v.strip()
    return out


class _Stream:
    """Pieces of a member, read up to a mark or by length."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def until(self, mark: bytes, what: str, most: int = 1 << 20) -> bytes:
        while (end := self.held.find(mark)) < 0:
            more = next(self.pieces, b"") if len(self.held) <= most else b""
            if not more:
                raise BadRecord(what)
            self.held += more
        out, self.held = self.held[:end], self.held[end + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in pieces, or fewer where the member ends."""
        while n > 0:
            x, self.held = (self.held or next(self.pieces, b"")), b""
            if not x:
                return
            x, self.held = x[:n], x[n:]
            n -= len(x)
            yield x

    def rest(self) -> bytes:
        return self.held + b"".join(self.pieces)


def _digest(sha) -> str:
    return "sha1:" + base64.b32encode(sha.digest()).decode()


def parse(pieces: Iterable[bytes]) -> WarcRecord:
    """Frame one record by its content length and verify its digests, piece by piece; only the payload is kept."""
    s = _Stream(iter(pieces))
    lines = s.until(b"\r\n\r\n", "no end of the WARC header").split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise BadRecord("no WARC version line")
    headers = _fields(lines[1:])
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise BadRecord("no content length")
    size, block, payload = int(size), hashlib.sha1(), hashlib.sha1()
    body = _Stream(s.take(size))
    http: dict[str, str] = {}
    got = 0
    if headers.get("content-type", "").startswith("application/http"):
        head = body.until(b"\r\n\r\n", "no end of the HTTP header")
        http = _fields(head.split(b"\r\n")[1:])
        block.update(head + b"\r\n\r\n")
        got = len(head) + 4
    kept = []
    for x in body.take(size - got):
        block.update(x), payload.update(x)
        kept.append(x)
        got += len(x)
    if got != size or s.rest() != b"\r\n\r\n":
        raise BadRecord("the block is not as long as its content length")
    if (d := headers.get("warc-block-digest")) and d != _digest(block):
        raise BadRecord("block digest differs")
    if headers.get("warc-type") == "response" and (d := headers.get("warc-payload-digest")) and d != _digest(payload):
        raise BadRecord("payload digest differs")
    return WarcRecord(headers, http, b"".join(kept))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record per row to archives below ``path``.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads of ``min_revisit`` bytes or
    more, those with the largest id are responses, all others revisit it; a row that repeats the largest id is
    a response too. A null id is smaller than any other. An empty table writes no record.
    """
    payload = whole(payload_col)
    keep = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    # who revisits whom is told by narrow rows; a hot payload is summed before it is dealt
    narrow = stable(pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("bytes")), "digests")
    twice = narrow.filter(F.col("bytes") >= min_revisit).groupBy("sha1").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = stable(narrow.join(twice, "sha1").filter(~F.col("id").eqNullSafe(F.col("response"))).select("id", "sha1", "response").distinct(), "revisits")
    # payloads meet them by id and digest, which no hot payload shares; a revisit's own isn't sent on
    p, r = keep.alias("p"), again.withColumn("revisit", F.lit(True)).alias("r")
    joined = p.join(r, F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.sha1") == F.col("r.sha1")), "left")
    revisit = F.coalesce(F.col("r.revisit"), F.lit(False))
    rows = joined.select("p.id", "p.url", "p.sha1", F.octet_length("p.payload").alias("bytes"), F.when(revisit, F.lit("")).otherwise(F.col("p.payload")).alias("payload"), "r.response", revisit.alias("revisit"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c) for c in ("id", "url", "sha1", "bytes", "payload", "response", "revisit")), strict=True):
                i, url, sha1, n, payload, response, again = (x.as_py() for x in row)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                m = member(record(i, url, payload.encode("utf-8", "surrogatepass"), n, digest, response, again, date))
                held.append(m)
                size += len(m)
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    chunks = rows.mapInArrow(work, "archive binary")
    # a cast keeps the bytes as they are; the separator is one zero byte
    chunks.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS_A_FILE).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, url, payload_digest, payload_bytes, refers_to, payload of every record below ``path``.

    payload_bytes is that of the full payload; a revisit has it from the HTTP header it keeps, and a null
    payload. Files may have any name that Spark doesn't hide (``_``, ``.``). Records of other types than response
    and revisit come with the payload that they hold. An archive is read whole by Spark, so it must be smaller than
    2 GB; a record's payload is the largest thing that is held besides. A damaged archive raises ``BadRecord``.
    """

    def number(urn: str | None) -> int | None:
        """The number at the end of a name that this writer gave; other archives' names have none."""
        v = (urn or "").strip("<>").removeprefix("urn:x-page:")
        return int(v) if re.fullmatch(r"-?\d+", v) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held, size = [], 0
                for pieces in members(content.as_buffer()):
                    r = parse(pieces)
                    h, full = r.headers, r.headers.get("warc-type") != "revisit"
                    n = len(r.payload) if full else int(r.http.get("content-length", 0))
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (base32_sha1(r.payload) if full else None)
                    held.append((number(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), digest, n, number(h.get("warc-refers-to")), r.payload if full else None))
                    size += len(r.payload)
                    if size >= CHUNK:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(work, "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_revisit=min_revisit)
    return read_warc(pages.sparkSession, path)
