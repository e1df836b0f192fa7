"""WARC: writer with revisit records, and a salvage reader.

Writer: records with equal payloads share one ``response`` (the smallest page id); the others are ``revisit``
records that refer to it.  Each record is a gzip member.  Files go through Spark's own text sink (bytes as they
are), so commits and task retries are Spark's and any file system that Spark writes works.  The sink ends each
value with a separator: a gzip member ends with the top byte of its length, 0 below 16 MiB, so members are
written without their last byte and the separator is that byte.  Longer records are followed by an empty member.

Reader: each member (or uncompressed record) must inflate, have a version line, the stated length and the stated
block digest.  After a failed check the reader searches for the next valid member or version line, goes on from
there, and logs the bytes between as a quarantined gap.  A member may hold several records and is searched the same way.  The writer packs members into pieces and a fixed number of
pieces into a file, so a file (one reading task) has at most ``FILE_BYTES`` and one member more for each piece.

Nulls: a null html is an empty payload, a null url an empty target; a null page id comes back as null and never is
the response of others unless all ids of its group are null.  Rows that tie for the smallest id (repeated rows) are all
responses.  Urls and payloads may be of any length up to a row's 2 GB; empty payloads are records.  Extra columns are ignored
whatever their names; an empty table writes a folder without records, an empty file has none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, in_arrow, shared_folder

#: Bytes of members in each file and pieces that make it up, and revisit records whose ids may be broadcast.
FILE_BYTES, PIECES, BROADCAST_REVISITS = 16 << 20, 8, 200_000
DATE = "2024-01-01T00:00:00Z"
RECORD = "kind string, file string, offset long, length long, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"
_VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
#: Bytes read at a time, and bytes of an inflated member that is still read (a row holds 2 GB at most).
_CHUNK, MOST_INFLATED = 1 << 16, 1 << 30


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url or '')}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"] + [f"X-Refers-To-Page: {refers_to}"] * (refers_to is not None)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is 0 (followed by an empty one where its own is not)."""
    def one(x: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    out = one(data)
    return out if out[-1] == 0 else out + one(b"")


class _Ahead:
    """The next place of a pattern at or after an offset; looking from growing offsets costs one pass for each pattern."""

    def __init__(self, content: bytes):
        self.content, self.found = content, {}

    def next(self, pattern: bytes, at: int) -> int:
        """The place, or the content's length."""
        if self.found.get(pattern, -1) < at:
            got = self.content.find(pattern, at)
            self.found[pattern] = got if got >= 0 else len(self.content)
        return self.found[pattern]


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and the offset after it."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    while not z.eof and pos < len(data):
        piece = data[pos : pos + _CHUNK]
        out.append(z.decompress(piece))
        pos, size = pos + len(piece), size + len(out[-1])
        if size > MOST_INFLATED:
            raise ValueError("a member of more bytes than a row can hold")
    if not z.eof:
        raise ValueError("truncated member")
    return b"".join(out), pos - len(z.unused_data)


def _parse(content: bytes, at: int, ahead: _Ahead) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and the offset after it; raises when a check fails."""
    end = ahead.next(b"\r\n\r\n", at)  # urls may be of any length
    if not _VERSION.match(content, at) or end == len(content):
        raise ValueError("no version line or header end")
    if ahead.next(b"\r\nWARC/1.", at) < end:
        raise ValueError("header lines")
    pairs = [x.partition(": ") for x in content[at:end].decode("utf-8").split("\r\n")[1:]]
    fields = {k: v for k, _, v in pairs}
    if any(not sep for _, sep, _ in pairs) or any(sum(k == must for k, _, _ in pairs) != 1 for must in ("WARC-Type", "WARC-Record-ID", "Content-Length")):
        raise ValueError("header lines")
    size = int(fields["Content-Length"])
    if size < 0 or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("block length")
    block = content[end + 4 : end + 4 + size]
    if fields.get("WARC-Block-Digest", "") not in ("", f"sha1:{digest(block)}"):
        raise ValueError("block digest")
    return fields, block, end + 8 + size


def _records_at(content: bytes, at: int, ahead: _Ahead, members: bool) -> tuple[list[tuple], int]:
    """Records (and gaps) of the valid member or record at ``at``, and the offset after it; raises when there is none."""
    if members and content.startswith(b"\x1f\x8b", at):
        raw, end = _inflate(memoryview(content), at)
        inside = list(salvage(raw, False))
        if raw and not any(kind == "record" for kind, *_ in inside):
            raise ValueError(inside[0][-1])
        said = lambda a, n, why: f"bytes {a} to {a + n} of the member: {why}" if why else ""
        return [(kind, at, end - at, fields, block, said(a, n, why)) for kind, a, n, fields, block, why in inside], end
    fields, block, end = _parse(content, at, ahead)
    return [("record", at, end - at, fields, block, "")], end


def salvage(content: bytes, members: bool = True) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """(kind, offset, length, fields, block, reason) of each record and each quarantined gap, in order.

    A member may hold several records; what does not parse inside of it is a gap at the member's offset."""
    ahead, at, bad, reason = _Ahead(content), 0, None, ""
    while at < len(content):
        try:
            found, end = _records_at(content, at, ahead, members)
        except (ValueError, KeyError, zlib.error) as e:
            if bad is None:
                bad, reason = at, str(e)
            at = min(ahead.next(magic, at + 1) for magic in ((b"\x1f\x8b\x08", b"WARC/1.") if members else (b"WARC/1.",)))
            continue
        if bad is not None:
            yield "gap", bad, at - bad, {}, b"", reason
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield "gap", bad, len(content) - bad, {}, b"", reason


def _number(x: str | None) -> int | None:
    return int(x) if x is not None else None


def rows_of(file: str, content: bytes, with_payload: bool = True) -> list[tuple]:
    out = []
    for kind, at, n, f, block, reason in salvage(content):
        if kind == "gap":
            out.append((kind, file, at, n, None, None, None, None, None, None, None, reason))
            continue
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = f.get("WARC-Type") == "revisit"
        size = _number(f.get("X-Payload-Length")) if revisit else len(payload)
        sha = f.get("WARC-Payload-Digest", "").removeprefix("sha1:") if revisit else digest(payload)
        url = f.get("WARC-Target-URI", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        out.append((kind, file, at, n, _number(f.get("X-Page-ID")), f.get("WARC-Type"), url, size, sha, _number(f.get("X-Refers-To-Page")), payload if with_payload and not revisit else None, None))
    return out


def write_warc(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> str:
    """Write the archives; returns their folder (a new one in the shared folder by default).

    Equal payloads meet as narrow (checksum, id) rows.  The revisits among them are broadcast up to
    ``BROADCAST_REVISITS`` (counted first), so html is written where it is read; beyond that it is shuffled once.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(col(html), F.lit(""))
    sha = F.concat(F.sha1(body.cast("binary")), F.lit(":"), F.octet_length(body).cast("string"))
    rows = pages.select(col(page_id).cast("long").alias("page_id"), col(url).alias("url"), body.alias("html"), sha.alias("sha"))
    keys = rows.select("page_id", "sha").distinct()
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = keys.join(first, "sha").where("not (page_id <=> first)")
    again = cut(again.select(F.col("page_id").alias("k_id"), F.col("sha").alias("k_sha"), "first"))
    few = again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    of = rows["page_id"].eqNullSafe(F.col("k_id")) & (rows["sha"] == F.col("k_sha"))
    joined = rows.join(F.broadcast(again) if few else again, of, "left")
    dealt = joined.select("page_id", "url", "html", "first", F.col("k_sha").isNotNull().alias("revisit"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        value = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
        for b in batches:
            for i, u, h, r, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(member(record(i, u, h.encode("utf-8", "surrogatepass"), r, v)))
                size += len(held[-1])
                if size >= file_bytes // PIECES:
                    yield value()
                    held, size = [], 0
        if held:
            yield value()

    lines = in_arrow(dealt, members, "value binary", 64).select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\u0000").option("compression", "none").option("maxRecordsPerFile", PIECES).text(path)
    return path


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record and gap of the archives in a folder (schema ``RECORD``)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = rows_of(file, content, with_payload)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names)

    return in_arrow(files, read, RECORD, 1)  # a row is a whole file
