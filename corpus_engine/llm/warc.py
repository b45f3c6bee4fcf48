"""Legacy ARC archives converted to WARC, written and read back on Spark.

An ARC file starts with a version block that names its header layout: version 1 lines hold
URL, IP, date, type and length, version 2 lines hold ten fields. The converter reads the
declared layout, cuts records by declared length, and synthesises what WARC needs and ARC
lacks: record ids (from address, date and digest), ISO dates, record types, block and payload
digests. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
largest page_id is a ``response``, the others are ``revisit`` records that point to it.

Archives are written by Spark's text writer: a record ends in CRLF CRLF, so the record without its
last line feed is one row and the line feed is the writer's separator; task commits make lost
executors harmless. Files are gzip as a whole. Reading streams the lines of a file through a
parser that trusts Content-Length alone, so payloads may hold any text, headers included, and memory is bounded by one record.

Archives of others: a record that starts with an HTTP status line is a response, whose header ends at its first empty line, with or without
carriage returns, and need not name its length; any other record (``text/dns`` and the like) is a resource with its ARC
type. ``filedesc`` blocks become no record of their own. Short dates are
filled up. Bodies must be UTF-8: Spark's text reader changes other bytes, and the records' lengths no longer hold.

Null html is an empty payload, a null url becomes ``urn:page:<id>``, and white space in an
address is percent-encoded. Repeated rows with the largest page_id of their payload are all responses.
A null page_id counts as the smallest; if all are null, all are responses. An empty table gives an
empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.common import shipped, written
from corpus_engine.session import scratch_path

REVISIT_BYTES = 1000
ARC_DATE = "20000101000000"
#: Header layouts by version (fixed names of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Bytes:
    """A stream of text pieces, each ended by a line feed, read by line or by length."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.buf, self.at = iter(pieces), b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buf, self.at = self.buf[self.at:] + piece.encode() + b"\n", 0
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        while (end := self.buf.find(b"\n", self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.buf[self.at:end], end + 1
        return out

    def read(self, n: int) -> bytes:
        if len(self.buf) - self.at < n:
            parts, have = [self.buf[self.at:]], len(self.buf) - self.at
            while have < n:
                piece = next(self.pieces, None)
                if piece is None:
                    raise ValueError(f"archive ends {n - have} bytes early")
                parts.append(piece.encode() + b"\n")
                have += len(parts[-1])
            self.buf, self.at = b"".join(parts), 0
        out, self.at = self.buf[self.at:self.at + n], self.at + n
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        for v in b.column(0):
            yield v.as_py()


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``most`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def arc_head(version: int, name: str = "pages") -> str:
    """The version block of an ARC file (without its last line feed)."""
    body = f"{version} 0 corpus\n{ARC_FIELDS[version]}\n"
    if version == 1:
        return f"filedesc://{name}.arc 0.0.0.0 {ARC_DATE} text/plain {len(body)}\n{body}"
    return f"filedesc://{name}.arc 0.0.0.0 {ARC_DATE} text/plain 200 - - 0 {name}.arc {len(body)}\n{body}"


def arc_record(version: int, url: str, body: str, mime: str = "text/html") -> str:
    """One ARC record (without its last line feed)."""
    size = len(body.encode())
    if version == 1:
        return f"{url} 0.0.0.0 {ARC_DATE} {mime} {size}\n{body}"
    return f"{url} 0.0.0.0 {ARC_DATE} {mime} 200 - - 0 pages.arc {size}\n{body}"


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page rows to the pieces of one ARC file per task; tasks take turns with the versions."""
    from pyspark import TaskContext

    version = 1 + TaskContext.get().partitionId() % 2

    def rows():
        yield (arc_head(version),)
        for b in batches:
            for key, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                html = html or ""
                address = re.sub(r"\s", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url or f"urn:page:{key}")
                page = "" if key is None else f"X-Page-Id: {key}\r\n"
                yield (arc_record(version, address or "urn:page:", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                                  f"Content-Length: {len(html.encode())}\r\n{page}\r\n{html}"),)

    return _batches(rows(), pa.schema([("value", pa.string())]))


def arc_pieces(pages: DataFrame) -> DataFrame:
    """The ARC archives of ``pages`` as text pieces in file order (one archive per task)."""
    shipped(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_to_arc, "value string")


def parse_arc(stream: Bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(url, date, mime, body) of every record of concatenated ARC files."""
    version = 1
    while (line := stream.line()) is not None:
        if not line:
            continue
        if line.startswith(b"filedesc://"):
            # the version block's own line has the layout it declares; the length is last in both
            body = stream.read(int(line.rsplit(b" ", 1)[1]))
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        n = len(ARC_FIELDS[version].split()) - 1
        url, _, date, mime, *_, size = _text(line.rstrip(b"\r")).rsplit(" ", n)
        yield url, date, mime, stream.read(int(size))


_RECORD = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("head", pa.string()),
                     ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _header(head: str, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", head)
    return m[1] if m else None


def _whole_number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]{1,18}", text.strip()) else None


def split_body(body: bytes) -> tuple[str, bytes]:
    """The HTTP header of a record's body, with CRLF line ends, and the payload; no header if the body is not HTTP."""
    if not body.startswith(b"HTTP/"):
        return "", body
    end = _EMPTY_LINE.search(body)
    head, payload = (body, b"") if end is None else (body[:end.start()], body[end.end():])
    return re.sub(r"\r?\n", "\r\n", _text(head).rstrip("\r\n")), payload


def _from_arc(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for uri, date, mime, body in parse_arc(Bytes(_pieces(batches))):
                head, payload = split_body(body)
                yield (_whole_number(_header(head, "X-Page-Id")), uri, date, mime, head, payload.decode() if keep else "",
                       len(payload), hashlib.sha1(payload).hexdigest())
        return _batches(rows(), _RECORD)
    return run


_RECORD_DDL = "page_id long, uri string, date string, mime string, head string, payload string, payload_bytes long, payload_digest string"


def arc_records(pieces: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ARC archives given as text pieces (the lines of ARC files, or :func:`arc_pieces`)."""
    return pieces.mapInArrow(_from_arc(payloads), _RECORD_DDL)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files (``.gz`` or plain) under ``path``; whole files per task."""
    lines = shipped(spark).read.option("lineSep", "\n").option("maxPartitionBytes", str(1 << 40)).text(path)
    return arc_records(lines.select("value"))


def record_id(uri: str, date: str, digest: str, page_id: int | None) -> str:
    """A WARC record id that depends on the record alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {digest} {page_id}')}>"


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(data).decode()


def warc_record(page_id, uri, date, mime, head, payload, size, digest, refers_to) -> str:
    """One WARC record (without its last line feed): a response, a resource (no HTTP header), or a revisit without payload."""
    date = (date + ARC_DATE[len(date):])[:14]  # short dates of old archives
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    block = (head + "\r\n\r\n" if head else "") + (payload if refers_to is None else "")
    raw = block.encode()
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}",
             f"WARC-Date: {iso}", f"WARC-Record-ID: {record_id(uri, date, digest, page_id)}",
             f"WARC-Payload-Digest: {_base32(bytes.fromhex(digest))}", f"WARC-Block-Digest: {_base32(hashlib.sha1(raw).digest())}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Payload-Length: {size}", f"Content-Type: {'application/http; msgtype=response' if head else mime}", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r"


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            names = ("page_id", "uri", "date", "mime", "head", "payload", "payload_bytes", "payload_digest", "refers_to")
            for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                yield (warc_record(*row),)
    return _batches(rows(), pa.schema([("value", pa.string())]))


def convert(pieces: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write the ARC archives ``pieces`` as WARC files under ``path``.

    The first pass reads digests only; payload groups are aggregated map-side, so a payload
    that a third of all pages share is one row per task there, and the join that brings the
    response's id to its pages is split by Spark's skew join."""
    marks = written(arc_records(pieces, payloads=False).select("page_id", "payload_bytes", "payload_digest"), "arc-digests")
    groups = marks.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest")).agg(
        F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL").select("_digest", "top")
    records = arc_records(pieces).join(groups, F.col("payload_digest") == F.col("_digest"), "left")
    older = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    records = records.withColumn("refers_to", F.when(older, F.col("top")))
    # a revisit's payload need not travel on
    records = records.withColumn("payload", F.when(older, F.lit("")).otherwise(F.col("payload")))
    out = records.select("page_id", "uri", "date", "mime", "head", "payload", "payload_bytes", "payload_digest", "refers_to")
    out.mapInArrow(_to_warc, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse_warc(stream: Bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every WARC record of concatenated files."""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.line()) not in (b"\r", b"", None):
            name, _, value = _text(line).partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("record_id", pa.string()),
                   ("payload", pa.string())])


def _from_warc(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for headers, block in parse_warc(Bytes(_pieces(batches))):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit", "resource"):
                    continue
                head, payload = ("", block) if kind == "resource" else split_body(block)
                found = hashlib.sha1(payload).hexdigest()
                stated = headers.get("warc-payload-digest", "")
                digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated.startswith("sha1:") else found
                size = _whole_number(headers.get("x-payload-length"))
                if kind != "revisit":
                    if found != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                    size = len(payload)
                yield (_whole_number(_header(head, "X-Page-Id")), size, digest, kind, _whole_number(headers.get("x-refers-to-page")),
                       headers["warc-target-uri"], headers["warc-record-id"], payload.decode() if keep else None)
        return _batches(rows(), _READ)
    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The response, resource and revisit records under ``path``; payloads are checked against their digests."""
    lines = shipped(spark).read.option("lineSep", "\n").text(path)
    return lines.select("value").mapInArrow(_from_warc(payloads), "page_id long, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, uri string, record_id string, payload string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as ARC records, convert them to WARC in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "llm", "warc")
    convert(arc_pieces(pages), path)
    return read_warc(pages.sparkSession, path)
