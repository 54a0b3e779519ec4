"""Legacy archive converter: ARC files of either version to WARC, and back from WARC to rows.

An ARC file starts with a version block, whose length is declared like that of any
record and whose text names the version and the fields of the header lines that
follow.  Version 1 lines have five fields, version 2 lines ten.  A record is read by
its declared length alone, never by a separator, so any payload is safe.

Conversion synthesises what WARC wants: record ids from page and digest, ISO dates
from 14 digits, types (``response``, or ``revisit`` for a payload that a smaller page
already has), SHA-256 block and payload digests.  Revisits keep the HTTP header, whose
Content-Length still gives the size of the full payload.

Files are written by Spark's text sink, one record a row whose last line feed is the
sink's, and read by Spark's binary file source; so they may live in any store.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
_BATCH = 8 << 20


def _date14(page_id: int | None) -> str:
    """A date from the page's number, as the pages have none."""
    n = page_id or 0
    return f"2009{1 + n % 12:02d}{1 + n % 28:02d}{n % 24:02d}{n % 60:02d}{(n // 60) % 60:02d}"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_record(version: int, url: str | None, date: str, block: bytes) -> bytes:
    """Header line and block; the line feed that ends a record is the sink's."""
    where = quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%~-._")
    tail = [str(len(block))]
    if version == 2:
        tail = ["200", hashlib.md5(block).hexdigest(), "-", "0", "pages.arc", *tail]
    return " ".join([where, "0.0.0.0", date, "text/html", *tail]).encode() + b"\n" + block


def arc_start(version: int) -> bytes:
    text = f"{version} 0 pages\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = ["filedesc://pages.arc", "0.0.0.0", "20090101000000", "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", "pages.arc"]
    return " ".join([*head, str(len(text))]).encode() + b"\n" + text


def _as_text_file(df: DataFrame, path: str) -> None:
    # a binary column cast to string keeps its bytes
    text = df.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n")
    text.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One gzipped ARC file per partition, its version by the partition's number in turn; NULL payloads are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        version = versions[TaskContext.get().partitionId() % len(versions)]
        for b in batches:
            for page, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                out = [] if started else [arc_start(version)]
                started = True
                out.append(arc_record(version, url, _date14(page), http_block(page, (payload.as_py() or "").encode("utf-8", "surrogatepass"))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    _as_text_file(rows.mapInArrow(run, "record binary"), path)


class _Bytes:
    """Reads lines and exact lengths from gzipped or plain content, inflating a piece at a time."""

    def __init__(self, content: bytes):
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.content, self.read = content, 0
        self.have, self.at = (b"", 0) if self.zip else (content, 0)

    def _more(self) -> bool:
        while self.zip and self.read < len(self.content):
            if self.zip.eof:  # next gzip member
                self.zip = zlib.decompressobj(31)
            piece = self.content[self.read : self.read + (1 << 16)]
            new = self.zip.decompress(piece)
            self.read += len(piece) - len(self.zip.unused_data)
            if new:
                self.have, self.at = self.have[self.at :] + new, 0
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        while (end := self.have.find(b"\n", self.at)) < 0:
            if not self._more():
                if self.at == len(self.have):
                    return None
                end = len(self.have)
                break
        out, self.at = self.have[self.at : end], min(end + 1, len(self.have))
        return out

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while True:
            part = self.have[self.at : self.at + need]
            self.at += len(part)
            need -= len(part)
            parts.append(part)
            if not need:
                return b"".join(parts)
            if not self._more():
                raise ValueError(f"archive ends {need} bytes before a record's declared length")


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, block) of each record after the version block."""
    src, fields = _Bytes(content), None
    while (line := src.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            text = src.take(int(parts[-1])).decode().split("\n")
            version = int(text[0].split(" ")[0])
            fields = tuple(text[1].split(" "))
            if fields != ARC_FIELDS.get(version):
                raise ValueError(f"ARC version {version} with fields {fields}")
            continue
        if len(parts) < len(fields):
            raise ValueError(f"header line with {len(parts)} of {len(fields)} fields")
        # a URL with spaces in it takes the surplus
        extra = len(parts) - len(fields)
        parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        head = dict(zip(fields, parts))
        yield head, src.take(int(head["Archive-length"]))


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def _http_number(head: bytes, name: str) -> int | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":\s*(-?\d+)\s*$", head.replace(b"\r\n", b"\n"))
    return int(m[1]) if m else None


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weight: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or b"") + 200
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _read(spark: SparkSession, paths: list[str], rows, schema: str, names: list[str], kinds: list[pa.DataType], weight: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _batched(rows(content.as_py()), names, kinds, weight)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).select("content").mapInArrow(run, schema)


def read_arc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(page_id, url, date, block_zstd, payload_bytes, payload_digest) of every record; blocks are compressed as they travel."""

    def rows(content: bytes):
        pack = zstandard.ZstdCompressor(level=3)
        for head, block in parse_arc(content):
            http, payload = _split_http(block)
            yield _http_number(http, "X-Page-Id"), head["URL"], head["Archive-date"], pack.compress(block), len(payload), hashlib.sha256(payload).hexdigest()

    return _read(spark, paths, rows, "page_id long, url string, date string, block_zstd binary, payload_bytes long, payload_digest string",
                 ["page_id", "url", "date", "block_zstd", "payload_bytes", "payload_digest"],
                 [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()], 3)


def _record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}' if page_id is not None else f'{url}|{date}|{digest}')}>"


def warc_record(page_id: int | None, url: str, date: str, block: bytes, digest: str, first: int | None) -> bytes:
    """A WARC 1.1 record without its last line feed; ``first`` is the page a revisit refers to."""
    head = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, url, date, digest)),
        ("WARC-Date", f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"),
        ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if first is not None:
        block = _split_http(block)[0]
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first, "", "", digest))]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r"


def convert(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """ARC records to (record): WARC bytes.

    Of records with equal payloads of at least ``min_bytes``, those of the smallest
    page are responses and the others revisits.  Records without a page number are
    always responses.  Only numbers and digests go through the join that finds the
    smallest page; payloads are dealt by page, so a hot payload is not one task.
    """
    long_ = records.where(f"payload_bytes >= {min_bytes} and page_id is not null").select("page_id", "payload_digest")
    first = long_.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    again = long_.distinct().join(first, "payload_digest").where("page_id > first").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows(b: pa.RecordBatch):
            for page, url, date, packed, digest, first in zip(*[c.to_pylist() for c in b.columns]):
                yield (warc_record(page, url, date, unpack.decompress(packed), digest, first),)

        for b in batches:
            yield from _batched(rows(b), ["record"], [pa.binary()], 0)

    joined = records.join(again, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "date", "block_zstd", "payload_digest", "first").mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    _as_text_file(records, path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    src = _Bytes(content)
    while (line := src.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := src.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        yield head, src.take(int(head["Content-Length"]))


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(record_id, refers, record_type, page_id, url, date, payload_bytes, payload_digest, payload); digests of blocks and payloads are verified."""

    def rows(content: bytes):
        for head, block in parse_warc(content):
            http, payload = _split_http(block)
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                raise ValueError(f"block digest of {head['WARC-Record-ID']}")
            full = head["WARC-Type"] == "response"
            if full and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
            yield (head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Type"], _http_number(http, "X-Page-Id"), head["WARC-Target-URI"], head["WARC-Date"],
                   len(payload) if full else _http_number(http, "Content-Length"), digest, payload if full else None)

    return _read(spark, paths, rows, "record_id string, refers string, record_type string, page_id long, url string, date string, payload_bytes long, payload_digest string, payload binary",
                 ["record_id", "refers", "record_type", "page_id", "url", "date", "payload_bytes", "payload_digest", "payload"],
                 [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], 8)


def index(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits resolved to the page of the record they refer to."""
    slim = records.select("record_id", "refers", "record_type", "page_id", "payload_bytes", "payload_digest")
    told = slim.where("refers is not null").select(F.col("refers").alias("_ref")).distinct()
    responses = slim.where("record_type = 'response'").select(F.col("record_id").alias("_ref"), F.col("page_id").alias("refers_to"))
    pages = responses.join(told, "_ref", "left_semi").distinct()
    return slim.join(pages, F.col("refers") == F.col("_ref"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
