"""Legacy ARC archives converted to WARC, written and read back as files.

An ARC file starts with a version block ("filedesc://") that names its version;
each record then has one header line of that version's fields, ending in the
length of the block that follows. Version 1 has five fields, version 2 ten. The
converter walks a file by those declared lengths (the content is never searched
for markers) and synthesises what WARC asks for: record id, ISO timestamp, record
type and SHA-1 digests. Payloads and HTTP headers stay the bytes they are, whatever
their encoding. Blocks of other protocols (dns) become resource records.

Files are written by Spark's text writer: a WARC record ends in two line ends, so
they are the writer's line separator. All folders lie below the shared folder, and
files are read through Spark's binary reader (which takes files below 2 GB),
decompressed as a stream. A damaged file gives its rows up to the damage and then
one row that says what is wrong; with `strict` it ends the job instead.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, cut, emit, scratch_dir

# Payloads below this many bytes are never revisits.
MIN_REVISIT = 1000
# Header fields by ARC version, and the separator after a WARC record.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ARC needs an address and a date that pages do not have.
NO_ADDRESS, NO_DATE = "0.0.0.0", "19700101000000"

RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("warc_date", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("content_type", pa.string()),
        ("http_head", pa.binary()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
RECORD_DDL = """page_id long, record_id string, url string, warc_date string, payload_bytes long, payload_digest string,
    record_type string, content_type string, http_head binary, payload binary, error string"""
VALUE = pa.schema([("value", pa.binary())])


# ---- ARC ---------------------------------------------------------------------------


def arc_file_header(version: int, name: str) -> str:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n"
    line = [f"filedesc://{name}", NO_ADDRESS, NO_DATE, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*line, str(len(body.encode()))]) + "\n" + body


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes, name: str) -> bytes:
    """One ARC record: header line and HTTP response block."""
    page = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%sContent-Length: %d\r\n\r\n" % (page, len(payload)) + payload
    shown = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "-"
    line = [shown, NO_ADDRESS, NO_DATE, "text/html"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*line, str(len(block))]).encode() + b"\n" + block


class Stream:
    """Bytes and lines of a file given as chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.buffer, self.at = iter(chunks), b"", 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.buffer, self.at = self.buffer[self.at :] + chunk, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the file."""
        seen = self.at
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer) - self.at
            if not self._more():
                rest, self.at = self.buffer[self.at :], len(self.buffer)
                return rest or None
        found, self.at = self.buffer[self.at : end], end + 1
        return found.rstrip(b"\r")

    def read(self, size: int) -> bytes:
        if len(self.buffer) - self.at < size:
            parts = [self.buffer[self.at :]]
            have = len(parts[0])
            self.buffer, self.at = b"", 0
            while have < size and (chunk := next(self.chunks, None)) is not None:
                parts.append(chunk)
                have += len(chunk)
            self.buffer = b"".join(parts)
        if len(self.buffer) - self.at < size:
            raise ValueError(f"archive ends {size - len(self.buffer) + self.at} bytes early")
        found, self.at = self.buffer[self.at : self.at + size], self.at + size
        return found


def unpacked(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in pieces; gzip files of one or more members are decompressed."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + size] for i in range(0, len(content), size))
        return
    view = memoryview(content)
    while view:
        member = zlib.decompressobj(31)
        for i in range(0, len(view), size):
            data = member.decompress(view[i : i + size])
            if data:
                yield data
            if member.eof:
                view = view[min(i + size, len(view)) - len(member.unused_data) :]
                break
        else:
            if not member.eof:
                raise ValueError("archive ends inside a gzip member")


def parse_arc(chunks: Iterable[bytes]) -> Iterator[tuple[list[str], bytes]]:
    """Header fields (URL first, length last) and block of every record but the version block."""
    stream, version = Stream(chunks), None
    while (line := stream.line()) is not None:
        if not line:
            continue
        if version is None:
            length = int(line.rsplit(b" ", 1)[1])
            version = int(stream.read(length).split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        fields = line.decode("utf-8", "replace").rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
        yield fields, stream.read(int(fields[-1]))


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP block; some old servers end lines without U+000D."""
    ends = [at + len(blank) for blank in (b"\r\n\r\n", b"\n\n") if (at := block.find(blank)) >= 0]
    end = min(ends, default=len(block))
    return block[:end], block[end:]


def http_headers(head: bytes) -> dict[str, str]:
    lines = (line.partition(b":") for line in head.split(b"\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in lines}


def number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def iso_date(arc_date: str) -> str:
    """An ARC date of 4 to 14 digits; missing months and days are the first, missing times 0."""
    if not (arc_date.isascii() and arc_date.isdigit() and len(arc_date) in (4, 6, 8, 10, 12, 14)):
        raise ValueError(f"date {arc_date!r}")
    return datetime.strptime(arc_date + "00000101000000"[len(arc_date) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def from_arc(file: str, chunks: Iterable[bytes]) -> Iterator[tuple]:
    """RECORD rows of one ARC file; the record id is derived from file, place and digest.

    A record with a date that is none keeps its content and the date of records without one.
    """
    for place, (fields, block) in enumerate(parse_arc(chunks)):
        http = block.startswith(b"HTTP/")
        head, payload = http_parts(block) if http else (b"", block)
        digest = hashlib.sha1(payload).hexdigest()
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{file.rsplit('/', 1)[-1]}#{place}#{digest}")
        try:
            date = iso_date(fields[2])
        except ValueError:
            date = iso_date(NO_DATE)
        yield (
            number(http_headers(head).get("x-page-id")), f"urn:uuid:{name}", fields[0], date, len(payload), digest,
            "response" if http else "resource", fields[3], head, payload, None,
        )


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One ARC file per partition, by turns of version 1 and 2."""
    picked = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.spark_partition_id().alias("part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            if version is None:
                part = batch.column("part")[0].as_py()
                version, name = 1 + part % 2, f"pages-{part:06d}.arc"
                rows.append((arc_file_header(version, name).encode(),))
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for i, u, payload in zip(ids, urls, column_bytes(batch, "html")):
                rows.append((arc_record(version, u, i, payload, name),))
            yield from emit(rows, VALUE, 1024)

    _written(picked.mapInArrow(run, "value binary"), path)


def _written(values: DataFrame, path: str, separator: str = "\n") -> None:
    """Bytes as they are, with a separator after each; a cast keeps bytes that are not UTF-8."""
    values.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", separator).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")


def _parsed(spark: SparkSession, path: str, parse, schema: pa.Schema, ddl: str, strict: bool) -> DataFrame:
    """Rows of all files; what is wrong with a file is the last column of its last row, or ends the job if `strict`."""

    def rows(file: str, content: bytes) -> Iterator[tuple]:
        try:
            yield from parse(file, unpacked(content))
        except (ValueError, LookupError, zlib.error) as e:
            if strict:
                raise
            yield (*[None] * (len(schema) - 1), f"{file.rsplit('/', 1)[-1]}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from emit(rows(file, content.as_py()), schema, 512)

    return _files(spark, path).mapInArrow(run, ddl)


def read_arc(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """RECORD rows of all ARC files below `path`; rows of damage have an error and nothing else."""
    return _parsed(spark, path, from_arc, RECORD, RECORD_DDL, strict)


# ---- WARC --------------------------------------------------------------------------

ENTRY = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
        ("url", pa.string()),
        ("warc_date", pa.string()),
        ("error", pa.string()),
    ]
)
ENTRY_DDL = """page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string,
    refers_to_id string, url string, warc_date string, error string"""


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(r: dict) -> bytes:
    """One WARC record without its closing line ends; a revisit carries the HTTP head only.

    A revisit names the record it refers to, and in fields of its own that record's page
    and the length of the payload left out.
    """
    first = r["first"]
    block = r["http_head"] + (b"" if first else r["payload"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else r['record_type']}",
        f"WARC-Record-ID: <{r['record_id']}>",
        f"WARC-Date: {r['warc_date']}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-Payload-Digest: sha1:{base32(r['payload_digest'])}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: " + ("application/http; msgtype=response" if r["http_head"] else r["content_type"]),
        f"Content-Length: {len(block)}",
    ]
    if first:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <{first['record_id']}>",
            f"WARC-Refers-To-Target-URI: {first['url']}",
            f"WARC-Refers-To-Date: {first['warc_date']}",
            f"X-Refers-To-Page-Id: {first['page_id']}",
            f"X-Payload-Length: {r['payload_bytes']}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse_warc(file: str, chunks: Iterable[bytes]) -> Iterator[tuple]:
    """ENTRY rows of one WARC file; digests are computed anew where a record has its payload.

    Records that hold no payload of their own (warcinfo, request, metadata) are passed over.
    A payload unlike its declared SHA-1 is a row with an error. The length and the page a
    revisit refers to are known from archives of this module, else null or its Content-Length.
    """
    stream = Stream(chunks)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {}
        while line := stream.line():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        block, kind = stream.read(int(head["content-length"])), head["warc-type"]
        if kind not in ("response", "resource", "revisit"):
            continue
        http_head, payload = http_parts(block) if block.startswith(b"HTTP/") else (b"", block)
        http = http_headers(http_head)
        algorithm, _, declared = head.get("warc-payload-digest", "").partition(":")
        declared = base64.b32decode(declared).hex() if algorithm.lower() == "sha1" and len(declared) == 32 else None
        size, digest, error = len(payload), hashlib.sha1(payload).hexdigest(), None
        if kind == "revisit":
            size, digest = number(head.get("x-payload-length", http.get("content-length"))), declared
        elif declared not in (None, digest):
            error = f"{file.rsplit('/', 1)[-1]}: payload of {head['warc-record-id']} differs from its digest"
        yield (
            number(http.get("x-page-id")), size, digest, kind, number(head.get("x-refers-to-page-id")), head["warc-record-id"].strip("<>"),
            head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, head.get("warc-target-uri"), head.get("warc-date"), error,
        )


def write_warc(records: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """WARC files of RECORD rows; of equal payloads the largest page_id is the response.

    Rows of damage are not written. Resources and rows without page_id are never revisits.
    """
    sound = records.where("error IS NULL")
    firsts = cut(
        sound.where((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull() & (F.col("record_type") == "response"))
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id", "url", "warc_date")).alias("first"), F.min("page_id").alias("smallest"))
        .where("smallest <> first.page_id")
        .select(F.col("payload_digest").alias("f_digest"), F.col("payload_bytes").alias("f_bytes"), "first")
    )
    same = (F.col("payload_digest") == F.col("f_digest")) & (F.col("payload_bytes") == F.col("f_bytes"))
    later = (F.col("page_id") < F.col("first.page_id")) & (F.col("record_type") == "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from emit(((warc_record(r),) for r in batch.to_pylist()), VALUE, 1024)

    told = sound.join(firsts, same, "left").select(*RECORD.names[:-1], F.when(later, F.col("first")).alias("first"))
    _written(told.mapInArrow(run, "value binary"), path, WARC_END)


def read_warc(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """ENTRY rows of all WARC files below `path`."""
    found = _parsed(spark, path, parse_warc, ENTRY, ENTRY_DDL, strict)
    return found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string")) if strict else found


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as ARC files, converted to WARC files, read back: one row per record.

    Null html is an empty payload, a null url is written as `-`. Rows without page_id
    are responses without id. Rows that share page_id and payload are each a response
    where that page_id is the largest of its payload, else each a revisit. Payloads
    below 1000 bytes are responses. Other columns are not read. The archives stay
    below the shared folder.
    """
    spark = pages.sparkSession
    arc, warc = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    write_arc(pages, arc, page_id, url, html)
    write_warc(read_arc(spark, arc, strict=True), warc)
    found = read_warc(spark, warc, strict=True).where("error IS NULL")  # damage ends the job
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
