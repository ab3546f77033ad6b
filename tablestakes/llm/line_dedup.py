"""Repeated runs of lines, found as content-defined chunks and compared byte by byte.

A rolling hash over the hashes of the last two lines decides after which lines a
chunk ends, so borders depend on nearby lines only: text inserted before a passage
does not move the borders inside it. Chunks of two lines or more that occur more
than once anywhere lose all occurrences but the first (smallest doc_id, then place).

1. Each text is chunked; one small row per document and chunk digest.
2. Occurrences and the smallest doc_id are aggregated per digest (map-side combine).
3. Documents with repeated chunks meet those digests again and emit the chunks'
   bytes; every occurrence is compared with the first one's bytes.
4. Documents meet their confirmed digests and drop those chunks.

`clean` compares runs instead of chunks: from every line the shortest run ahead and the
shortest behind of at least 50 characters. Every line of a repeated run of at least 50
characters lies in a repeated one of these, wherever the run starts and ends, so all its
occurrences but the first go whole. `report` keeps the chunks that its SQL twin defines.

Texts are shuffled by key in step 3 and again, inside their rows, in step 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, drop, emit, utf8_length

# Rolling hash: multiplier and modulus; a chunk ends where it is 0 modulo DIVISOR.
BASE, DIVISOR = 31, 4
# Chunks of fewer lines or characters are never removed.
MIN_LINES, MIN_CHARS = 2, 50


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """First and last+1 line of every chunk. A line's hash is its MD5's first 28 bits."""
    found, start, before = [], 0, 0
    for i, line in enumerate(lines):
        value = int.from_bytes(hashlib.md5(line).digest()[:4]) >> 4
        if (value + BASE * before) % DIVISOR == 0:
            found.append((start, i + 1))
            start = i + 1
        before = value
    if start < len(lines):
        found.append((start, len(lines)))
    return found


def candidates(text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """First line, last+1 line, digest and bytes of every chunk that may be removed."""
    lines = text.split(b"\n")
    for start, end in chunks(lines):
        if end - start >= MIN_LINES:
            data = b"\n".join(lines[start:end])
            if utf8_length(data) >= MIN_CHARS:
                yield start, end, int.from_bytes(hashlib.md5(data).digest()[:8], signed=True), data


def runs(text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """As `candidates`, of the shortest run of MIN_CHARS from every line, ahead and behind, by place."""
    lines = text.split(b"\n")
    lengths = [utf8_length(line) + 1 for line in lines]
    found = set()
    end, size = 0, -1  # characters of the joined lines start to end
    for start in range(len(lines)):
        while end < len(lines) and size < MIN_CHARS:
            size += lengths[end]
            end += 1
        if size < MIN_CHARS:
            break
        found.add((start, end))
        size -= lengths[start]
    start, size = len(lines), -1
    for end in range(len(lines), 0, -1):
        while start and size < MIN_CHARS:
            start -= 1
            size += lengths[start]
        if size < MIN_CHARS:
            break
        found.add((start, end))
        size -= lengths[end - 1]
    for start, end in sorted(found):
        data = b"\n".join(lines[start:end])
        yield start, end, int.from_bytes(hashlib.md5(data).digest()[:8], signed=True), data


Finder = Callable[[bytes], Iterator[tuple[int, int, int, bytes]]]


def strip(text: bytes, confirmed: set[int], first_here: set[int], find: Finder = candidates) -> tuple[int, int, int, bytes]:
    """n_lines, removed lines, removed chunks and the rest of one text.

    `confirmed`: digests whose first occurrence is elsewhere. `first_here`: digests whose
    first occurrence is in this text; later ones here go if their bytes are equal, but for
    lines of the first that they overlap.
    """
    lines = text.split(b"\n")
    gone = bytearray(len(lines))
    removed, seen = 0, {}
    for start, end, digest, data in find(text):
        if digest in confirmed or (digest in first_here and seen.setdefault(digest, (start, data, end))[0] != start and seen[digest][1] == data):
            if digest not in confirmed:
                start = max(start, seen[digest][2])
            gone[start:end] = b"\1" * (end - start)
            removed += 1
    kept = text if not removed else b"\n".join(line for line, g in zip(lines, gone) if not g)
    return len(lines), sum(gone), removed, kept


DIGESTS = "array<struct<digest:long,first:boolean>>"


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", find: Finder = candidates) -> DataFrame:
    """Struct `row` (all columns of `docs`) and n_lines, n_removed_lines, n_removed_chunks, kept (text).

    Null text is one empty line and stays null. Rows that share a doc_id count as one
    place: chunks whose smallest doc_id is theirs stay in all of them. Rows without
    doc_id come after all others; among themselves they all keep theirs. Columns of
    any name pass through untouched inside `row`. `find` names the parts that are compared.
    """
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"), F.struct("*").alias("row")
    )
    found = cut(keyed.select("id", "hash", "text").mapInArrow(lambda b: _digests(b, find), "id long, hash long, digest long, n long"))
    repeated = (
        found.groupBy("digest").agg(F.min("id").alias("keeper"), F.sum("n").alias("total")).where("total > 1 and keeper is not null")
        .select(F.col("digest").alias("r_digest"), "keeper")
    )
    lists = (
        found.join(repeated, F.col("digest") == F.col("r_digest"))
        .select("id", "hash", "digest", F.coalesce(F.col("id") == F.col("keeper"), F.lit(False)).alias("first"))
        .groupBy("id", "hash")
        .agg(F.collect_set(F.struct("digest", "first")).alias("digests"))
    )
    lists = cut(lists)
    drop(found)
    bytes_of = _meet(keyed.select("id", "hash", "text"), lists).mapInArrow(
        lambda b: _chunk_bytes(b, find), "id long, hash long, digest long, first boolean, data binary"
    )
    firsts = (
        bytes_of.where("first").groupBy("digest").agg(F.min("data").alias("f_data")).withColumnRenamed("digest", "f_digest")
    )
    confirmed = (
        bytes_of.where("not first")
        .join(firsts, (F.col("digest") == F.col("f_digest")) & (F.col("data") == F.col("f_data")))
        .select("id", "hash", "digest", F.lit(False).alias("first"))
    )
    inside = lists.select("id", "hash", F.explode("digests").alias("d")).select("id", "hash", "d.digest", "d.first").where("first")
    verdicts = confirmed.unionByName(inside).groupBy("id", "hash").agg(F.collect_set(F.struct("digest", "first")).alias("digests"))
    joined = _meet(keyed.select("id", "hash", "row"), verdicts, "left")
    kind = docs.schema.simpleString()
    return joined.select("row", F.col("row").getField(text).alias("text"), "digests").mapInArrow(
        lambda b: _stripped(b, find), f"row {kind}, n_lines long, n_removed_lines long, n_removed_chunks long, kept string"
    )


def _meet(keyed: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    # One plan at every size: these lists grow with the documents, so they are never broadcast.
    lists = lists.withColumnsRenamed({"id": "l_id", "hash": "l_hash"}).hint("merge")
    return keyed.join(lists, (F.col("hash") == F.col("l_hash")) & F.col("id").eqNullSafe(F.col("l_id")), how)


def _digests(batches: Iterator[pa.RecordBatch], find: Finder) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("digest", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        rows = []
        for i, h, text in zip(batch.column("id").to_pylist(), batch.column("hash").to_pylist(), column_bytes(batch, "text")):
            counts: dict[int, int] = {}
            for _, _, digest, _ in find(text):
                counts[digest] = counts.get(digest, 0) + 1
            rows += [(i, h, digest, n) for digest, n in counts.items()]
        yield from emit(rows, schema)


def _chunk_bytes(batches: Iterator[pa.RecordBatch], find: Finder) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("digest", pa.int64()), ("first", pa.bool_()), ("data", pa.binary())])
    for batch in batches:
        rows = []
        columns = (batch.column("id").to_pylist(), batch.column("hash").to_pylist(), batch.column("digests").to_pylist(), column_bytes(batch, "text"))
        for i, h, digests, text in zip(*columns):
            wanted = {d["digest"]: d["first"] for d in digests}
            seen = set()
            for _, _, digest, data in find(text):
                if digest in wanted and (digest, data) not in seen:
                    seen.add((digest, data))
                    rows.append((i, h, digest, wanted[digest], data))
        yield from emit(rows, schema, 8192)


def _stripped(batches: Iterator[pa.RecordBatch], find: Finder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, found = batch.column("text"), []
        for text, digests in zip(column_bytes(batch, "text"), batch.column("digests").to_pylist()):
            digests = digests or []
            found.append(strip(text, {d["digest"] for d in digests if not d["first"]}, {d["digest"] for d in digests if d["first"]}, find))
        kept = [None if not t.is_valid else f[3].decode() for t, f in zip(texts, found)]
        columns = [batch.column("row"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_lines", "n_removed_lines", "n_removed_chunks", "kept"])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks, kept_sha256 of every document."""
    return deduplicate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select(
        "row.doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", drop_emptied: bool = False) -> DataFrame:
    """The documents with repeated runs of lines taken out of `text`, and `n_chars` to match where it is a column.

    `drop_emptied`: documents go of which no word is left, all of their lines being
    elsewhere. Those without words before stay as they are.
    """
    new = {text: F.col("kept"), n_chars: F.length("kept").cast("long")}
    kinds = dict(docs.dtypes)
    columns = [
        F.when(F.col("n_removed_chunks") > 0, new[c].cast(kinds[c])).otherwise(F.col("row").getField(c)).alias(c)
        if c in new
        else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ]
    found = deduplicate(docs, doc_id, text, runs)
    if drop_emptied:
        found = found.where((F.col("n_removed_chunks") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*columns)
