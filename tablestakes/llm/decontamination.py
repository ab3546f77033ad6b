"""Benchmark passages in documents, found by Wu-Manber search over words.

The symbols of the search are words, a block is two adjacent words. For each
pattern length the shift table says how far the window may jump when its last
block is no block of any pattern (the usual case: length - 1 words) or one deep
inside a pattern; only windows whose last block ends a pattern open a bucket,
whose entries are picked by their first block and then compared word by word.

The benchmark is the stated query set. It is read in blocks of bounded size, each
broadcast by itself; the documents pass through the blocks one after another,
without a shuffle, and are written after every few blocks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, drop

WINDOW = 10
# Benchmark text per broadcast block.
BLOCK_BYTES = 16 << 20
# Blocks one task searches before its rows are written.
BLOCKS_AT_ONCE = 4

# A-Z to a-z; digits, letters and all bytes of non-ASCII characters stay; the rest parts words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) < window:
        return {tuple(words)}
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


class WuManber:
    """Patterns of one length: shift table by block, buckets by last and first block."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - end)
            self.buckets[pattern[-self.block :]][pattern[: self.block]].append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of every occurrence."""
        n, size, block, furthest, shift = len(words), self.length, self.block, self.furthest, self.shift
        end = size
        while end <= n:
            last = tuple(words[end - block : end])
            jump = shift.get(last, furthest)
            if jump:
                end += jump
                continue
            start = end - size
            for pattern in self.buckets[last].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, self.patterns[pattern]
            end += 1


def searchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for pattern in windows_of(words_of(text), window):
            by_length[len(pattern)][pattern].add(item)
    return [WuManber(length, dict(patterns)) for length, patterns in sorted(by_length.items())]


def find(words: list[bytes], tables: list[WuManber]) -> tuple[np.ndarray | None, set[str]]:
    """Which words are hit (None: none) and which items occur."""
    hit, items = None, set()
    for table in tables:
        for start, found in table.search(words):
            if hit is None:
                hit = np.zeros(len(words), bool)
            hit[start : start + table.length] = True
            items |= found
    return hit, items


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The query set in blocks of about `block_bytes`; rows without id or text are left out."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r.item, r.text.encode()) for r in part.collect()]


def search_block(state: DataFrame, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    """Adds one block's hits to the columns `hit` (packed bits) and `items`."""
    sent = state.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(sent.value, window)
        for batch in batches:
            hits, named = [], []
            for text, before, items in zip(column_bytes(batch, "text"), batch.column("hit").to_pylist(), batch.column("items").to_pylist()):
                words = words_of(text)
                hit, found = find(words, tables)
                if before and hit is not None:
                    hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)).astype(bool)
                hits.append(before if hit is None else np.packbits(hit).tobytes())
                named.append(sorted(found.union(items)) if found else items)
            for name, values in (("hit", pa.array(hits, pa.binary())), ("items", pa.array(named, pa.list_(pa.string())))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, values)
            yield batch

    return state.mapInArrow(run, state.schema)


def _by_blocks(rows: DataFrame, blocks: Iterable[list[tuple[str, bytes]]], step: Callable[[DataFrame, list], DataFrame]) -> DataFrame:
    """One step per block; written after every BLOCKS_AT_ONCE, which bounds the workers and tables a task has at once."""
    written = None
    for k, block in enumerate(blocks):
        if k and k % BLOCKS_AT_ONCE == 0:
            spent, written = written, cut(rows)
            rows = written
            if spent is not None:
                drop(spent)
        rows = step(rows, block)
    return rows


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every whole document.

    Null and empty texts have no words. Repeated document rows each get their row;
    benchmark rows that share an id count as one item, those without id or text are
    no items. An empty benchmark hits nothing. Other columns are not read.
    """
    state = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.lit(None).cast("binary").alias("hit"),
        F.array().cast("array<string>").alias("items"),
    )
    state = _by_blocks(state, benchmark_blocks(benchmark, item_id, item_text, block_bytes), lambda rows, block: search_block(rows, block, window))
    kind = state.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in batch.column("hit").to_pylist()]
            items = batch.column("items").to_pylist()
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([len(words_of(t)) for t in column_bytes(batch, "text")], pa.int64()),
                "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([len(i) for i in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
                "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return state.mapInArrow(
        sums, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    Documents without text stay. Nothing is shuffled; rows pass as they are.
    """
    return _by_blocks(docs, benchmark_blocks(benchmark, item_id, item_text), lambda rows, block: _drop_hits(rows, block, text, window))


def _drop_hits(docs: DataFrame, block: list[tuple[str, bytes]], text: str, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(sent.value, window)
        for batch in batches:
            keep = [not any(True for t in tables for _ in t.search(words)) for words in map(words_of, column_bytes(batch, text))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
