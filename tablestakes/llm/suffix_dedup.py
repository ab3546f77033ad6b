"""Bytes inside strings of 200 bytes that start more than once, by suffix arrays over shards.

1. Routing. Every window of 200 bytes names one anchor inside it: its 64-byte string
   with the least hash, leftmost if tied. Equal windows name equal anchors, so all
   places where a window may repeat meet under their anchor's hash. The windows of one
   anchor lie together; the bytes they cover are the anchor's context. Anchors that
   occur once cannot hold a repeat and go no further. Equal contexts are aggregated
   (map-side combine), so a large group of copies is one context with a count.
2. Shards. The different contexts of repeated anchors are dealt by anchor and cut into
   shards of bounded size at anchor borders. Each shard gets a suffix array by
   Larsson-Sadakane refinement (prefix doubling that re-sorts only suffixes still tied)
   and common prefixes by Kasai's walk in text order. A window repeats if it shares 200
   bytes with a neighbour in the suffix array.
3. Very many contexts. The contexts of an anchor that would not fit one shard are split
   into their windows, which are dealt by 128-bit digest and counted as they pass. No
   group of rows is held there, so an anchor may have any number of contexts.
4. Merging. A route that still fills more than one shard has the shards' sorted windows
   merged by binary search.

Windows of contexts with a count above one repeat anyway. Runs go back to their
documents by key; a document is the largest thing a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, emit
from .ngram_join import BASE, _mixed

WINDOW, ANCHOR = 200, 64
# Text per shard of several routes.
SHARD_BYTES = 1 << 20
# Places of a shard are numbers of this many bits; two ranks and a place make one word.
PLACE_BITS = 21
PLACES = 1 << PLACE_BITS
# Contexts of one anchor beyond which it is split into windows: as many as surely fit one shard.
MANY_CONTEXTS = PLACES // (2 * WINDOW - ANCHOR + 1)


class Rolling:
    """Hashes of all strings of `size` bytes of a text, from polynomial prefix sums."""

    def __init__(self, size: int):
        self.size, self.powers, self.inverses = size, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.powers):
            for name, base in (("powers", BASE), ("inverses", pow(BASE, -1, 1 << 64))):
                table = np.full(2 * n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        count = n - self.size + 1
        return _mixed((sums[self.size :] - sums[:count]) * self.inverses[:count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width`."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(text: bytes, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, place and hash of every anchor of a text."""
    data = np.frombuffer(text, np.uint8)
    hashes = rolling(data)
    high = np.uint64(32)
    packed = (hashes >> high << high) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_least(packed, WINDOW - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    return first, last, at, hashes[at].view(np.int64)


# ---- suffix arrays -----------------------------------------------------------------


class Shard:
    """Suffix array of contexts laid end to end, each followed by one separator."""

    def __init__(self, contexts: list[bytes]):
        self.lengths = np.array([len(c) for c in contexts])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)[:-1]))
        ends = self.starts + self.lengths
        size = int(ends[-1]) + 1
        if size > PLACES:
            raise ValueError("a shard has at most 2^21 places")
        self.text = np.zeros(size + WINDOW, np.uint16)  # 0 parts contexts, bytes are 1 to 256
        self.text[:size] = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
        self.text[:size] += 1
        self.text[ends] = 0
        self.left = (np.repeat(ends, self.lengths + 1) - np.arange(size)).astype(np.int32)  # bytes to the end of the context
        self.all = self._sort(size)  # the suffix array
        self.common = self._kasai(size)
        self.order = self.all[self.left[self.all] >= WINDOW]  # the windows in suffix order

    def _sort(self, size: int) -> np.ndarray:
        """Places in suffix order; a separator is less than all bytes, and separators differ by place."""
        symbols = np.flatnonzero(np.bincount(self.text, minlength=257))
        bits = int(len(symbols)).bit_length()
        code = np.zeros(257, np.uint64)
        code[symbols] = np.arange(len(symbols))  # the separator is symbol 0
        coded = code[self.text]
        depth = 2 * PLACE_BITS // bits
        key = coded[:size].copy()
        for k in range(1, depth):
            key <<= np.uint64(bits)
            key |= coded[k : k + size]
        short = np.flatnonzero(self.left < depth)
        beyond = (bits * (depth - self.left[short])).astype(np.uint64)
        key[short] = key[short] >> beyond << beyond  # nothing after the separator counts
        rank = np.zeros(size, np.uint64)
        tied = self._refine(rank, np.arange(size), key, depth)
        while len(tied):
            tied = self._refine(rank, tied, rank[tied] << np.uint64(PLACE_BITS) | rank[tied + depth], 0)
            depth *= 2
        order = np.empty(size, np.int64)
        order[rank.view(np.int64)] = np.arange(size)
        return order

    def _refine(self, rank: np.ndarray, places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
        """Sorts tied places by their keys inside their groups, sets their ranks, returns those still tied.

        Key and place are sorted as one number. A group's rank is the first place it takes
        in the order. Suffixes that end before `depth` and are equal are told apart by
        their separators, that is by place.
        """
        packed = np.sort(keys << np.uint64(PLACE_BITS) | places.view(np.uint64))
        places, keys = (packed & np.uint64(PLACES - 1)).view(np.int64), packed >> np.uint64(PLACE_BITS)
        fresh = np.empty(len(places), bool)
        fresh[0] = True
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        if depth:
            fresh |= self.left[places] < depth
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(places)))
        before = rank[places]
        opens = np.flatnonzero(before[1:] != before[:-1]) + 1  # where an old group starts
        base = np.repeat(np.concatenate(([0], opens)), np.diff(np.concatenate(([0], opens, [len(places)]))))
        rank[places] = before + (np.repeat(heads, sizes) - base).astype(np.uint64)
        return places[np.repeat(sizes > 1, sizes)]

    def _kasai(self, size: int) -> np.ndarray:
        """Common prefix of every suffix with the one before it in the order.

        Kasai's walk: the common prefix at the next place is at least one less. All contexts
        are walked side by side, one place each per step.
        """
        before = np.empty(size, np.int64)
        before[self.all[0]] = size - 1  # a separator: nothing in common
        before[self.all[1:]] = self.all[:-1]
        eights = ((self.text - 1) & 0xFF).astype(np.uint64)  # eight bytes at a time; room keeps separators out
        for width in (1, 2, 4):
            eights[:-width] = eights[:-width] << np.uint64(8 * width) | eights[width:]
        common = np.zeros(size, np.int64)
        held = np.zeros(len(self.starts), np.int64)
        starts = self.starts
        for step in range(int(self.lengths.max())):
            lane = np.flatnonzero(self.lengths > step)
            held[lane] = np.maximum(held[lane] - 1, 0)
            for width, words in ((8, eights), (1, self.text)):
                active, here = lane, starts[lane] + step
                other, h = before[here], held[lane]
                while len(active):
                    room = np.minimum(self.left[here], self.left[other]) - h >= width
                    on = np.flatnonzero(room & (words[here + h] == words[other + h]))
                    active, here, other, h = active[on], here[on], other[on], h[on] + width
                    held[active] = h
            common[starts[lane] + step] = held[lane]
        return common

    def repeats(self) -> np.ndarray:
        """For every place, whether its window also starts at another place of the shard."""
        same = self.common[self.order] >= WINDOW
        found = np.zeros(len(self.left), bool)
        found[self.order[same]] = True
        found[self.order[:-1][same[1:]]] = True
        return found

    def window(self, place: int) -> bytes:
        return (self.text[place : place + WINDOW] - np.uint64(1)).astype(np.uint8).tobytes()

    def sorted_windows(self) -> np.ndarray:
        found = np.empty(len(self.order), object)
        found[:] = [self.window(p) for p in self.order]
        return found

    def classes_of(self, index: np.ndarray) -> np.ndarray:
        """All indices of the sorted windows equal to those at `index`."""
        same = np.concatenate(([0], np.cumsum(self.common[self.order[1:]] < WINDOW)))
        return np.flatnonzero(np.isin(same, same[index]))


def merge(shards: list[Shard], found: list[np.ndarray]) -> None:
    """Marks windows that occur in two shards, by binary search of one sorted order in another."""
    windows = [s.sorted_windows() for s in shards]
    for i in range(len(shards)):
        for k in range(i):
            if not len(windows[i]) or not len(windows[k]):
                continue
            at = np.minimum(np.searchsorted(windows[k], windows[i]), len(windows[k]) - 1)
            same = windows[k][at] == windows[i]
            found[i][shards[i].order[same]] = True
            found[k][shards[k].order[shards[k].classes_of(np.unique(at[same]))]] = True


# ---- the job -----------------------------------------------------------------------

ANCHORS = "id long, key long, lo int, hi int, h long, c long"
CONTEXTS = "route long, id long, key long, lo int, n long, data binary"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(ANCHOR)
    names = ["id", "key", "lo", "hi", "h", "c"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        parts: list[list] = [[] for _ in names]
        ids = batch.column("id")
        rows, counts = [], []
        for row, text in enumerate(column_bytes(batch, "text")):
            if len(text) < WINDOW:
                continue
            lo, hi, _, h = anchors(text, rolling)
            ends = (hi + WINDOW).tolist()
            c = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(lo.tolist(), ends)]
            rows.append(row)
            counts.append(len(lo))
            for part, column in zip(parts[2:], (lo, hi, h, np.array(c, np.uint64).view(np.int64))):
                part.append(column)
        if not rows:
            continue
        take = pa.array(np.repeat(rows, counts))
        columns = [ids.take(take), batch.column("key").take(take)] + [pa.array(np.concatenate(p)).cast(k) for p, k in zip(parts[2:], kinds[2:])]
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for start in range(0, whole.num_rows, 65536):
            yield whole.slice(start, 65536)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts; those of anchors with very many become windows.

    A window is dealt by one half of its digest and carries the other as `data`, which
    is shorter than any context.
    """
    schema = pa.schema([("route", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = (batch.column("id").to_pylist(), batch.column("key").to_pylist(), column_bytes(batch, "text"), batch.column("wanted"))
        for i, key, text, wanted in zip(*columns):
            for w in wanted.as_py():
                lo, hi = w["lo"], w["hi"]
                if not w["many"]:
                    yield w["h"], i, key, lo, w["n"], text[lo : hi + WINDOW]
                    continue
                for a in range(lo, hi + 1):
                    digest = xxhash.xxh3_128_digest(text[a : a + WINDOW])
                    yield int.from_bytes(digest[:8], signed=True), i, key, a, w["n"], digest[8:]

    for batch in batches:
        yield from emit(rows(batch), schema, 4096)


RUNS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _runs(rows: list[tuple], found: np.ndarray, shard: Shard) -> Iterator[tuple]:
    """Runs of repeated windows of the contexts that occur once, in places of their documents."""
    for (i, key, lo, n), start, length in zip(rows, shard.starts, shard.lengths):
        if n > 1:
            continue
        hits = np.flatnonzero(found[start : start + length])
        if len(hits):
            breaks = np.flatnonzero(np.diff(hits) > 1)
            for a, b in zip(np.append(hits[0], hits[breaks + 1]), np.append(hits[breaks], hits[-1])):
                yield i, key, int(lo + a), int(lo + b + WINDOW)


def _shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of a partition sorted by route: shards end at route borders, or are merged.

    A shard of several routes holds at most SHARD_BYTES. A route that will not fit with
    those before it goes on alone, and into further shards at PLACES.
    """

    def results() -> Iterator[tuple]:
        rows: list[tuple] = []
        data: list[bytes] = []
        size = border = size_at_border = 0  # of the open shard; where its last route starts
        running = None
        open_shards: list[tuple[list[tuple], Shard]] = []  # of the one route that fills more than a shard
        windows: dict[bytes, tuple] = {}  # first row of each window of a route; n is above 1 once it is given out

        def close() -> Iterator[tuple]:
            shards = [s for _, s in open_shards]
            found = [s.repeats() for s in shards]
            if len(shards) > 1:
                merge(shards, found)
            for (kept, shard), marks in zip(open_shards, found):
                yield from _runs(kept, marks, shard)
            open_shards.clear()

        def window(row: tuple, digest: bytes) -> Iterator[tuple]:
            if digest not in windows:
                windows[digest] = row
                return
            for i, key, lo, n in (windows[digest], row):
                if n == 1:  # the others repeat as whole contexts
                    yield i, key, lo, lo + WINDOW
            windows[digest] = (*row[:3], 2)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("route", "id", "key", "lo", "n", "data")]
            for route, i, key, lo, n, context in zip(*columns):
                if route != running:
                    windows.clear()
                    if open_shards:
                        open_shards.append((rows, Shard(data)))
                        yield from close()
                        rows, data, size = [], [], 0
                    running, border, size_at_border = route, len(rows), size
                if len(context) < WINDOW:
                    yield from window((i, key, lo, n), context)
                    continue
                if border and size + len(context) + 1 > SHARD_BYTES:
                    open_shards.append((rows[:border], Shard(data[:border])))
                    yield from close()
                    rows, data, size, border = rows[border:], data[border:], size - size_at_border, 0
                if rows and size + len(context) + 1 > PLACES:
                    open_shards.append((rows, Shard(data)))
                    rows, data, size = [], [], 0
                rows.append((i, key, lo, n))
                data.append(context)
                size += len(context) + 1
        if rows:
            open_shards.append((rows, Shard(data)))
        if open_shards:
            yield from close()

    yield from emit(results(), RUNS, 8192)


REMOVED = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, runs in zip(column_bytes(batch, "text"), batch.column("runs")):
            spans: list[list[int]] = []
            for run in sorted((r["start"], r["end"]) for r in runs.as_py() or ()):
                if spans and run[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], run[1])
                else:
                    spans.append(list(run))
            borders = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2]))
            found.append((len(text), len(text) - len(kept), len(spans), kept))
        columns = {"row": batch.column("row")} | {n: pa.array([f[k] for f in found], t) for k, (n, t) in enumerate(REMOVED)}
        yield pa.RecordBatch.from_pydict(columns)


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """(id, key, start, end): runs of bytes of repeated windows, from columns id, key, text."""
    found = cut(keyed.mapInArrow(_anchor_rows, ANCHORS))
    often = found.groupBy("h").count().where("count > 1").select(F.col("h").alias("o_h"))
    found = cut(found.join(often, F.col("h") == F.col("o_h"), "left_semi"))
    contexts = cut(
        found.groupBy("h", "c").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("key").alias("key"),
            *[F.min_by(c, "key").alias(c) for c in ("id", "lo", "hi")],
        )
    )
    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    several = several.select(F.col("h").alias("s_h"), (F.col("kinds") > MANY_CONTEXTS).alias("many"))
    wanted = (
        contexts.join(several, F.col("h") == F.col("s_h"))
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("h", "n", "lo", "hi", "many")).alias("wanted"))
        .withColumnsRenamed({"id": "w_id", "key": "w_key"})
    )
    same = (F.col("key") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id"))
    sharded = (
        keyed.join(cut(wanted), same)
        .select("id", "key", "text", "wanted")
        .mapInArrow(_context_rows, CONTEXTS)
        .repartition("route")
        .sortWithinPartitions("route")
        .mapInArrow(_shard_runs, "id long, key long, start int, end int")
    )
    copies = contexts.where("n > 1").select(F.col("h").alias("c_h"), F.col("c").alias("c_c"))
    whole = found.join(copies, (F.col("h") == F.col("c_h")) & (F.col("c") == F.col("c_c")), "left_semi").select(
        "id", "key", F.col("lo").alias("start"), (F.col("hi") + WINDOW).alias("end")
    )
    return sharded.unionByName(whole)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Struct `row` (all columns) and n_bytes, n_removed, n_spans, kept (bytes) of every document.

    Null and empty texts, and texts below 200 bytes, lose nothing. Rows that repeat a
    document are documents too: both lose what they share. All strings are judged on the
    input. Columns of any name pass through inside `row`.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text"), F.struct("*").alias("row"))
    runs = cut(repeated_runs(keyed.select("id", "key", "text")).groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("runs")))
    runs = runs.withColumnsRenamed({"id": "r_id", "key": "r_key"})
    same = (F.col("key") == F.col("r_key")) & F.col("id").eqNullSafe(F.col("r_id"))
    met = keyed.select("id", "key", "row").join(runs, same, "left")
    return met.select("row", F.col("row").getField(text).alias("text"), "runs").mapInArrow(
        _removed, f"row {docs.schema.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
