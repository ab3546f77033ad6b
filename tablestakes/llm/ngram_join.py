"""Exact Jaccard links of documents over word n-grams, by a blocked sparse product.

The documents' sets of n-grams are the rows of a sparse 0/1 matrix. Its product with
its own transpose holds every pair's overlap; it is never built. What is computed:

1. One pass over the texts: 63-bit n-gram hashes from 64-bit word hashes, distinct and
   sorted. Documents with equal sets become one node, so exact copies cost nothing further.
2. Columns. In any fixed order of the n-grams, two sets of at least the wanted
   similarity share one of each other's first n - ceil(t n) + 1 members, so only that
   part of each row enters the product. The order puts n-grams that are frequent last,
   told by counts of all n-grams of all documents in a fixed number of buckets; it
   changes the work, not the result.
3. Blocks of columns are multiplied in numpy: for the nodes of a shared n-gram the
   overlap counts of their pairs grow by one. Counts are summed over blocks, and pairs
   below the bound their sizes set are discarded: if x's last entered n-gram comes no
   later than y's, x can miss at most n_x - o of its own, o being the wanted overlap.
4. What is left is verified on whole sets.

Large groups of near copies would still be all pairs. So nodes that share a minimum
hash are first tied to one hub each, and the blocks of step 3 only count pairs across
the groups so formed. A tie also needs some likeness in a short sketch of both sets: in a
large corpus nearly every node shares a minimum hash with some other by chance, and such
ties would join most of the corpus to one group. Frequent n-grams do not tie sets that are mostly of others, so
that a passage many documents share makes no group of them. Ties are verified like all other pairs. Where some fail and a
group falls apart, pairs across its parts are sought in blocks of bounded numbers of
nodes: step 2 again, in the order by frequency inside the block, then whole sets
multiplied. Blocks of a group's largest part are not paired with each other. Of a block's links only a forest over its parts is kept: pairs stay inside a
block and never become rows. Every pair of nodes is thus verified, below its bound, or
inside one component already.

What lies on disk at a time is bounded by slices: n-grams are entered a share of them at
a time, and whole sets are made and verified for a share of the candidates' components
at a time, their texts being written once. The slices change no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, drop, emit
from .components import components

WORDS, PERCENT = 5, 80
# Buckets in which all n-grams are counted for their order, and when one is put last:
# how many median deviations above the median, and above how many at least.
ORDER_BITS, ORDER_ABOVE, ORDER_LEAST = 18, 6, 4
HUBS = 3
# Bytes of a node's sketch, from how many of its least n-grams, and one in how many of the
# filled ones must agree for a tie.
SKETCH, SKETCHED, ALIKE = 16, 256, 4
# Into how many slices the work on all n-grams is cut at most, and n-grams below which it is not.
SLICES, ENTRY_SLICES, SLICE_GRAMS = 8, 4, 1 << 25
# Nodes per block, and columns per step, of the products inside a group of near copies;
# up to how many candidates per node they are compared pair by pair instead.
BLOCK, COLUMNS, PAIRWISE = 2_048, 4_096, 16
# Rows of such a product that are compared with their bounds at once.
SLAB = 256
# Nodes per piece of one column that very many nodes share.
COLUMN = 8_192

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
STEP = np.uint64(BASE)
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
SEEDS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
TOP = np.uint64(1 << 63)


class Hasher:
    """Distinct n-gram hashes of a text: from the words' xxh3 hashes, in their order."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self.words, len(words))
        found = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            found = found * STEP + hashed[k : k + len(found)]
        return np.unique(_mixed(found) >> np.uint64(1))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * MIX[0]
    values = (values ^ (values >> np.uint64(27))) * MIX[1]
    return values ^ (values >> np.uint64(31))


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest overlap at which sets of these sizes are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def entered(n, percent: int = PERCENT):
    """How many n-grams of a set of n enter the product."""
    return n - -(-percent * n // 100) + 1


def first_members(grams: np.ndarray, last: np.ndarray, count: int) -> np.ndarray:
    """The first `count` n-grams in the order (not in a bucket of `last`, hash), as signed keys in that order."""
    late = last[bucket(grams)]
    keys = grams[~late][:count]
    if len(keys) < count:
        keys = np.concatenate((keys, grams[late][: count - len(keys)] | TOP))
    return (keys ^ TOP).view(np.int64)


def frequent_buckets(rows: DataFrame, words: int) -> np.ndarray:
    """For each of 2^ORDER_BITS buckets of n-grams, whether all rows together fill it far above the median.

    The n-grams of these buckets come last in the order. The driver takes one number per
    bucket, whatever the size of the corpus.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(words), np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            found = [hasher(t) for t in column_bytes(batch, "text")]
            if found:
                total += np.bincount(bucket(np.concatenate(found)), minlength=len(total))
        filled = np.flatnonzero(total)
        for at in range(0, len(filled), 65536):
            part = filled[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    sums = rows.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << ORDER_BITS, np.int64)
    total[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    median = np.median(total)
    return total > max(median + ORDER_ABOVE * np.median(np.abs(total - median)), ORDER_LEAST)


def bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(63 - ORDER_BITS)).astype(np.int64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Two longs of SKETCH bytes: of the least n-gram in each class of low bits a byte over 0, or 0 where there is none."""
    grams = grams[:SKETCHED][::-1]
    out = np.zeros(SKETCH, np.uint8)
    out[(grams % np.uint64(SKETCH)).astype(np.int64)] = (grams >> np.uint64(8)) % np.uint64(255) + np.uint64(1)  # of a class the last stays, its least
    return out.view(np.int64)


def alike(*sides: tuple[str, str]):
    """Whether enough of the filled bytes of two sketches agree; `sides`: names of their longs, pair by pair."""
    byte = [[F.shiftrightunsigned(c, 8 * k).bitwiseAND(255) for c in pair] for pair in sides for k in range(8)]
    same = sum((F.when((x == y) & (x != 0), 1).otherwise(0) for x, y in byte), F.lit(0))
    filled = sum((F.when((x != 0) | (y != 0), 1).otherwise(0) for x, y in byte), F.lit(0))
    return ALIKE * same >= filled


ROWS = "doc_id long, hash long, node long, proof long, n int, m0 long, m1 long, m2 long, s0 long, s1 long, reach long, grams binary"


def matrix_rows(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """ROWS of every document: node (fingerprint of its set), size, minimum hashes, sketch, entered n-grams."""
    last = rows.sparkSession.sparkContext.broadcast(frequent_buckets(rows, words))
    names = [part.split()[0] for part in ROWS.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 6, pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            out = []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), column_bytes(batch, "text")):
                grams = hasher(text)
                n = len(grams)
                if not n:
                    out.append((doc, key, None, None, 0, *[None] * 7))
                    continue
                print_ = xxhash.xxh3_128_digest(grams.tobytes())
                keys = first_members(grams, last.value, entered(n, percent))
                rare = grams[~last.value[bucket(grams)]]
                tying = rare if 2 * len(rare) >= n else grams
                least = [int(_mixed(tying * s).min().view(np.int64)) for s in SEEDS]
                node, proof = (int.from_bytes(print_[k : k + 8], signed=True) for k in (0, 8))
                out.append((doc, key, node, proof, n, *least, *sketch(tying).tolist(), int(keys[-1]), keys.tobytes()))
            yield from emit(out, schema, 4096)

    return rows.mapInArrow(run, ROWS)


def node_table(matrix: DataFrame) -> DataFrame:
    """One row per distinct set: node, size, minimum hashes, sketch, reach, least doc_id, and one text that has it."""
    same = ["n", "m0", "m1", "m2", "s0", "s1", "reach"]
    by_text = matrix.where("node is not null").groupBy("node", "hash").agg(F.min("doc_id").alias("doc"), *[F.min(c).alias(c) for c in same], F.min("proof").alias("lo"), F.max("proof").alias("hi"))
    return by_text.groupBy("node").agg(
        *[F.min(c).alias(c) for c in same],
        F.min("doc").alias("first_doc"),
        F.min("hash").alias("rep_hash"),
        F.min_by("doc", "hash").alias("rep_doc"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


ENTRIES = "gram long, node long"


def slices(grams: int, of: int, most: int) -> int:
    """Into how many slices work on `grams` of all `of` n-grams is cut, so that each has at most one in `most` of all."""
    return max(1, min(-(-most * grams // max(of, 1)), grams // SLICE_GRAMS))


def _entries(part: int, parts: int):
    """Rows (gram, node) of the entered n-grams of one slice of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = [np.frombuffer(g, np.int64) for g in batch.column("grams").to_pylist()]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(g) for g in grams])
            grams = np.concatenate(grams)
            own = grams % parts == part
            whole = pa.RecordBatch.from_arrays([pa.array(grams[own]), pa.array(nodes[own])], names=["gram", "node"])
            for at in range(0, whole.num_rows, 65536):
                yield whole.slice(at, 65536)

    return run


def shared_entries(kept: DataFrame, sizes: DataFrame, part: int, parts: int) -> DataFrame:
    """gram, node, n, reach of the entered n-grams of one slice that several rows of `kept` (node, grams) have."""
    entries = kept.mapInArrow(_entries(part, parts), ENTRIES)
    shared = entries.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("s_gram"))
    return (
        entries.join(shared, F.col("gram") == F.col("s_gram"), "left_semi")
        .join(sizes, F.col("node") == F.col("z_node"))
        .select("gram", "node", "n", "reach")
    )


def _multiplied(percent: int):
    """Partial overlap counts of the pairs in the pieces of columns, each with its bound."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32()), ("n_shared", pa.int32())])
    names = ("gram", "i", "k", "own", "node", "n", "reach", "part")

    def summed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        fresh = np.flatnonzero(np.concatenate(([True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1))))
        counts = np.diff(np.append(fresh, len(pairs)))
        for at in range(0, len(fresh), 65536):
            part = pairs[fresh[at : at + 65536]]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, k]).cast(f.type) for k, f in enumerate(list(schema)[:3])] + [pa.array(counts[at : at + 65536], pa.int32())], schema=schema)

    def piece(across, own, node, n, reach, part) -> Iterator[np.ndarray]:
        """Rows a, b, need of a piece's nodes, each pair once with a < b; `across`: of its two sides only."""
        _, order = np.unique(node, return_index=True)  # repeated rows count once
        own, node, n, reach, part = (c[order] for c in (own, node, n, reach, part))
        for at in range(len(node) - 1):  # a row of the product against the nodes after it
            other = np.arange(at + 1, len(node))
            other = other[(part[other] != part[at]) & (100 * np.minimum(n[other], n[at]) >= percent * np.maximum(n[other], n[at]))]
            other = other[own[other] != own[at]] if across else other
            if len(other):
                inner = np.where((reach[other] > reach[at]) | ((reach[other] == reach[at]) & (n[at] <= n[other])), n[at], n[other])
                need = least_overlap(n[at], n[other], percent) - inner + entered(inner, percent)
                yield np.stack((np.full(len(other), node[at]), node[other], need), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, rest = [], 0, [np.empty(0, np.int64)] * len(names)
        for batch in chain(batches, [None]):
            if batch is not None:
                rest = [np.concatenate((old, batch.column(c).to_numpy().astype(np.int64))) for old, c in zip(rest, names)]
            gram, i, k = rest[:3]
            starts = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1])))) if len(gram) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(gram))
            whole = len(starts) if batch is None else len(starts) - 1  # the last piece may go on in the next batch
            for start, end in zip(starts[:whole], ends[:whole]):
                for pairs in piece(i[start] != k[start], *(c[start:end] for c in rest[3:])):
                    found.append(pairs)
                    held += len(pairs)
                    if held > 1_000_000:
                        yield from summed(found)
                        found, held = [], 0
            if whole > 0:
                rest = [c[ends[whole - 1] :] for c in rest]
        if found:
            yield from summed(found)

    return run


def shared_pairs(entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different parts whose overlap counts reach their bounds.

    `parts`: node, part; nodes without a row are parts of their own. Columns all of
    whose nodes are in one part are left out before the blocks are dealt. A column of many
    nodes is dealt in pieces of about COLUMN nodes, and every pair of its pieces is a
    product of its own; counts of one pair of nodes are summed whichever piece they are from.
    """
    at = entries.join(parts.select(F.col("node").alias("p_node"), "part"), F.col("node") == F.col("p_node"), "left").select(
        "gram", "node", "n", "reach", F.coalesce("part", "node").alias("part")
    )
    mixed = (
        at.groupBy("gram")
        .agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count(F.lit(1)) / COLUMN).cast("int").alias("pieces"))
        .where("lo <> hi")
        .select(F.col("gram").alias("x_gram"), "pieces")
    )
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    dealt = (
        at.join(mixed, F.col("gram") == F.col("x_gram"))
        .select("gram", "node", "n", "reach", "part", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
        .select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "own", "node", "n", "reach", "part")
    )
    counted = (
        dealt.repartition("gram", "i", "k")
        .sortWithinPartitions("gram", "i", "k")
        .mapInArrow(_multiplied(percent), "a long, b long, need int, n_shared int")
        .groupBy("a", "b", "need")
        .agg(F.sum("n_shared").alias("total"))
    )
    return counted.where("total >= need").select("a", "b")


def hub_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b): every node with the least node of the same minimum hash, if their sketches are alike.

    Which pairs are given out changes the work, not the result.
    """
    pairs = None
    for k in range(HUBS):
        least = [F.min("node").alias("a"), F.min_by("s0", "node").alias("a0"), F.min_by("s1", "node").alias("a1")]
        hubs = nodes.groupBy(F.col(f"m{k}").alias("m")).agg(*least, F.count(F.lit(1)).alias("many")).where("many > 1")
        found = nodes.join(hubs, F.col(f"m{k}") == F.col("m")).where("node <> a").where(alike(("s0", "a0"), ("s1", "a1"))).select("a", F.col("node").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def of_like_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes (z_node, n) allow the wanted similarity."""
    left, right = (sizes.select(F.col("z_node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n")) for c in "ab")
    met = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))
    return met.where(100 * F.least("a_n", "b_n").cast("long") >= percent * F.greatest("a_n", "b_n").cast("long")).select("a", "b")


def wanted_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and one text (w_doc, w_text) of the nodes in `pairs`."""
    named = pairs.select("a").unionByName(pairs.select("b").withColumnRenamed("b", "a")).distinct()
    return nodes.join(named, F.col("node") == F.col("a"), "left_semi").select("node", "n", F.col("rep_doc").alias("w_doc"), F.col("rep_hash").alias("w_text"))


def texts_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """node, slice, text of the nodes in `wanted` (node, slice, w_doc, w_text)."""
    same = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("hash") == F.col("w_text"))
    return rows.join(wanted.hint("merge"), same).select("node", "slice", "text")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """node, size, half, members of the nodes in `texts` (node, text): whole sets, made anew."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            found = [hasher(t) for t in column_bytes(batch, "text")]
            short = [s[s & np.uint64(1) == 0] >> np.uint64(31) for s in found]  # still sorted
            columns = [
                batch.column("node"),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([s.astype(np.uint32).tobytes() for s in short], pa.binary()),
                pa.array([s.tobytes() for s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "half", "members"])

    return texts.select("node", "text").mapInArrow(sets, "node long, size int, half binary, members binary")


def _passing(pairs: DataFrame, members: DataFrame, column: str, holds) -> DataFrame:
    """The pairs for which holds(left set, right set, left size, right size)."""
    left = members.select(F.col("node").alias("a_node"), F.col("size").alias("a_size"), F.col(column).alias("left"))
    right = members.select(F.col("node").alias("b_node"), F.col("size").alias("b_size"), F.col(column).alias("right"))
    kind = np.uint32 if column == "half" else np.uint64

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("a_size").to_pylist(), batch.column("b_size").to_pylist())
            keep = [
                holds(np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind), m, n)
                for x, y, (m, n) in zip(batch.column("left"), batch.column("right"), sizes)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(right, F.col("b") == F.col("b_node")).join(left, F.col("a") == F.col("a_node"))
    return met.select("a", "b", "a_size", "b_size", "left", "right").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough.

    First on the n-grams with an even hash, 32 bits each: cutting hashes short can only
    raise an overlap, and a set may miss no more of this half than of the whole. What
    passes is decided on the whole sets.
    """

    def overlap(x: np.ndarray, y: np.ndarray) -> int:
        both = np.sort(np.concatenate((x, y)))
        return int((both[1:] == both[:-1]).sum())

    def possible(x: np.ndarray, y: np.ndarray, m: int, n: int) -> bool:
        wanted = least_overlap(m, n, percent)
        return wanted <= min(m, n) and max(len(x) - m, len(y) - n) + wanted <= overlap(x, y)

    def similar(x: np.ndarray, y: np.ndarray, m: int, n: int) -> bool:
        return overlap(x, y) >= least_overlap(m, n, percent)

    left = cut(_passing(pairs, members, "half", possible))
    links = cut(_passing(left, members, "members", similar))
    drop(left)
    return links


def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, column) of a block of sets, by column, and how many rows each column has."""
    grams = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    column = np.cumsum(np.concatenate(([0], (grams[1:] != grams[:-1]).astype(np.int64))))
    return rows, column, np.bincount(column)


def candidates(rows: np.ndarray, column: np.ndarray, many: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of a block that share one of the rarest n - ceil(t n) + 1 n-grams of each, as a matrix.

    The order is by rows of the column in this block, so n-grams of one row alone, which
    no pair shares, fill these places first: sets that only share a common passage meet
    nowhere. Where more pairs would be marked than there are, all count as candidates.
    """
    order = np.lexsort((column, many[column], rows))
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(order)) - first[rows[order]]
    picked = order[at < entered(sizes, percent)[rows[order]]]
    picked = np.sort(picked[many[column[picked]] > 1])  # by column again
    met = np.zeros((len(sizes), len(sizes)), bool)
    if (np.bincount(column[picked]).astype(np.int64) ** 2).sum() > met.size:
        return ~met  # a product costs less than telling which pairs meet
    if len(picked):
        for same in np.split(rows[picked], np.flatnonzero(np.diff(column[picked])) + 1):
            if len(same) > 1:
                met[same[:, None], same] = True
    return met


def product(rows: np.ndarray, column: np.ndarray, many: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlaps of the rows `left` with the rows `right`: one incidence matrix times the other's transpose."""
    shared = many[column] > 1
    rows, column = rows[shared], (np.cumsum(many > 1) - 1)[column[shared]]
    place = np.full((2, int(max(side.max(initial=-1) for side in (left, right, rows))) + 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        blocks = []
        for side, count in ((0, len(left)), (1, len(right))):
            own = place[side, rows[part]]
            block = np.zeros((count, COLUMNS), np.float32)
            block[own[own >= 0], column[part][own >= 0] - at] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total


def near_pairs(sets: list[np.ndarray], part: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of the similar pairs of a block that are in different parts, some at a time.

    Candidates are decided one by one, or where they are many by a product of the rows
    concerned; both count whole sets.
    """
    sizes = np.array([len(s) for s in sets])
    rows, column, many = incidence(sets)
    met = candidates(rows, column, many, sizes, percent)
    for at in range(0, len(sets), SLAB):
        slab = slice(at, at + SLAB)
        met[slab] &= part[slab, None] != part
        met[slab] &= 100 * np.minimum(sizes[slab, None], sizes) >= percent * np.maximum(sizes[slab, None], sizes)
    if np.count_nonzero(met) <= 2 * PAIRWISE * len(sets):
        a, b = np.nonzero(np.triu(met, 1))
        both = (np.sort(np.concatenate((sets[x], sets[y]))) for x, y in zip(a, b))
        overlaps = np.array([int((s[1:] == s[:-1]).sum()) for s in both], np.int64)
        near = overlaps >= least_overlap(sizes[a], sizes[b], percent)
        yield a[near], b[near]
        return
    names, counts = np.unique(part, return_counts=True)
    involved = met.any(axis=1)
    main = part == names[counts.argmax()]  # no pair lies inside it, so it is a right side only
    left, right = np.flatnonzero(involved & ~main), np.flatnonzero(involved)
    overlaps = product(rows, column, many, left, right)
    for at in range(0, len(left), SLAB):
        own = left[at : at + SLAB]
        near = met[own][:, right] & (main[right] | (own[:, None] < right))
        near &= overlaps[at : at + SLAB] >= least_overlap(sizes[own][:, None], sizes[right], percent)
        a, b = np.nonzero(near)
        yield own[a], right[b]


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Places of links (a, b) that join what all of them join, without a cycle; ends are below `size`.

    Every tree hooks on one with a smaller label, so at most size - 1 links are kept.
    """
    label, at, kept = np.arange(size), np.arange(len(a)), []
    while True:
        ends = np.sort(np.stack((label[a[at]], label[b[at]])), axis=0)
        apart = ends[0] != ends[1]
        at, (low, high) = at[apart], ends[:, apart]
        if not len(at):
            return np.concatenate(kept) if kept else np.empty(0, np.int64)
        picked = np.full(size, -1)
        picked[high] = np.arange(len(high))
        picked = picked[picked >= 0]
        kept.append(at[picked])
        hook = np.arange(size)
        hook[high[picked]] = low[picked]
        while (hook[hook] != hook).any():
            hook = hook[hook]
        label = hook[label]


def block_pairs(parts: DataFrame) -> DataFrame:
    """tie, i, k, node, part: every node once per pair of blocks (i, k) of its group that it is compared in.

    The largest part of a group has blocks of its own, after those of all other nodes. No
    link is sought inside it, so its nodes meet the other nodes' blocks only and are copied as
    often as there are such blocks. A group of up to BLOCK nodes is one block.
    """
    counts = parts.groupBy(F.col("tie").alias("t_tie"), "part").agg(F.count(F.lit(1)).alias("many"))
    sizes = counts.groupBy("t_tie").agg(F.sum("many").alias("all"), F.max(F.struct("many", "part")).alias("main"))
    blocks = lambda many: F.ceil(many / BLOCK).cast("int")
    dealt = sizes.select(
        "t_tie",
        F.when(F.col("all") > BLOCK, F.col("main.part")).alias("main"),
        F.when(F.col("all") > BLOCK, blocks(F.col("all") - F.col("main.many"))).otherwise(1).alias("rest"),
        F.when(F.col("all") > BLOCK, blocks(F.col("main.many"))).otherwise(0).alias("more"),
    )
    inside = F.coalesce(F.col("part") == F.col("main"), F.lit(False))
    at = F.xxhash64("node")
    own = F.when(inside, F.col("rest") + F.pmod(at, F.greatest("more", F.lit(1)))).otherwise(F.pmod(at, F.col("rest"))).cast("int")
    last = F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1
    return (
        parts.join(dealt, F.col("tie") == F.col("t_tie"))
        .select("tie", "node", "part", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        .select("tie", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "node", "part")
    )


def links_across(parts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between the parts of each tied group, from whole sets: a forest per pair of blocks.

    `parts`: node, tie, part. A group's nodes are dealt to blocks of about BLOCK nodes, and
    every pair of its blocks that block_pairs() names is one product of bounded size.
    """
    dealt = block_pairs(parts).join(members.withColumnRenamed("node", "m_node"), F.col("node") == F.col("m_node")).select("tie", "i", "k", "node", "part", "members")

    def linked(group: list[tuple]) -> Iterator[tuple]:
        node, part = (np.array([g[c] for g in group]) for c in (0, 1))
        if len(group) < 2 or (part == part[0]).all():
            return
        sets = [np.frombuffer(g[2], np.uint64) for g in group]
        _, place = np.unique(part, return_inverse=True)
        kept = np.empty((2, 0), np.int64)
        for pairs in near_pairs(sets, part, percent):
            kept = np.concatenate((kept, pairs), axis=1)
            kept = kept[:, forest(*place[kept], int(place.max()) + 1)]
        for a, b in node[kept].T:
            yield int(a), int(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            key, group = None, []
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("tie", "i", "k", "node", "part", "members")]
                for tie, i, k, *rest in zip(*columns):
                    if (tie, i, k) != key:
                        yield from linked(group)
                        key, group = (tie, i, k), []
                    group.append(rest)
            yield from linked(group)

        yield from emit(results(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.repartition("tie", "i", "k").sortWithinPartitions("tie", "i", "k").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id is the smallest doc_id reachable by links, itself included. Null, empty
    and wordless texts have no n-grams and link with nothing; texts of fewer words than
    an n-gram are one n-gram. Copies are one node. Rows that share a doc_id are nodes of
    their own if their sets differ. Rows without doc_id take part in links; a component
    without any doc_id has a null id. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    matrix = cut(matrix_rows(rows, words, percent))
    nodes = cut(node_table(matrix))
    if clash := nodes.where("lo <> hi").select("node").first():
        raise ValueError(f"two sets share the fingerprint {clash.node}; change BASE")
    total = nodes.agg(F.sum(F.col("n").cast("long")).alias("n")).first().n or 0

    rep = nodes.select(F.col("node").alias("r_node"), F.col("rep_doc").alias("r_doc"), F.col("rep_hash").alias("r_hash"))
    own = (F.col("node") == F.col("r_node")) & (F.col("hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_doc"))
    kept = cut(matrix.join(rep, own, "left_semi").select("node", "grams"))
    node_of = cut(matrix.select("doc_id", "node", "n"))
    drop(matrix)
    sizes = nodes.select(F.col("node").alias("z_node"), "n", "reach")
    parts = slices(total, total, ENTRY_SLICES)
    sliced = [cut(shared_entries(kept, sizes, k, parts)) for k in range(parts)]
    drop(kept)

    hubs = cut(hub_pairs(nodes))
    tied = components(hubs).withColumnRenamed("component", "part")
    shared = cut(shared_pairs(reduce(DataFrame.unionByName, sliced), tied, percent))
    drop(*sliced)
    pairs = cut(of_like_size(hubs, sizes, percent).unionByName(shared).distinct())
    wanted = cut(wanted_nodes(hubs.unionByName(shared), nodes))
    parts = slices(wanted.agg(F.sum(F.col("n").cast("long")).alias("n")).first().n or 0, total, SLICES)
    if parts > 1:  # a component lies in one slice, and with it all that its pairs and ties need
        ends = cut(shared.unionByName(tied.select(F.col("node").alias("a"), F.col("part").alias("b"))))
        at = F.pmod(F.xxhash64("component"), F.lit(parts)).cast("int").alias("slice")
        dealt = cut(wanted.join(components(ends).select(F.col("node").alias("w_node"), at), F.col("node") == F.col("w_node")).drop("w_node"))
        drop(wanted, ends)
        wanted = dealt
    else:
        dealt = wanted.withColumn("slice", F.lit(0))
    texts = cut(texts_of(dealt, rows))

    edges = []
    for k in range(parts):
        part = dealt.where(F.col("slice") == k).select(F.col("node").alias("w_node"))
        of_slice = lambda df, name: df.join(part, F.col(name) == F.col("w_node"), "left_semi") if parts > 1 else df  # noqa: B023, E731
        members = cut(sets_of(texts.where(F.col("slice") == k), words))
        links = verified(of_slice(pairs, "a"), members, percent)
        found = components(links)

        # Groups whose ties did not all hold: look across their parts too.
        now = cut(
            of_slice(tied, "node").join(found.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left").select(
                "node", F.col("part").alias("tie"), F.coalesce("component", "node").alias("part")
            )
        )
        broken = now.groupBy("tie").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(F.col("tie").alias("b_tie"))
        broken = cut(now.join(broken, F.col("tie") == F.col("b_tie"), "left_semi"))
        across = cut(links_across(broken, members, percent))
        edges.append(cut(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across)))
        drop(now, broken, members, links, across)
    drop(hubs, shared, pairs, wanted, texts)  # `tied` may still have been read from the hubs
    found = components(reduce(DataFrame.unionByName, edges))

    labelled = nodes.join(found.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left").select(
        "node", "first_doc", F.coalesce("component", "node").alias("component")
    )
    labelled = cut(labelled)
    drop(nodes, *edges)
    least = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id")).withColumnRenamed("component", "c")
    named = labelled.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("l_node"), "component_id")
    return node_of.join(named, F.col("node") == F.col("l_node"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of linked documents: that with the smallest doc_id.

    Documents without n-grams and rows without doc_id stay. Repeated rows of the kept
    doc_id all stay. The dropped ids are written first, so Spark sees their size before
    it picks the join.
    """
    groups = link(docs, doc_id, text)
    dropped = cut(groups.where("doc_id is not null and component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("d_id")).distinct())
    return docs.join(dropped, docs[doc_id] == dropped["d_id"], "left_anti")
