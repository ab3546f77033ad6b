"""Alignment of two tokenizers' tokens of the same text by merge-path partitioning.

Both tokenizers cut a text's bytes; their tokens are two sorted lists of end offsets, and
aligning them is merging these lists. The merge of a run of texts is a path through the
grid of A's and B's ends. Binary searches along equally spaced diagonals cut that path
into pieces of equal work, however the tokens lie, and every piece is merged by itself:
it gives out the overlapping pairs its steps end, and the places where an A and a B token
end together. Groups begin and end at such places, so those that cross a border between
pieces are stitched from the places alone.

A space-led unit (white space and what follows up to the next white space) is never
crossed by a token of A; B's pieces are looked through for white space they join to what
stands before it, and texts with such signs are encoded whole. Units are encoded by the tokenizers' own libraries once per worker and remembered
by number, so that a text becomes two gathers of ids. A text with a unit whose bytes do
not come back is encoded whole, as the library gives it.

Corpus counts take two steps. Workers deal texts into chunks of bounded size; of a chunk
only its distinct id pairs, each with its number of texts, become rows to be summed, and
only these get their totals back, so neither tokens nor links are ever shuffled.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settings
from .token_counts import SETTLED, load

A_FILE = "byte_bpe_50k.json"
A_RANKS = "byte_bpe_50k.tiktoken"
B_FILE = "piece_bpe_32k.model"
# Steps of the merge in one piece.
PIECE = 1 << 16
# Bytes of text that are laid out at once, and links after which a chunk is closed: both
# bound a worker's memory, up to one text.
RUN_BYTES = 1 << 20
CHUNK_LINKS = 2 << 20
# Pairs and entries, and texts, of a chunk in one row, and bytes after which a row group of its file is closed.
ROW_ENTRIES, ROW_TEXTS, GROUP_BYTES = 1 << 15, 1 << 11, 4 << 20
# Texts that are read and handed to a worker at once, each of which both sides hold several times over.
BATCH = "1024"
# Units a worker remembers; with at most 8 ids each on average.
UNITS = 250_000
# White space of the pre-token pattern (fixed: Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{SPACE}]+[^{SPACE}]*")
BLANK = re.compile(f"[{SPACE}]+").fullmatch


def piece_bytes(processor) -> list[bytes]:
    """B's tokens as bytes."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Vocabularies:
    """Encodes texts with both libraries; units by number for what repeats."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a = load(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(a_ranks, "rb"))}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unsettled = regex.compile(SETTLED).search
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 2)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = piece_bytes(self.b)
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.dummy = self.b.piece_to_id("▁")
        # White space that some piece of B joins to what stands before it; texts with it are encoded whole.
        crossing = re.compile(f"(?<=[^{SPACE}▁])[{SPACE}▁]|(?<=▁)[{SPACE}]")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        joined = {c.replace("▁", " ") for p in pieces for c in crossing.findall(p)}
        self.joining = re.compile("[" + "".join(map(re.escape, sorted(joined | {"▁"}))) + "]").search
        self.forget()

    def forget(self) -> None:
        self.number, self.faithful = Numbers(), np.zeros(0, bool)
        self.sides = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in "ab"]

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a whole text, or None if either library does not give its bytes back."""
        a = self.encode_a(" " + text)
        b = self.b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, np.int32), np.array(b, np.int32)

    def encode_a(self, text: str) -> list[int]:
        """A's ids by the rank file, which gives the same ids, unless letters stand in it that Unicode versions class apart."""
        if text.isascii() or not self.unsettled(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def together(self, units: list[str]) -> tuple[list, np.ndarray] | None:
        """(first, size, ids) of both sides for many units at once, encoded as one text and cut where units end.

        None if a token crosses such an end or the bytes do not come back. The text begins
        with a word of its own, as B puts a space in front.
        """
        joined = " x" + "".join(units)
        raw, ids = joined.encode(), (self.encode_a(joined), self.b.encode(joined[1:]))
        ends = 2 + np.concatenate([[0], np.cumsum([len(u.encode()) for u in units])])
        sides = []
        for tokens, found, length in zip((self.a_bytes, self.b_bytes), ids, (self.a_length, self.b_length), strict=True):
            if b"".join(map(tokens.__getitem__, found)) != raw:
                return None
            flat = np.array(found, np.int32)
            token_ends = np.cumsum(length[flat])
            at = np.searchsorted(token_ends, ends)
            if (token_ends[at] != ends).any():
                return None
            sides.append((at[:-1] + 1, np.diff(at), flat))
        return sides, np.ones(len(units), bool)

    def one_by_one(self, units: list[str]) -> tuple[list, np.ndarray]:
        """The same, unit by unit, with whether a unit's bytes come back."""
        ids, good = ([], []), []
        for unit in units:
            a, b, fair = self.encode_a(unit), self.b.encode(unit.removeprefix(" ")), True
            if not unit.startswith(" "):  # B's own space stands apart, as no piece joins it to this white space
                fair, b = bool(b) and b[0] == self.dummy, b[1:]
            raw = unit.encode()
            good.append(fair and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)))
            ids[0].append(a)
            ids[1].append(b)
        sides = []
        for side in ids:
            size = np.array([len(x) for x in side], np.int64)
            sides.append((np.cumsum(size) - size, size, np.array([i for x in side for i in x], np.int32)))
        return sides, np.array(good, bool)

    def learn(self, units: list[str]) -> None:
        """Keep the ids of newly numbered units, in the order of their numbers."""
        found = None
        # White space alone ends a text, so it cannot stand before another unit.
        if not any(map(BLANK, units)) and (all(map(str.isascii, units)) or not self.unsettled("".join(units))):
            found = self.together(units)
        if found is None and len(units) > 32:
            self.learn(units[: len(units) // 2])
            self.learn(units[len(units) // 2 :])
            return
        sides, good = found or self.one_by_one(units)
        self.faithful = np.concatenate([self.faithful, good])
        self.sides = [
            (np.concatenate([first, more + len(flat)]), np.concatenate([size, sizes]), np.concatenate([flat, ids]))
            for (first, size, flat), (more, sizes, ids) in zip(self.sides, sides, strict=True)
        ]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A's and B's ids of every text; None for texts without tokens."""
        if len(self.number) > UNITS or len(self.sides[0][2]) > 8 * UNITS:
            self.forget()
        numbers = []
        for text in texts:
            units = UNIT.findall(" " + text) if text and not self.joining(text) else []
            numbers.append(np.fromiter(map(self.number.__getitem__, units), np.int64, len(units)))
        new, self.number.new = self.number.new, []
        if new:
            self.learn(new)
        out = []
        for text, found in zip(texts, numbers, strict=True):
            if len(found) and self.faithful[found].all():
                out.append(tuple(gather(first, size, flat, found) for first, size, flat in self.sides))
            else:
                out.append(self.whole(text) if text else None)
        return out


class Numbers(dict):
    """Numbers units in the order they are met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


def gather(first: np.ndarray, size: np.ndarray, flat: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The ids of units one after the other."""
    size = size[numbers]
    ends = np.cumsum(size)
    return flat[np.repeat(first[numbers] - ends + size, size) + np.arange(ends[-1])]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders (i, j) of the pieces: after every `piece` steps, i ends of `a` and j of `b` are behind.

    One binary search per diagonal, all at once. At equal ends A's step comes first.
    """
    total = len(a) + len(b)
    d = np.minimum(np.arange(0, total + piece, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at_a = a[np.minimum(middle, len(a) - 1)]
        at_b = b[np.clip(d - middle - 1, 0, len(b) - 1)]
        further = open_ & (at_a <= at_b)  # this A end lies behind the diagonal
        low = np.where(further, middle + 1, low)
        high = np.where(open_ & ~further, middle, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, i_end: int, j: int, j_end: int) -> tuple[np.ndarray, ...]:
    """Links (x, y) that end in this piece, and the B ends (with A's index) where both end.

    The piece sees its own ends and the last A end before it.
    """
    x = np.arange(i, i_end)
    y = j + np.searchsorted(b[j:j_end], a[i:i_end], "left")
    after = i + np.searchsorted(a[i:i_end], b[j:j_end], "right")
    both = np.zeros(j_end - j, bool)
    behind = after > 0
    both[behind] = a[after[behind] - 1] == b[j:j_end][behind]
    steps = np.arange(j, j_end)
    return np.concatenate([x, after[~both]]), np.concatenate([y, steps[~both]]), after[both], steps[both] + 1


def align_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """All links (x, y) and the group borders (A tokens behind, B tokens behind) of two lists of ends."""
    if not len(a) or not len(b):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    borders = list(zip(*diagonals(a, b, piece), strict=True))
    pieces = [merge_piece(a, b, i, i2, j, j2) for (i, j), (i2, j2) in zip(borders, borders[1:]) if (i, j) != (i2, j2)]
    return tuple(np.concatenate(part) for part in zip(*pieces, strict=True))


class Run:
    """Texts laid end to end, aligned by one merge."""

    def __init__(self, ids: list[tuple[np.ndarray, np.ndarray] | None], words: Vocabularies, piece: int = PIECE):
        none = np.zeros(0, np.int32)
        pairs = [p or (none, none) for p in ids]
        self.n_a = np.array([len(p[0]) for p in pairs], np.int64)
        self.n_b = np.array([len(p[1]) for p in pairs], np.int64)
        self.a = np.concatenate([none, *[p[0] for p in pairs]])
        self.b = np.concatenate([none, *[p[1] for p in pairs]])
        x, y, self.a_ends, self.b_ends = align_ends(np.cumsum(words.a_length[self.a]), np.cumsum(words.b_length[self.b]), piece)
        self.codes = self.a[x].astype(np.int64) * len(words.b_bytes) + self.b[y]
        of_token = np.repeat(np.arange(len(pairs)), self.n_a)
        self.doc = of_token[x]
        self.n_links = np.bincount(self.doc, minlength=len(pairs))
        self.n_groups = np.bincount(of_token[self.a_ends - 1], minlength=len(pairs))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id pair, how often) of every text's distinct pairs, in this order."""
        key, often = np.unique(self.doc.astype(np.int64) << 32 | self.codes, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, often

    def written(self, strings: tuple[list[bytes], int]) -> Iterator[bytes]:
        """Every text's groups: a1,a2|b1;a3|b2,b3 ."""
        table, shift = strings
        before_a, before_b = np.concatenate([[0], self.a_ends[:-1]]), np.concatenate([[0], self.b_ends[:-1]])
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.a_ends - 1] = 1
        last_b[self.b_ends - 1] = 1
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.repeat(before_b, self.a_ends - before_a)] = self.a * 2 + last_a
        order[np.arange(len(self.b)) + np.repeat(self.a_ends, self.b_ends - before_b)] = shift + self.b * 2 + last_b
        end = 0
        for n in self.n_a + self.n_b:
            start, end = end, end + n
            yield b"".join(map(table.__getitem__, order[start:end].tolist()))[:-1]


def group_strings(words: Vocabularies) -> tuple[list[bytes], int]:
    """Ids with the sign that follows: inside a group a comma, after A's part |, after B's ; ."""
    a = [b"%d%s" % (i, s) for i in range(len(words.a_bytes)) for s in (b",", b"|")]
    return a + [b"%d%s" % (i, s) for i in range(len(words.b_bytes)) for s in (b",", b";")], len(a)


def runs(batch: pa.RecordBatch, words: Vocabularies, piece: int) -> Iterator[tuple[int, int, Run]]:
    """(first row, end row, run) over a batch, texts of about RUN_BYTES together."""
    column, start, size, texts = batch.column("text"), 0, 0, []
    for k in range(len(column)):
        texts.append(column[k].as_py() or "")
        size += len(texts[-1])
        if size >= RUN_BYTES or k + 1 == len(column):
            yield start, k + 1, Run(words.encode(texts), words, piece)
            start, size, texts = k + 1, 0, []


def _paths(a_path: str | None, a_ranks: str | None, b_path: str | None) -> tuple[str, str, str]:
    return (
        a_path or public_tokenizers.path(A_FILE),
        a_ranks or public_tokenizers.path(A_RANKS),
        b_path or public_tokenizers.path(B_FILE),
    )


def _picked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked, picked.schema["doc_id"].dataType.simpleString()


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    a_path: str | None = None, a_ranks: str | None = None, b_path: str | None = None, piece: int = PIECE,
) -> DataFrame:
    """doc_id and the groups of every text, written a1,a2|b1;a3|b2,b3 (decimal ids of A and B).

    One pass without a shuffle. Texts without tokens (null, empty, or not given back by
    both vocabularies) have an empty string. Repeated rows each get their row; other
    columns are not read.
    """
    paths = _paths(a_path, a_ranks, b_path)
    picked, kind = _picked(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabularies(*paths)
        strings = group_strings(words)
        for batch in batches:
            for start, end, part in runs(batch, words, piece):
                out = pa.array([g.decode() for g in part.written(strings)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), out], names=["doc_id", "groups"])

    return picked.mapInArrow(run, f"doc_id {kind}, groups string")


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on for other tasks, and its allocators keep what it held at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class Chunk:
    """Texts of a worker until they hold `limit` links: their figures and distinct id pairs."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(6)]
        self.keys, self.often, self.sizes, self.links = [], [], [], 0

    def add(self, ids: pa.Array, part: Run, digests: list[str]) -> None:
        for column, values in zip(
            self.columns, (ids.to_pylist(), part.n_a, part.n_b, part.n_groups, part.n_links, digests), strict=True
        ):
            column.extend(values)
        doc, code, often = part.distinct()
        self.keys.append(code)
        self.often.append(often)
        self.sizes.append(np.bincount(doc, minlength=len(digests)))
        self.links += int(part.n_links.sum())

    def rows(self, name: int, schema: pa.Schema, most_texts: int, most_entries: int) -> Iterator[pa.RecordBatch]:
        """The figures of all texts, the chunk's pairs with their texts, and each text's pairs by number, in numbered rows of bounded size."""
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        pairs, number, texts = np.unique(keys, return_inverse=True, return_counts=True)
        by_text = [*self.columns, np.concatenate(self.sizes)]
        by_entry = [pairs, texts, number, np.concatenate([keys[:0], *self.often])]
        for k in range(max(-(-len(by_text[0]) // most_texts), -(-len(keys) // most_entries))):
            values = [v[k * most : (k + 1) * most] for part, most in ((by_text, most_texts), (by_entry, most_entries)) for v in part]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([name, k, *values], schema, strict=True)], schema=schema)


def report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    a_path: str | None = None, a_ranks: str | None = None, b_path: str | None = None,
    piece: int = PIECE, chunk_links: int = CHUNK_LINKS,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    A link is a pair of overlapping token occurrences; an id pair counts the texts of the
    corpus that hold it linked. n_best: links whose count is the highest of their A id,
    ties included; count_sum: the sum of the counts over the links. Texts that are null,
    empty or not given back by both vocabularies have zeros and an empty digest column.
    Repeated rows are texts of their own. An empty table gives no rows. Other columns,
    whatever their names, are not read.

    A chunk is a bounded number of links (or one text), written as rows of bounded size, and
    its files as small row groups, so that no task holds many of them decoded at once; its
    pairs travel as one row per distinct pair, summed map-side. The highest count per A id is broadcast: it has at
    most as many rows as A has ids.
    """
    paths = _paths(a_path, a_ranks, b_path)
    picked, kind = _picked(docs, doc_id, text)
    id_type = pa.schema(_arrow_types(picked)).field("doc_id").type
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    lists = [("doc_id", kind, id_type), *[(f, "long", pa.int64()) for f in figures], ("groups_sha256", "string", pa.string())]
    lists += [("sizes", "int", pa.int32()), ("pairs", "long", pa.int64()), *[(f, "int", pa.int32()) for f in ("texts", "number", "often")]]
    schema = pa.schema([("chunk", pa.int64()), ("piece", pa.int32()), *[(f, pa.list_(t)) for f, _, t in lists]])
    ddl = "chunk long, piece int, " + ", ".join(f"{f} array<{k}>" for f, k, _ in lists)

    bounds = ROW_TEXTS, ROW_ENTRIES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabularies(*paths)
        strings = group_strings(words)
        name = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        for batch in batches:
            for start, end, part in runs(batch, words, piece):
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in part.written(strings)]
                chunk.add(batch.column("doc_id").slice(start, end - start), part, digests)
                if chunk.links >= chunk_links:
                    yield from chunk.rows(name, schema, *bounds)
                    name, chunk = name + 1, Chunk()
                    give_back()
        if chunk.sizes:
            yield from chunk.rows(name, schema, *bounds)
        del words, strings, chunk
        give_back()

    with settings(docs.sparkSession, spark_sql_parquet_columnarReaderBatchSize=BATCH, spark_sql_execution_arrow_maxRecordsPerBatch=BATCH):
        chunks = cut(picked.mapInArrow(encode, ddl), **{"parquet.block.size": GROUP_BYTES})
    held = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "texts")).alias("p")).select(F.col("chunk").alias("holder"), "p.pairs", "p.texts")
    totals = cut(held.groupBy("pairs").agg(F.sum("texts").alias("total")))
    a_of = F.expr(f"pairs div {_b_size(paths[2])}")
    highest = totals.groupBy(a_of.alias("a")).agg(F.max("total").alias("highest"))
    marked = totals.withColumn("a", a_of).join(F.broadcast(highest), "a").select("pairs", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = held.select("holder", "pairs").join(marked, "pairs").select("holder", "pairs", "total", "best")
    fields = ["doc_id", *figures, "n_best", "count_sum", "groups_sha256"]
    out_schema = pa.schema([("doc_id", id_type), *[(f, pa.int64()) for f in fields[1:-1]], ("groups_sha256", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts of one chunk with the totals of its pairs."""
        order = np.argsort(right.column("pairs").to_numpy())
        total = right.column("total").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        pieces = np.argsort(left.column("piece").to_numpy()).tolist()
        lists = {f: pa.concat_arrays([left.column(f)[k].values for k in pieces]) for f in left.column_names if f not in ("chunk", "piece")}
        number, often, sizes = (lists[f].to_numpy() for f in ("number", "often", "sizes"))
        ends = np.cumsum(sizes)
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (often * best[number], often * total[number])]
        extra = [pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]
        columns = [lists[f] for f in ("doc_id", *figures)] + extra + [lists["groups_sha256"]]
        return pa.Table.from_arrays(columns, schema=out_schema)

    out = f"doc_id {kind}, " + ", ".join(f"{f} long" for f in fields[1:-1]) + ", groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(back.groupBy("holder")).applyInArrow(finish, out)


def _arrow_types(df: DataFrame) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in df.schema.fields]


def _b_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
