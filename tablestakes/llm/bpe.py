"""Byte-level BPE encoding of overlapping chunks, and decoding by concatenated bytes.

Texts are cut into chunks that overlap. Each chunk is pre-tokenised by itself, so
the chunks of one very long text are spread over many tasks. The pattern looks at
no character before a pre-token, so once two chunks share a pre-token boundary
inside their overlap they agree from there on: at the first such boundary the
chunks are stitched. The stitched pieces are then encoded one by one, and ids are
decoded by concatenating the raw bytes of their tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
# Characters a chunk owns, and characters it reads beyond them.
CHUNK, OVERLAP = 32_768, 1_024
# Pieces a worker remembers and the longest piece it remembers.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


class Codec(dict):
    """Encodes pieces by the ranks, remembering short ones; decodes ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoding.encode_ordinary(piece))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


PIECES = regex.compile(public_tokenizers.PATTERN)


def spans(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the overlapping chunks of a text."""
    return [(s, min(length, s + chunk + overlap)) for s in range(0, max(length, 1), chunk)]


def stitch(text: str, starts: list[int], parts: list[list[str]]) -> list[str]:
    """Pieces of the whole text from the pieces of its overlapping chunks.

    A chunk's last two pieces may have been cut short by its end, so they count only
    at the end of the text. Where two chunks share no boundary in their overlap (one
    pre-token spans it), the text is split on from the last sure boundary until the
    next chunk's boundaries are met.
    """
    pieces: list[str] = []
    at = 0  # pieces cover text[:at]
    for k, (start, part) in enumerate(zip(starts, parts)):
        ends = list(accumulate(map(len, part), initial=start))
        last = k + 1 == len(starts)
        sure = part if last else part[:-2]
        bounds = {b: i for i, b in enumerate(ends[: len(sure) + 1])}
        if at not in bounds:  # resynchronise: split on alone until a boundary of this chunk
            for match in PIECES.finditer(text, at):
                pieces.append(match.group())
                at = match.end()
                if at in bounds or at >= ends[len(sure)]:
                    break
        if at in bounds:
            pieces += sure[bounds[at] :]
            at = max(at, ends[len(sure)])
    return pieces


def pieces_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """All pieces of one text, by chunks."""
    if len(text) <= chunk:
        return PIECES.findall(text)
    cuts = spans(len(text), chunk, overlap)
    return stitch(text, [s for s, _ in cuts], [PIECES.findall(text[s:e]) for s, e in cuts])


def _result(codec: Codec, pieces: list[str]) -> tuple[int, str, str]:
    ids = codec.encode(pieces)
    return len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()


RESULT = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _batch(doc_ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    columns = {name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(RESULT)}
    return pa.RecordBatch.from_pydict({"doc_id": doc_ids} | columns)


def round_trip(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no ids. Texts of one chunk are encoded where they are
    read. Longer ones are cut into chunks that are dealt to all tasks, and stitched
    and encoded per text; a text is the largest thing a task holds. Repeated rows
    each get their row; other columns are not read.
    """
    path = path or public_tokenizers.path(RANKS)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            yield _batch(batch.column("doc_id"), [_result(codec, PIECES.findall(t)) for t in batch.column("text").to_pylist()])

    short = picked.where(F.length("text") <= chunk).mapInArrow(whole, schema)
    return short.unionByName(_long_texts(picked.where(F.length("text") > chunk), kind, schema, path, chunk, overlap))


def _long_texts(long: DataFrame, kind: str, schema: str, path: str, chunk: int, overlap: int) -> DataFrame:
    start = F.col("no").cast("int") * chunk
    cut = long.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").select(
        "doc_id", "row", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("no"), "text"
    )
    chunks = cut.select("doc_id", "row", "no", F.substring("text", start + 1, F.lit(chunk + overlap)).alias("part"))

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [[len(p) for p in PIECES.findall(t)] for t in batch.column("part").to_pylist()]
            yield batch.append_column("lengths", pa.array(lengths, pa.list_(pa.int32())))

    cut_schema = f"doc_id {kind}, row long, no int, part string, lengths array<int>"
    by_text = (
        chunks.repartition("row", "no")
        .mapInArrow(pre_tokenise, cut_schema)
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("no", "part", "lengths"))).alias("parts"))
        .select("doc_id", "parts")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            found = []
            for parts in batch.column("parts"):
                parts = parts.as_py()
                text = "".join(p["part"][:chunk] for p in parts)
                starts, pieces = [], []
                for p in parts:
                    ends = list(accumulate(p["lengths"], initial=0))
                    starts.append(p["no"] * chunk)
                    pieces.append([p["part"][a:b] for a, b in zip(ends, ends[1:])])
                found.append(_result(codec, stitch(text, starts, pieces)))
            yield _batch(batch.column("doc_id"), found)

    return by_text.mapInArrow(encode, schema)
