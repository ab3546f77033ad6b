"""Token counts of whole texts by a two-tier lookup, without a shuffle of pre-tokens.

A byte-level BPE encodes each pre-token by itself, so a text's count is the sum
over its pre-tokens. Tier one is a broadcast table of the lengths of frequent
pre-tokens: the vocabulary's own entries that are whole pre-tokens, which is what
frequent strings became when the vocabulary was made. Its size is bounded by the
vocabulary (50,257 entries here), whatever the corpus. Tier two encodes a miss
once per Python worker and remembers it, in a cache of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
# Misses a worker remembers, and the longest piece it remembers; both bound its memory.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
# Letters whose classes differ between Unicode versions lie beyond these ranges: texts
# that hold others are split by the tokenizer's own pattern engine.
SETTLED = r"[^\x00-՗‐-⁞₠-₿←-⏳ぁ-ゖァ-ヺ一-龥가-힣]"


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def frequent_lengths(path: str) -> tuple[str, bytes]:
    """Tier one, compact: the pre-tokens joined by NUL, and one byte of length for each."""
    tokenizer, letters = load(path), byte_letters()
    pattern = regex.compile(public_tokenizers.PATTERN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pieces = []
    for entry in tokenizer.get_vocab():
        if entry in special:
            continue
        try:
            piece = bytes(letters[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if "\0" not in piece and pattern.findall(piece) == [piece] and not regex.search(SETTLED, piece):
            pieces.append(piece)
    pieces.sort()
    lengths = [len(e.ids) for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    kept = [(p, n) for p, n in zip(pieces, lengths) if n < 256]
    return "\0".join(p for p, _ in kept), bytes(n for _, n in kept)


class Misses(dict):
    """Tier two: pre-token to length, encoding what is not there."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class Counter:
    """Counts tokens of texts exactly as the tokenizer's library does."""

    def __init__(self, path: str, frequent: tuple[str, bytes]):
        self.tokenizer = load(path)
        table = dict(zip(frequent[0].split("\0"), frequent[1])) if frequent[1] else {}
        self.lengths = Misses(self.tokenizer, table)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.unsettled = regex.compile(SETTLED).search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> int:
        if text.isascii() or not self.unsettled(text):
            return sum(map(self.lengths.__getitem__, self.pieces(text)))
        spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return sum(self.lengths[text[start:end]] for _, (start, end) in spans)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            found = regex.split("|".join(map(regex.escape, self.special)), text)
            return sum(map(self.plain, found)) + len(found) - 1
        return self.plain(text)


def count_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null and empty texts have no bytes and no tokens. Special strings inside a text
    count as the library counts them by default: one token. No truncation. Repeated
    rows each get their row; other columns are not read. Only the vocabulary's table
    is broadcast; nothing is shuffled.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, frequent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
