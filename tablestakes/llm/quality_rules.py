"""Quality rules per document, and verdicts on hosts from their shrunken failure rates.

Every text is measured once. Failures are summed per host (map-side combine, so a
host with a third of all rows costs no more than others), each host's rate is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts' counts
(beta-binomial moments: what chance alone scatters is taken out first), and hosts whose shrunken rate is above a limit take
their documents with them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, column_bytes, cut, emit, utf8_length

# The base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
# A host goes when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
# Weight of the prior where hosts differ no more than by chance.
FLAT_PRIOR_WEIGHT = 1e6

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = bytearray(len(words))
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered[i : i + 3] = b"\x01\x01\x01"
        repeated = sum(covered)
    return (
        len(words),
        utf8_length(text.translate(None, WHITE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def measures(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host and the measures of every whole text (null: no words)."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    fields = picked.schema.fields
    kind = fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in column_bytes(batch, "text")]
            columns = [batch.column("doc_id"), batch.column("host")]
            columns += [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", *MEASURES])

    return picked.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_prior(n: float, failed: float, squares: float, hosts: float, sizes: float) -> tuple[float, float]:
    """Beta prior by moments: rows, failures, sum of failed^2/n, hosts and sum of n^2.

    Of the scatter of the rates, hosts - 1 parts are chance; the rest gives the correlation
    of two rows of one host. Hosts of one row each tell nothing of it: the prior is flat.
    """
    mean = failed / n if n else 0.5
    spread = mean * (1 - mean)
    room = n - sizes / n - (hosts - 1) if n else 0.0
    alike = ((squares - n * mean * mean) / spread - (hosts - 1)) / room if spread > 0 and room > 1e-9 else 0.0
    weight = min(max(1 / alike - 1, 1e-3), FLAT_PRIOR_WEIGHT) if alike > 1e-12 else FLAT_PRIOR_WEIGHT
    return mean * weight, (1 - mean) * weight


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: v_host, n_docs, n_failed, host_rate, host_failed."""
    counted = cut(
        measured.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    )
    n, failed, squares, hosts, sizes = counted.agg(
        F.sum("n_docs").cast("double"),
        F.sum("n_failed").cast("double"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")),
        F.count(F.lit(1)).cast("double"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")),
    ).first()
    alpha, beta = beta_prior(n or 0.0, failed or 0.0, squares or 0.0, hosts, sizes or 0.0)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return counted.select(
        F.col("host").alias("v_host"), "n_docs", "n_failed", rate.alias("host_rate"), (rate > F.lit(max_rate)).alias("host_failed")
    )


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """doc_id, the measures, base_failed, host, host_failed, kept; one row per document.

    Null or empty texts have no words and fail the base rules. A document without
    host has no host verdict and is kept unless it fails itself. Repeated rows
    each count and each get their row. Other columns are not read. The measured
    rows (no texts) are written once below the shared folder; the host table is
    joined from its files, so Spark checks its size before any broadcast.
    """
    measured = cut(measures(docs, doc_id, text, host).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(measured, max_rate).select("v_host", "host_failed")
    return measured.join(verdicts, F.col("host") == F.col("v_host"), "left").select(
        "doc_id",
        *MEASURES,
        "base_failed",
        "host",
        F.coalesce("host_failed", F.lit(False)).alias("host_failed"),
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
    )
