"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablestakes.session import scratch_dir

__all__ = ["column_bytes", "cut", "drop", "emit", "scratch_dir", "settings", "table", "utf8_length"]

# Spark removes a query's shuffle files when it ends if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# White space of the word pattern [^\x20\x09-\x0D]+ ; bytes.split() splits at exactly these.
WHITE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
# Folders of the results of cut().
WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings `values` (with _ for .) for what runs inside; afterwards they are as before."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, **options) -> DataFrame:
    """Write `df` once below the shared folder, with `options` of the writer, and go on from the files.

    The files outlive executors, so nothing before them is ever computed again; the
    shuffle files behind them are of no further use and are cleaned up at once.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "cut")
    schema, before = df.schema, spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    WRITTEN[out] = path
    return out


def drop(*results: DataFrame) -> None:
    """Delete the files of results of cut() once all that was made of them is written too.

    Other DataFrames are left alone.
    """
    for df in results:
        if path := WRITTEN.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def utf8_length(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data.translate(None, CONTINUATION))


def emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 65536) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `size` rows."""
    columns: list[list] = [[] for _ in schema]
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        if len(columns[0]) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            columns = [[] for _ in schema]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
