"""Structured Streaming forms of last activity, change feed and move ledger.

Change feed and ledger keep each key's last value in native keyed state and take its rows
in event order (see `ordered`); last activity is a streaming aggregate. All output is
files, so what a restarted query gives out again replaces what it gave before. A key's
rows of one batch are one task's work; the batch size bounds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.operators.joins import HOT_ROWS
from tablestakes.operators.numbering import with_slices
from tablestakes.sources.catalog import HAND_SIZE
from tablestakes.sources.schema import INPUTS
from tablestakes.streaming.ordered import EventOrder, closing_mark, finish, folder, in_event_order, run_to_files, written

DELAY = "7 hours"
FILE_ROWS = 1 << 18  # rows of a replayed file


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(INPUTS["events"])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _dealt(events: DataFrame, parts: int, jitter_hours: int) -> DataFrame:
    """Adds `_part`: the part of the stream a row comes with, up to `jitter_hours` late."""
    spread = jitter_hours * 3600
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at)).scalar(), events.agg(F.max(at)).scalar()
    shifted = at - low + F.pmod(F.xxhash64("event_id"), F.lit(spread))
    return events.withColumn("_part", F.floor(shifted * parts / (high - low + spread + 1)))


def files_a_part(events: DataFrame, parts: int = 3, jitter_hours: int = 6, file_rows: int = FILE_ROWS) -> int:
    """Into how many files `replay` can cut every part: the smallest has `file_rows` rows for each."""
    sizes = _dealt(events, parts, jitter_hours).where("_part IS NOT NULL").groupBy("_part").count()
    n, least = sizes.agg(F.count("*"), F.min("count")).first()
    return max(1, least // file_rows) if n == parts else 1


def replay(events: DataFrame, path: str, parts: int = 3, jitter_hours: int = 6, resend: bool = False, mark: bool = False, files: int = 1) -> str:
    """Write a table as the files of a stream, about in time order: a row may come up to
    `jitter_hours` late. With `resend`, every part also holds the rows of the one before.
    With `mark` the last part also closes the stream. Every part is `files` files, so that
    many a batch read part by part; a part needs as many rows (`files_a_part`)."""
    dealt = _dealt(events, parts, jitter_hours)
    folder(events.sparkSession, path)
    for p in range(parts):  # one write after the other, as the source reads by age
        found = dealt.where(F.col("_part").between(p - 1, p) if resend else F.col("_part") == p).drop("_part")
        last = found.unionByName(closing_mark(events)) if mark and p == parts - 1 else found
        # Dealt in turn, so no file stays away for want of rows.
        (last.coalesce(1) if files == 1 else last.repartition(files)).write.mode("append").parquet(path)
    return path


def dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop events sent again within `delay`; needs a TIMESTAMP event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def last_activity(events: DataFrame) -> DataFrame:
    """Latest stamp per user: a native streaming aggregate (update mode)."""
    return events.groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("username")).agg(F.max("ts").alias("activity"))


def run_available(
    df: DataFrame, root: str, each: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process what is there, one batch after the other, and stop."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(each)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def change_rows(
    events: DataFrame,
    key: str,
    value: str,
    slice_by: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows whose `value` differs from the key's row before, in (ts, event_id) order.

    The batch form of `state_changes`. Inside a slice by lag; the first row of a slice is
    compared with the last value of the slice before.
    """
    sliced = with_slices(events, [key], slice_by, hot_rows).withColumn("_slice", F.coalesce("_slice", F.lit(-1)))
    inner = W.partitionBy(key, "_slice").orderBy("ts", "event_id")
    local = sliced.withColumn("_prev", F.lag(value).over(inner)).withColumn("_n", F.row_number().over(inner))
    ends = sliced.groupBy(key, "_slice").agg(F.max_by(value, F.struct("ts", "event_id")).alias("_end"))
    carried = ends.select(key, "_slice", F.lag("_end").over(W.partitionBy(key).orderBy("_slice")).alias("_carried"))
    previous = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    return local.join(carried, [key, "_slice"]).filter(~previous.eqNullSafe(F.col(value))).select(*events.columns)


def latest_activity(events: DataFrame, root: str) -> DataFrame:
    """Run `last_activity` over the stream; returns the latest stamp per user.

    Update mode hands over only the users a batch touched.
    """
    spark = events.sparkSession
    stamps = last_activity(events)

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/b={n}")

    run_available(stamps, root, each, "update")
    out = spark.read.schema(stamps.schema).option("recursiveFileLookup", True).parquet(folder(spark, f"{root}/out"))
    return out.groupBy("username").agg(F.max("activity").alias("activity"))


def sized(value: int, delta: int, fresh: bool) -> tuple[int, tuple[int]]:
    """Hand size after a move."""
    value = HAND_SIZE if fresh else value + delta
    return value, (value,)


def differing(value: str | None, fp: str | None) -> tuple[str | None, tuple | None]:
    """A row counts if its value is not the one before. The first of a key always does."""
    told = "" if fp is None else "=" + fp  # so that a null is a value, and no value is none
    return told, None if told == value else (True,)


def state_changes(events: DataFrame, root: str, delay: str = DELAY, close: bool = True) -> DataFrame:
    """Run the change feed over the stream (username, ts, event_id, fp); returns the written feed.

    A row comes out when its fp differs from the one before in event order. `close` ends
    the stream; without it rows younger than the watermark wait for the next run. Late
    rows come out flagged; late_rows counts them per user.
    """
    feed = in_event_order(events, root, "username", delay, EventOrder("username", "fp STRING", "STRING", None, "changed BOOLEAN", differing))
    return _run(feed, events, root, close).drop("changed")


def ledger_stream(moves: DataFrame, root: str, delay: str = DELAY, close: bool = True, resent: bool = False) -> DataFrame:
    """Run the move ledger over the stream (username, ts, event_id, delta, fresh); returns the written ledger.

    Hand sizes follow event order. Late rows come out flagged, without a size. `resent`
    drops events sent again within the delay.
    """
    processor = EventOrder("username", "delta INT, fresh BOOLEAN", "LONG", HAND_SIZE, "hand_size LONG", sized)
    out = _run(in_event_order(moves, root, "username", delay, processor, resent), moves, root, close)
    legal = F.col("hand_size").between(HAND_SIZE - 1, HAND_SIZE + 1).alias("legal")
    return out.select("username", "ts", "event_id", "delta", "hand_size", legal, "late", "late_rows")


def _run(stream: DataFrame, events: DataFrame, root: str, close: bool) -> DataFrame:
    run_to_files(stream, root)
    if close:
        finish(stream, events, root)
    return written(stream, root)
