"""Rows of a stream handed on in event order, key by key, with native keyed state.

A key's rows wait in list state until the watermark has passed them; an event-time timer
then takes them out in the order of their stamps, whatever order they arrived in, and a
step function carries the key's value state from row to row. Rows that come after their
stamps were taken out are late: they are given out at once, flagged, without a result,
and counted in the key's state.

State lives in the session's state store (RocksDB) below the checkpoint, so a restarted
query goes on where the last committed batch ended. A key's waiting rows are as many as
arrive within the delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Keyed state of processors needs this store; a batch writes its changes instead of a whole snapshot.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# A closing mark's stamp lies behind all events.
END = "TIMESTAMP '9999-01-01 00:00:00'"


class EventOrder(StatefulProcessor):
    """Applies `step(value, row) -> (value, results or None)` to a key's rows by (at, event_id).

    `payload`, `value` and `results` are DDL texts: of the columns behind at and event_id,
    of the key's state, and of what a step gives; a step without results gives no row.
    """

    def __init__(self, key: str, payload: str, value: str, start, results: str, step: Callable):
        self.kinds, self.value_kind, self.results = payload, value, results
        self.start, self.step = start, step
        names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
        self.payload, self.names = names(payload), [key, "at", "event_id", *names(payload), *names(results), "late", "late_rows"]
        self.nothing = [None] * len(names(results))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.names)
        self.waiting = handle.getListState("waiting", f"at LONG, event_id LONG, {self.kinds}")
        self.value = handle.getValueState("value", f"value {self.value_kind}, late LONG")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh, late = [], []
        for r in rows:
            if r.event_id is not None:  # a closing mark only moves the watermark
                (late if r.at // 1000 < passed else fresh).append((r.at, r.event_id, *(r[c] for c in self.payload)))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(max(r[0] for r in fresh) // 1000 + 1)
        if late:
            value, before = self.value.get() or (self.start, 0)
            self.value.update((value, before + len(late)))
            for n, r in enumerate(sorted(late), before + 1):
                yield self.row(*key, *r, *self.nothing, True, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[:2])
        due = [r for r in rows if r[0] // 1000 < passed]
        if not due:
            return
        value, late = self.value.get() or (self.start, 0)
        for r in due:
            value, results = self.step(value, *r[2:])
            if results is not None:
                yield self.row(*key, *r, *results, False, late)
        self.value.update((value, late))
        if len(due) < len(rows):
            self.waiting.put(rows[len(due) :])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def folder(spark: SparkSession, path: str) -> str:
    """Make a folder, so that reading it finds nothing instead of failing."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def in_event_order(events: DataFrame, root: str, key: str, delay: str, processor: EventOrder, resent: bool = False) -> DataFrame:
    """The stream of what `processor` gives: key, ts, event_id, payload, results, late, late_rows.

    `events` needs ts and event_id. Rows may come up to `delay` after younger ones. With
    `resent`, an event_id counts once however often it is sent: repetitions within the
    delay are found in the state of events, older rows than that are dropped.
    """
    marks = events.sparkSession.readStream.schema(events.schema).parquet(folder(events.sparkSession, f"{root}/marks"))
    timed = events.unionByName(marks).withColumn("seen_at", F.col("ts").cast("timestamp")).withWatermark("seen_at", delay)
    if resent:
        timed = timed.dropDuplicatesWithinWatermark(["event_id"])
    # The stamp goes on as a number, so late rows reach the processor instead of being dropped.
    plain = timed.select(key, F.unix_micros("seen_at").alias("at"), "event_id", *processor.payload)
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, at LONG, event_id LONG, {processor.kinds}, {processor.results}, late BOOLEAN, late_rows LONG"
    ordered = plain.groupBy(key).transformWithState(processor, out, "append", "eventTime")
    return ordered.withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz")).withColumnRenamed("at", "ts")


def run_to_files(stream: DataFrame, root: str) -> None:
    """Process what is there into files, one batch after the other, and stop."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STORE}
    for name, value in STORE.items():  # the query keeps the settings it starts with
        conf.set(name, value)
    try:
        query = (
            stream.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start(folder(stream.sparkSession, f"{root}/out"))
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()


def closing_mark(events: DataFrame) -> DataFrame:
    """One row: a stamp behind all events, and nothing else."""
    names = [F.expr(END).cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    return events.sparkSession.range(1).select(*names)


def finish(stream: DataFrame, events: DataFrame, root: str) -> None:
    """Close the stream: one more run whose mark moves the watermark behind all that waits."""
    closing_mark(events).coalesce(1).write.mode("append").parquet(f"{root}/marks")
    run_to_files(stream, root)


def written(stream: DataFrame, root: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")
