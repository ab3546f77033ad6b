"""Streams cut into several batches give what one pass over the table gives."""

from pyspark.sql import functions as F

from tablestakes.operators import numbering, turns
from tablestakes.session import scratch_dir
from tablestakes.sources import roles, schema
from tablestakes.streaming import feeds
from tables import as_map, as_set

FP = ["concat('u', user_id) AS username", "ts", "event_id", "event_type AS fp"]
MOVES = [
    "concat('u', user_id) AS username", "ts", "event_id",
    "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS delta", "event_type = 'purchase' AS fresh",
]


def second():
    return numbering.time_slice("ts")


def stream(spark, sf_dir, parts=3, **options):
    path = feeds.replay(schema.load(spark, sf_dir, "events"), scratch_dir(spark, "events"), parts, **options)
    return feeds.read_events(spark, path, 1)


def batches(spark, root):
    return spark.read.text(f"{root}/checkpoint/commits").count()


def test_change_rows_with_sliced_keys(spark, sf_dir):
    fp = ["concat('u', user_id % 2) AS username", "ts", "event_id", "event_type AS fp"]
    events = schema.load(spark, sf_dir, "events").selectExpr(*fp)
    sliced = feeds.change_rows(events, "username", "fp", second(), hot_rows=10)
    whole = feeds.change_rows(events, "username", "fp", second())
    old, want = {}, set()
    for r in events.orderBy("ts", "event_id").collect():
        if old.get(r.username) != r.fp:
            want.add(r.event_id)
        old[r.username] = r.fp
    assert as_set(sliced, "event_id") == as_set(whole, "event_id") == want


def test_last_activity(spark, sf_dir):
    got = feeds.latest_activity(stream(spark, sf_dir), scratch_dir(spark, "a"))
    want = schema.load(spark, sf_dir, "events").groupBy(F.expr("concat('u', user_id)")).agg(F.max("ts"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_files_come_out_of_time_order(spark, sf_dir):
    path = feeds.replay(schema.load(spark, sf_dir, "events"), scratch_dir(spark, "events"), 3)
    spans = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    found = sorted((r.low, r.high) for r in spans.collect())
    assert len(found) == 3 and all(a[1] > b[0] for a, b in zip(found, found[1:]))


def test_ledger_over_batches(spark, sf_dir):
    moves, root = stream(spark, sf_dir, 4).selectExpr(*MOVES), scratch_dir(spark, "l")
    got = feeds.ledger_stream(moves, root, close=False)
    waiting = got.count()
    want = turns.ledger(roles.moves(spark, sf_dir), second())
    assert 0 < waiting < want.count()  # the last hours wait for younger events
    got = feeds.ledger_stream(moves, root)
    assert as_map(got, "event_id", "hand_size") == as_map(want, "event_id", "hand_size")
    assert got.where("late").count() == 0 and batches(spark, root) > 3
    assert feeds.ledger_stream(moves, root).count() == want.count()  # nothing new: nothing changes


def test_changes_over_batches(spark, sf_dir):
    root = scratch_dir(spark, "c")
    got = feeds.state_changes(stream(spark, sf_dir, 5).selectExpr(*FP), root)
    want = feeds.change_rows(schema.load(spark, sf_dir, "events").selectExpr(*FP), "username", "fp", second())
    assert as_set(got, "event_id") == as_set(want, "event_id") and got.count() == want.count()
    assert batches(spark, root) > 4


def row(n, day, fp):
    return f"SELECT 'u' AS username, TIMESTAMP_NTZ '2024-01-{day:02d} 00:00:00' AS ts, {n}L AS event_id, {fp} AS fp"


def test_late_rows_are_flagged_and_counted_and_nulls_are_values(spark):
    path = scratch_dir(spark, "late")
    files = [[row(1, 1, "'a'"), row(3, 3, "NULL"), row(2, 2, "'a'")], [row(4, 9, "'b'")], [row(5, 2, "'z'"), row(6, 2, "'y'")], [row(7, 10, "'b'"), row(8, 11, "NULL")]]
    for rows in files:
        spark.sql(" UNION ALL ".join(rows)).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("username string, ts timestamp_ntz, event_id long, fp string").option("maxFilesPerTrigger", 1).parquet(path)
    got = feeds.state_changes(events, scratch_dir(spark, "f"), "1 hour")
    assert as_map(got, "event_id", "late") == {1: False, 3: False, 4: False, 5: True, 6: True, 8: False}
    assert as_map(got.where("event_id >= 4"), "event_id", "late_rows") == {4: 2, 5: 1, 6: 2, 8: 2}


def test_events_sent_twice_count_once(spark, sf_dir):
    events = stream(spark, sf_dir, 3, resend=True)
    sent = spark.read.parquet(feeds.replay(schema.load(spark, sf_dir, "events"), scratch_dir(spark, "twice"), 3, resend=True)).count()
    want = turns.ledger(roles.moves(spark, sf_dir), second())
    assert sent > 1.5 * want.count()
    got = feeds.ledger_stream(events.selectExpr(*MOVES), scratch_dir(spark, "d"), resent=True)
    assert as_map(got, "event_id", "hand_size") == as_map(want, "event_id", "hand_size") and got.count() == want.count()


def test_streams_without_files(spark):
    path = scratch_dir(spark, "none")
    feeds.folder(spark, path)
    empty = feeds.read_events(spark, path)
    assert feeds.latest_activity(empty, scratch_dir(spark, "e")).count() == 0
    assert feeds.state_changes(empty.selectExpr(*FP), scratch_dir(spark, "e")).count() == 0


def test_dedup_drops_events_sent_twice(spark, sf_dir):
    path = scratch_dir(spark, "twice")
    events = schema.load(spark, sf_dir, "events")
    events.unionByName(events).coalesce(1).write.parquet(path)
    root, seen = scratch_dir(spark, "d"), []
    feeds.run_available(feeds.dedup(feeds.read_events(spark, path)), root, lambda b, n: seen.append(b.count()))
    assert sum(seen) == events.count()


def test_parts_of_several_files_are_the_same_batches(spark, sf_dir):
    """A part was one file, so one task wrote it and few read it."""
    events, found = schema.load(spark, sf_dir, "events"), {}
    for files in (1, 4):
        path = feeds.replay(events, scratch_dir(spark, "events"), resend=True, mark=True, files=files)
        assert spark.read.format("binaryFile").load(f"{path}/*.parquet").count() == 3 * files
        root = scratch_dir(spark, "resent")
        moves = feeds.read_events(spark, path, files).selectExpr(*MOVES)
        got = feeds.ledger_stream(moves, root, close=False, resent=True)
        found[files] = (batches(spark, root), sorted(map(str, got.collect())))
    assert found[1] == found[4] and len(found[1][1]) == events.count()


def test_every_file_of_a_part_has_its_rows(spark, sf_dir):
    events = schema.load(spark, sf_dir, "events")
    least = feeds.files_a_part(events, file_rows=1)
    assert 1 < least <= events.count() // 3
    assert feeds.files_a_part(events, file_rows=least // 3) == 3
    assert feeds.files_a_part(events.limit(0)) == feeds.files_a_part(events.limit(1), file_rows=1) == 1
