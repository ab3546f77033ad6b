import json
import random

from pyspark.sql import functions as F

from tablestakes.operators import changes, columnar, joins, numbering
from tables import as_map, as_set


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "warm", None, f"k{rng.randrange(200)}"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row long, k string")


def test_lookup_splits_hot_keys_and_keeps_every_row(spark):
    rows, facts = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "k string, v int")
    values = {"hot": 1, "k1": 2, "k2": 3}
    want = {(i, k, values.get(k)) for i, k in rows}
    for hot_rows in (100, 10**9):
        args = dict(hot_rows=hot_rows)
        got = joins.lookup(facts, dim, ["k"], "row", **args)
        assert got.columns == ["k", "row", "v"] and got.count() == len(rows)
        assert as_set(got, "row", "k", "v") == want
        assert as_set(joins.lookup(facts, dim, ["k"], "row", "left_semi", **args), "row") == {i for i, _, v in want if v}
        assert as_set(joins.lookup(facts, dim, ["k"], "row", "left_anti", **args), "row") == {i for i, _, v in want if not v}
    assert as_set(joins.hot_keys(facts, ["k"], 100), "k") == {"hot", "warm"}


def test_lookup_on_two_columns_with_a_separate_count(spark):
    rows, facts = skewed(spark)
    dim = spark.createDataFrame([("hot", 0, "a"), ("hot", 1, "b")], "k string, p int, v string")
    parted = facts.withColumn("p", (F.col("row") % 2).cast("int"))
    got = joins.lookup(parted, dim, ["k", "p"], "row", hot_rows=100, counted=parted.select("k", "p"))
    assert as_set(got, "row", "v") == {(i, "ab"[i % 2] if k == "hot" else None) for i, k in rows}
    assert got.count() == len(rows)


def test_lookup_really_spreads_the_hot_key(spark):
    """No shuffle partition of the fact side may hold all rows of the hot key."""
    rows, facts = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup(facts, dim, ["k"], "row", "inner", hot_rows=50)
        sizes = [r["count"] for r in joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = sum(k == "hot" for _, k in rows)
    assert sum(sizes) == total and max(sizes) < total / 2


def test_semi_and_anti_do_not_multiply(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1,)] * 50 + [(2,)], "k int")
    assert joins.semi(left, right, ["k"]).count() == 2
    assert as_set(joins.anti(left, right, ["k"]), "k") == {3}


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    full, none, empty = (spark.createDataFrame(r, "x int") for r in ([(1,)], [(1,), (None,)], []))
    for listed in (full, none, empty):
        left.createOrReplaceTempView("l")
        listed.createOrReplaceTempView("r")
        want = as_set(spark.sql("SELECT k FROM l WHERE k NOT IN (SELECT x FROM r)"), "k")
        assert as_set(joins.not_in(left, "k", listed, "x"), "k") == want
    plan = joins.not_in(left, "k", full, "x")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fanout_distinct_is_empty_without_hands(spark):
    decks = spark.createDataFrame([(1, 1), (2, 1)], "card_id long, game_id long")
    hands = spark.createDataFrame([(1, "a")], "card_id long, username string")
    assert as_set(joins.fanout_distinct(decks, hands), "card_id") == {2}
    assert joins.fanout_distinct(decks, hands.filter("false")).count() == 0


def test_natural_join_keeps_common_columns_once(spark):
    a = spark.createDataFrame([(1, "x")], "id int, n string")
    b = spark.createDataFrame([(1, 5)], "id int, c int")
    assert joins.natural_join(a, b).columns == ["id", "n", "c"]


def test_running_sum_with_a_hot_key(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{i % 7}", rng.randrange(1000), rng.randrange(-5, 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "row long, k string, at int, d int")
    slices = F.floor(F.col("at") / 50)
    total, want = {}, {}
    for row, k, at, d in sorted(rows, key=lambda r: (r[2], r[0])):
        total[k] = total.get(k, 0) + d
        want[row] = total[k]
    for hot_rows in (500, 10**9):
        got = numbering.running_sum(df, ["k"], ["at", "row"], slices, F.col("d"), "s", hot_rows)
        assert as_map(got, "row", "s") == want


def test_number_rows_is_dense_and_ordered(spark):
    ids = random.Random(1).sample(range(100000), 3000)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = as_map(numbering.number_rows(df, ["id"], 501), "id", "seq")
    assert got == {i: 501 + n for n, i in enumerate(sorted(ids))}


def test_changes(spark):
    t = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("c", 3, 7)], "k string, v int, w int")
    new = spark.createDataFrame([("a", 9), ("b", None)], "k string, v int")
    assert as_set(changes.apply_updates(t, new, "k", ["v"]), "k", "v", "w") == {("a", 9, 5), ("b", None, 6), ("c", 3, 7)}
    plus = spark.createDataFrame([("a", 1), ("a", 2), ("z", 5)], "k string, delta int")
    out = changes.apply_increment(t, plus, "k", "v")
    assert as_set(out, "k", "v") == {("a", 4), ("b", 2), ("c", 3)} and out.schema == t.schema
    assert as_set(changes.apply_deletes(t, new, "k"), "k") == {"c"}
    assert changes.append(t, t.select("w", "v", "k")).count() == 6


def test_serialise_admits_the_first_of_each_game(spark):
    rows = [(i, 100 - i // 2, 1 if i % 3 else 2) for i in range(50)] + [(99, 1, None)]
    df = spark.createDataFrame(rows, "request_id long, ts int, game_id int")
    got = as_set(changes.serialise(df).filter("admitted"), "request_id")
    assert got == {min((t, i) for i, t, g in rows if g == game)[1] for game in (1, 2)}


def test_columnar_pieces(spark):
    """A hot group, a NULL group, NULL values and clashing names; pieces put together are the group."""
    rows = [(g, i, None if i % 7 == 0 else i * 3) for g, size in (("hot", 1000), (None, 130), ("one", 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "piece_of string, n_ int, v int").repartition(3)
    for hot_rows in (100, 10**6):
        got = columnar.columnar_pieces(df, ["piece_of"], ["n_"], ["n_", "v"], F.floor(F.col("n_") / 50), piece_rows=64, hot_rows=hot_rows)
        whole = {}
        for r in sorted(got.collect(), key=lambda r: (str(r.piece_of), r.piece)):
            values = json.loads(r.result)
            assert len(values["n_"]) == len(values["v"]) == r.n <= 64
            whole.setdefault(r.piece_of, []).append((r.piece, r.n, list(zip(values["n_"], values["v"]))))
        for group, pieces in whole.items():
            assert [p for p, *_ in pieces] == list(range(1, len(pieces) + 1)) and all(n == 64 for _, n, _ in pieces[:-1])
            assert [x for *_, part in pieces for x in part] == [(i, v) for g, i, v in rows if g == group]
        assert set(whole) == {"hot", None, "one"}
    assert columnar.columnar_pieces(df.where("1 = 0"), ["piece_of"], ["n_"], ["v"], F.col("n_")).count() == 0


def test_columnar_json(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", None)], "g int, n string, v int")
    assert columnar.columnar_json(df, ["g"], "n", ["n", "v"]).first().result == '{"n":["a","b"],"v":[null,2]}'


def test_hashed_ids_are_numbered_in_ranges_of_equal_size(spark):
    df = spark.range(20000).select(F.xxhash64("id").alias("k")).repartition(5)
    got = numbering.range_numbered(df, ["k"])
    rows = got.collect()
    assert [r.rank for r in sorted(rows, key=lambda r: r.k)] == list(range(1, 20001))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0]
    assert numbering.range_numbered(df.where("k is null"), ["k"]).count() == 0


def test_long_groups_are_numbered_in_blocks(spark):
    rows = [(g, n, n % 3) for g, size in (("a", 5000), ("b", 3), ("c", 1200)) for n in range(size)] + [("b", 1, 9)]
    df = spark.createDataFrame(rows, "g string, n int, x int").repartition(4)
    got = numbering.numbered_in_blocks(df, ["g"], ["n", "x"], F.expr("n div 1000"), "pos").collect()
    for g in "abc":
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.n, r.x))
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == sum(r[0] == g for r in rows)


def test_a_null_key_is_sliced_like_others(spark):
    rows = [(None if n % 2 else "k", n, n // 40) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, block int")
    sliced = numbering.with_slices(df, ["k"], F.col("block"), hot_rows=50)
    assert sliced.where("_slice IS NULL").count() == 0 and sliced.count() == 400
    got = as_map(numbering.running_sum(df, ["k"], ["n"], F.col("block"), F.lit(1), "s", hot_rows=50), "n", "s")
    assert got == {n: n // 2 + 1 for n in range(400)}
