from pyspark.sql import functions as F

from pathlib import Path

from tablestakes.operators import audits
from tablestakes.session import scratch_dir
from tablestakes.sources import buckets, roles
from tables import as_map, as_set, build


def sound(spark):
    hands = {n: [1000 * g + 10 * (10 * s + k + 1) for k in range(10)] for n, g, s in (("a", 1, 0), ("b", 1, 1), ("w", 2, 0))}
    return build(
        spark,
        {1: dict(ring=[("a", "b"), ("b", "a")], table=1490), 2: dict(ring=[("w", None)], table=None)},
        hands,
        turns=["a"],
    )


def test_sound_state_has_no_findings(spark):
    assert audits.game_invariants(sound(spark)).count() == 0


def test_planted_faults_are_found(spark):
    state = sound(spark)
    state["decks"] = state["decks"].filter("card_id <> 1533")
    state["players"] = state["players"].withColumn("next_player", F.expr("CASE username WHEN 'b' THEN 'b' ELSE next_player END"))
    state["hands"] = state["hands"].unionByName(
        spark.createDataFrame([(1010, "b"), (1490, "b"), (2500, "w"), (2501, "w")], "card_id long, username string")
    )
    got = as_set(audits.game_invariants(state), "game_id", "rule", "n")
    assert got == {
        (1, "deck without 108 cards", 107), (1, "running game with an open ring", 1),
        (1, "card in two hands", 1), (1, "table card in a hand out of turn", 1),
        (1, "hand outside 9 to 11", 1), (2, "hand outside 9 to 11", 1),
    }


def test_key_audits(spark):
    t = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    assert as_set(audits.pk_violations(t, ["k"]), "k", "n") == {(1, 2)}
    parent = spark.createDataFrame([("x",)], "p string")
    child = t.withColumn("row", F.monotonically_increasing_id())
    assert as_set(audits.fk_orphans(child, "v", parent, "p", "row"), "v") == {"y"}
    assert as_map(audits.not_null(t, "t", ["k", "v"]), "rule", "n") == {"k": 0, "v": 1}
    rules = {"long": audits.too_long("v", 0), "domain": audits.outside("v", ["x"])}
    assert as_map(audits.count_by_rule(t, "t", rules), "rule", "n") == {"long": 2, "domain": 1}


def test_ring_audit(spark):
    rings = {
        1: ["ab", "bc", "ca"], 2: ["de", "ed", "fg", "gf"], 3: ["hi", "ih", "jh", "kj"], 4: ["lm", "ma"], 5: ["no", "oz"],
        6: ["pp"], 7: ["qr", "rq"], 8: ["st", "t "], 9: ["uu", "vu"],
    }
    rows = [(p[0], p[1].strip() or None, g) for g, pairs in rings.items() for p in pairs]
    players = spark.createDataFrame(rows, "username string, next_player string, game_id long")
    running = spark.createDataFrame([(g,) for g in rings], "game_id long")
    got = as_set(audits.ring_audit(players, running), "game_id", "rule", "n")
    parts, outside, out = "ring in parts", "seat outside the ring", "pointer out of the game"
    assert got == {
        (2, parts, 2), (3, outside, 2), (4, out, 1), (4, parts, 2), (4, outside, 2), (5, out, 1), (5, parts, 2),
        (5, outside, 2), (8, parts, 2), (8, outside, 2), (9, outside, 1),
    }
    assert audits.ring_audit(players.where("game_id = 0"), running).count() == 0


def test_fk_audit_counts_rows_of_lost_keys(spark):
    tables = {
        "c": spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), "p": spark.createDataFrame([("2",), ("2",)], "k string"),
    }
    got = audits.fk_audit(tables, [("c", "k", "p", "k"), ("p", "k", "c", "k")])
    assert as_set(got, "relation", "key", "n") == {("c.k -> p.k", "1", 2)}


def ages(root, table):
    """Age of every bucket's newest file."""
    place = Path(root.removeprefix("file:")) / table
    return {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in place.glob("bucket=*")}


def test_write_back_rewrites_the_touched_buckets_only(spark, sf_dir):
    root = scratch_dir(spark, "tables")
    state = roles.state(spark, sf_dir)
    buckets.write_back(spark, root, state)
    stored = buckets.load(spark, root)
    for name in state:
        assert sorted(map(tuple, stored[name].collect()), key=str) == sorted(map(tuple, state[name].collect()), key=str), name
    before = {t: ages(root, t) for t in state}
    gone = stored["games"].where("game_id < 10").select("game_id")
    assert gone.count() == 10
    after = dict(stored)
    for t in ("games", "decks"):
        after[t] = stored[t].join(gone, "game_id", "left_anti").select(*stored[t].columns)
    leaving = stored["players"].join(gone, "game_id", "left_semi").select("username")
    after["players"] = stored["players"].join(leaving, "username", "left_anti").select(*stored["players"].columns)
    after["hands"] = stored["hands"].join(leaving, "username", "left_anti").select(*stored["hands"].columns)
    expected = {t: sorted(map(tuple, after[t].collect()), key=str) for t in ("games", "decks", "players", "hands")}
    buckets.write_back(spark, root, after, gone)
    for t in ("games", "decks", "players", "hands"):
        changed = {b for b, age in ages(root, t).items() if age != before[t].get(b)}
        assert 0 < len(changed) <= 10 and set(ages(root, t)) == set(before[t])
        assert sorted(map(tuple, buckets.load(spark, root)[t].collect()), key=str) == expected[t]
    assert ages(root, "users") == before["users"]
