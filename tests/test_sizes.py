"""What the planner believes of the tables that are made larger than what they are made of."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tablestakes.operators import deal, guards, joins, lobby, phases
from tablestakes.plans import queries
from tablestakes.session import cut
from tablestakes.sources import roles
from tables import NOW, as_map, as_set, build


def believed(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_times_keeps_every_row_and_its_partition(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(joins.times(rows, 3, "n").collect(), key=str) == sorted(((k, n) for k in (1, 1, None) for n in range(3)), key=str)
    assert joins.times(rows.repartition(5, "k"), 3, "n").rdd.getNumPartitions() == 5


@pytest.mark.parametrize("table", ["decks", "cards", "hands"])
def test_no_table_is_larger_than_the_planner_believes(spark, sf_dir, table):
    """An explode counted as one row per row, so whole decks and hands were broadcast."""
    df = getattr(roles, table)(spark, sf_dir)
    assert believed(df) >= 16 * df.count()
    assert believed(df.filter("card_id % 2 = 0").distinct()) >= 16 * df.count()


def test_decks_are_dealt_by_as_many_tasks_as_a_shuffle_has(spark, sf_dir):
    """The few small rows of the games made one task, and that task all decks."""
    for df in (roles.decks(spark, sf_dir), roles.cards(spark, sf_dir), deal.pick(roles.decks(spark, sf_dir), 7), deal.sample(roles.decks(spark, sf_dir), 10, 7)):
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) == 2


def test_hands_are_ten_cards_a_seat_but_for_who_is_on_turn(spark, sf_dir):
    seats = roles.seats(spark, sf_dir).collect()
    want = set()
    for s in seats:
        places = list(range(10 * s.seat - 10, 10 * s.seat))
        if s.on_turn and s.game_id % 4 == 1:
            places.append(61)
        if s.on_turn and s.game_id % 4 == 2:
            places.pop()
        for p in places:
            n = (29 * p + 17 * s.game_id) % 108
            card = 10 * (n // 2 + 1) + n % 2 if n < 96 else 490 + n - 96 if n < 104 else 530 + n - 104
            want.add((1000 * s.game_id + card, s.username))
    got = roles.hands(spark, sf_dir)
    assert as_set(got, "card_id", "username") == want and got.count() == len(want)


def test_unpacked_keeps_every_row_and_its_partition(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,)], "k int").repartition(5, "k")
    assert sorted(joins.unpacked(rows).collect(), key=str) == [(1,), (1,), (None,)]
    assert joins.unpacked(rows).columns == ["k"] and joins.unpacked(rows).rdd.getNumPartitions() == 5
    assert believed(joins.unpacked(rows)) >= joins.PACKED * believed(rows)


@pytest.fixture(scope="module")
def many_customers(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("many"))
    spark.range(600_000, numPartitions=1).selectExpr(
        "id AS c_custkey", "'c' AS c_name", "cast(id % 25 as int) AS c_nationkey", "rand(1) AS c_acctbal", "'m' AS c_mktsegment"
    ).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("table", ["seats", "players"])
def test_tables_of_packed_files_are_not_broadcast(spark, many_customers, table):
    """A file of a few bytes a row passed for a small table, so all seats went through the driver."""
    df = getattr(roles, table)(spark, many_customers).select("username")
    both = df.join(roles.seats(spark, many_customers).select("username", "seat"), "username").agg(F.count("*"))
    assert both.collect()[0][0] == 600_000
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


def test_pick_sorts_no_deck_and_takes_the_least_hash(spark):
    """A minimum of structs made a sort of all cards."""
    rows = [(g, c) for g in (1, 2, None) for c in range(50)] + [(1, 7), (3, None), (3, 5), (4, None)]
    decks = spark.createDataFrame(rows, "game_id bigint, card_id bigint")
    got = deal.pick(decks, 7)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for g, c in rows:
        order = (c is not None, md5(f"7:{c}".encode()).hexdigest(), c or 0)
        want[g] = min(want.get(g, (order, c)), (order, c), key=lambda x: x[0])
    assert as_set(got, "game_id", "card_id") == {(g, c) for g, (_, c) in want.items()}


@pytest.fixture(scope="module")
def one_table(spark):
    games = {1: dict(ring=[("a", "b"), ("b", "a")], table=1010, wants=2), 2: dict(ring=[("h", None)], table=None, wants=3)}
    return build(spark, games, {"a": [1020, 1030], "b": [1040]}, users=["n", "m"], turns=["a"])


@pytest.mark.parametrize("table_rank", [False, True])
def test_accounts_send_no_table_of_the_state_through_the_driver(spark, one_table, table_rank):
    """Turns, games and seats just below the planner's limit were all broadcast in one query."""
    facts = guards.accounts(one_table, table_rank)
    got = {r.username: (r.game_id, r.hand_size, r.players_in_game, r.current_player) for r in facts.collect()}
    assert got == {"a": (1, 2, 2, "a"), "b": (1, 1, 2, "a"), "h": (2, 0, 1, None), "n": (None, 0, None, None), "m": (None, 0, None, None)}
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert all("LeftOuter" not in line or "card_on_table" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert plan.count("SortMergeJoin") >= 5


def test_joins_read_the_accounts_once_for_the_rooms(spark, one_table):
    """Seats were joined to all accounts again for rooms, the largest room and the turns."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        read.add(1)
        return n

    users = spark.createDataFrame(one_table["users"].collect(), one_table["users"].schema).withColumn("p_count", counted("p_count"))
    asked = spark.createDataFrame(
        [(1, NOW, "n", "pw-n", 2), (2, NOW, "m", "pw-m", 2), (3, NOW, "a", "pw-a", 2)],
        "request_id long, ts timestamp_ntz, login string, pw string, game_id long",
    )
    status, after = lobby.join_games({**one_table, "users": users}, asked, F.lit(NOW), 7)
    assert as_map(status, "request_id", "status_code") == {1: "ok", 2: "ok", 3: "seated"}
    assert as_set(after["turns"], "current_player") == {"a", "n"}
    assert 0 < read.value <= 5


def test_claims_are_put_together_without_a_broadcast_of_the_games(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries.phases, "claim", lambda state, asked, seed: asked)
    asked = queries._claims(spark, sf_dir)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin [game_id" in line for line in plan.splitlines())
    assert asked.count() > 0


def test_a_batch_of_claims_is_put_together_once(spark, one_table):
    """Accounts, hands, lists and key counts each held the whole plan of the claims, in one query."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        read.add(1)
        return n

    asked = spark.createDataFrame(
        [(1, NOW, "a", "pw-a", 1, [1020, 1030]), (2, NOW, "b", "wrong", 1, [1040]), (3, NOW, "x", "pw-x", 1, None)],
        "request_id long, ts timestamp_ntz, login string, pw string, phase int, cards array<long>",
    )
    status, after = phases.claim(one_table, asked.withColumn("phase", counted("phase")), 7)
    assert as_map(status, "request_id", "status_code") == {1: "refused", 2: "wrong_password", 3: "wrong_password"}
    assert as_set(after["players"], "username", "points") == {("a", 0), ("b", 0), ("h", 0)}
    assert read.value == 3


def test_no_step_of_a_claim_holds_the_whole_job(spark, sf_dir, monkeypatch):
    """One query had 199 joins of what claims and hands are made of, and all their broadcasts at one time."""
    joined = []

    def counted(df):
        joined.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return cut(df)

    for module in (phases, queries, deal):
        monkeypatch.setattr(module, "cut", counted, raising=False)
    last = queries.claim_standings(spark, sf_dir)
    joined.append(last._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert last.count() > 0
    assert max(joined) <= 50, joined
