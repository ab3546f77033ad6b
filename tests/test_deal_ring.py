from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tablestakes.operators import deal, numbering, ring
from tables import as_map, as_set, build


def seats_of(spark, tables):
    return spark.createDataFrame(
        [(g, f"{g}-{s}", s) for g, n in tables.items() for s in range(1, n + 1)], "game_id long, username string, seat int"
    )


def test_deal_gives_ten_distinct_cards_and_is_repeatable(spark):
    seats = seats_of(spark, {1: 6, 2: 2, 3: 3})
    first = as_set(deal.initial_deal(seats, 7), "game_id", "username", "card_id")
    assert len(first) == 110 and len({c for _, _, c in first}) == 110
    assert {g == c // 1000 for g, _, c in first} == {True}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert as_set(deal.initial_deal(seats.repartition(5), 7), "game_id", "username", "card_id") == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert as_set(deal.initial_deal(seats, 8), "game_id", "username", "card_id") != first


def test_deal_equals_sampling_the_deck(spark):
    seats = seats_of(spark, {5: 2})
    decks = deal.build_decks(seats.select("game_id").distinct())
    assert decks.count() == 108
    top = as_set(deal.sample(decks, 20, 7), "card_id")
    assert as_set(deal.initial_deal(seats, 7), "card_id") == top
    assert deal.pick(decks, 7).first().card_id == deal.sample(decks, 1, 7).first().card_id


def test_redeal_touches_only_its_games(spark):
    games = {g: dict(ring=[(f"{g}a", f"{g}b"), (f"{g}b", f"{g}a")], table=g * 1000 + 330) for g in (1, 2)}
    hands = {f"{g}{p}": [g * 1000 + 10 * k + i for k in range(1, 11)] for g in (1, 2) for i, p in enumerate("ab")}
    state = build(spark, games, hands)
    after = deal.redeal(state, spark.createDataFrame([(1,)], "game_id long"), 3)["hands"]
    assert as_set(after.filter("username LIKE '2%'"), "card_id") == set(hands["2a"] + hands["2b"])
    fresh = as_set(after.filter("username LIKE '1%'"), "card_id")
    assert len(fresh) == 20 and 1330 not in fresh and fresh != set(hands["1a"] + hands["1b"])


def test_zip_and_slots(spark):
    slots = deal.hand_slots(seats_of(spark, {1: 3}))
    assert as_set(slots, "rn") == set(range(1, 31))
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "g int, a string")
    b = spark.createDataFrame([(1, 9), (1, 8), (2, 7)], "g int, b int")
    pairs = {(1, "x", 8), (1, "y", 9), (2, "z", 7)}
    assert as_set(numbering.zip_join(a, b, ["g"], ["a"], ["b"]), "g", "a", "b") == pairs
    sliced = numbering.zip_join(a, b, ["g"], ["a"], ["b"], F.ascii("a"), F.col("b"))
    assert as_set(sliced, "g", "a", "b") == pairs


def test_ring_closes_and_walks(spark):
    players = ring.seat_ring(seats_of(spark, {n: n for n in range(1, 7)}))
    nxt = as_map(players, "username", "next_player")
    for n in range(1, 7):
        at, seen = f"{n}-1", set()
        while at not in seen:
            seen.add(at)
            at = nxt[at]
        assert len(seen) == n and at == f"{n}-1"
    assert nxt["3-1"] == "3-3" and nxt["3-3"] == "3-2"
    two = {r.username: (r.hop1, r.hop2) for r in ring.successors(players.filter("game_id = 2")).collect()}
    assert two == {"2-1": ("2-2", "2-1"), "2-2": ("2-1", "2-2")}


def test_unlink_all_subsets_of_all_rings(spark):
    """Every ring of 2..6 seats, closed or open, with every proper subset of leavers."""
    rows, leavers, want = [], [], {}
    game = 0
    for n in range(2, 7):
        for closed in (True, False):
            for k in range(n):
                for gone in combinations(range(n), k):
                    game += 1
                    name = [f"{game}-{s}" for s in range(n)]
                    nxt = {s: s - 1 if s else (n - 1 if closed else None) for s in range(n)}
                    rows += [(name[s], 0, None if nxt[s] is None else name[nxt[s]], game) for s in range(n)]
                    leavers += [(name[s],) for s in gone]
                    for s in set(range(n)) - set(gone):
                        at = nxt[s]
                        while at is not None and at in gone:
                            at = nxt[at]
                        want[name[s]] = None if at is None else name[at]
    players = spark.createDataFrame(rows, "username string, points int, next_player string, game_id long")
    left = ring.unlink(players, spark.createDataFrame(leavers, "username string"))
    assert as_map(left, "username", "next_player") == want


@pytest.mark.parametrize("seats, wants, starts", [(2, 2, True), (3, 3, True), (2, 3, False)])
def test_game_start(spark, seats, wants, starts):
    names = "abc"[:seats]
    chain = [(n, names[i - 1] if i else None) for i, n in enumerate(names)]
    state = build(spark, {1: dict(ring=chain, table=None, wants=wants)}, {"a": [1010], "b": [1020]})
    got = ring.start_games(state, 7).collect()
    assert bool(got) == starts
    if starts:
        row = got[0]
        assert (row.host, row.last_joiner, row.current_player) == ("a", names[-1], names[-2])
        assert row.card_on_table not in (1010, 1020) and row.card_on_table // 1000 == 1


def test_unlink_closes_long_gaps(spark):
    rows = [(f"u{i:02d}", f"u{(i + 1) % 20:02d}", 1) for i in range(20)]
    players = spark.createDataFrame(rows, "username string, next_player string, game_id long")
    gone = spark.createDataFrame([(f"u{i:02d}",) for i in range(2, 19)], "username string")
    left = {r.username: r.next_player for r in ring.unlink(players, gone).collect()}
    assert left == {"u00": "u01", "u01": "u19", "u19": "u00"}


def test_seats_and_slots_beyond_the_deck_are_shown(spark):
    seats = spark.createDataFrame([(1, f"p{n:02d}", n) for n in range(1, 13)], "game_id long, username string, seat int")
    dealt = deal.initial_deal(seats, 7).collect()
    assert {r.username for r in dealt if r.card_id is None} == {"p11", "p12"}
    assert len({r.card_id for r in dealt if r.card_id is not None}) == 100
    decks = deal.build_decks(spark.createDataFrame([(1,)], "game_id long")).select("card_id", "game_id")
    games = spark.createDataFrame([(1, 1490)], "game_id long, card_on_table long")
    slots = deal.redeal_hands(seats, decks, games, 7).collect()
    assert len(slots) == 120 and sum(r.card_id is None for r in slots) == 13
    assert 1490 not in {r.card_id for r in slots}
