import pytest
from pyspark.sql import functions as F

from tablestakes.operators import phases
from tablestakes.sources.catalog import ACCEPTED, HAND_SIZE, card_catalog, phase_rules
from tables import as_map, as_set, build

BASE, STATS, BLUE = (
    "Combination starts with card from 1 to 12, not jocker",
    "Combination stats for 1 to 12, not jocker",
    "Combination starts not from blue card",
)
WRONG = "Something wrong with your cards"

# Fixed values: (phase, cards, failing position or None, message)
ATTEMPTS = [
    (1, "10,20,30,50,60,70", None, ACCEPTED),
    (1, "10,490,491,50,492,493", None, ACCEPTED),
    (1, "10,20,30,11,21,31", None, ACCEPTED),
    (1, "490,10,20,50,60,70", 1, BASE),
    (1, "10,50,20,90,100,110", 2, "Troubles with second card"),
    (1, "10,20,530,50,60,70", 3, "Troubles with third card"),
    (1, "10,20,30,490,60,70", 4, STATS),
    (1, "10,20,30,50,60,90", 6, "Troubles with fifth card"),
    (1, "10,10,20,50,60,70", 0, WRONG),
    (2, "10,50,90,130,170", None, ACCEPTED),
    (2, "10,50,490,130,170", None, ACCEPTED),
    (2, "370,410,450,490,530", None, ACCEPTED),
    (2, "530,10,50,90,130", 1, STATS),
    (2, "10,530,90,130,170", 2, "Troubles with second card"),
    (2, "10,50,130,170,210", 3, "Troubles with third card"),
    (2, "10,490,50,90,130", 3, "Troubles with third card"),
    (3, "10,50,90,130,170", None, ACCEPTED),
    (3, "10,490,11,491,51", None, ACCEPTED),
    (3, "490,10,50,90,130", 1, BLUE),
    (3, "10,530,50,90,130", 2, "Troubles with second card"),
    (3, "10,50,90,130,180", 5, "Troubles with fifth card"),
    (4, "10,50,90,130,170,210,250", None, ACCEPTED),
    (4, "20,50,90,130,170,210,290", 7, "Troubles with seventh card"),
    (5, "10,50,90,130,170,210,250,290", None, ACCEPTED),
    (5, "170,210,250,290,330,370,410,450", None, ACCEPTED),
    (5, "10,50,90,130,170,210,250,330", 8, "Troubles with eighth card"),
    (6, "10,11,20,21,50,51,60,61", None, ACCEPTED),
    (6, "10,11,20,21,530,51,60,61", 5, STATS),
    (6, "10,11,20,21,50,51,60,90", 8, "Troubles with fifth card"),
    (7, "10,50,90,130,170,210,250,290,330", None, ACCEPTED),
    (7, "10,50,90,130,170,210,250,290,370", 9, "Troubles with eighth card"),
    (8, "10,50,90,130,170,210,250", None, ACCEPTED),
    (8, "10,50,90,130,170,210,260", 7, "Troubles with seventh card"),
    (9, "10,20,30,50,60,70,90,100,110", None, ACCEPTED),
    (9, "10,20,30,50,60,70,490,90,100", 7, STATS),
    (9, "10,20,30,50,60,70,90,100,130", 9, "Troubles with fifth card"),
    (10, "10,11,50,51,90,91,130,131", None, ACCEPTED),
    (10, "10,11,50,51,90,91,130,170", 8, "Troubles with fourth card"),
    (10, "10,490,50,491,90,492,130,493", None, ACCEPTED),
]


def held_by(spark, *owners):
    """Every owner holds a full set of cards; card ids are owner number * 1000 + type."""
    names = spark.createDataFrame([(i, o) for i, o in enumerate(owners)], "g int, owner string")
    return card_catalog(spark).join(names).select((F.col("g") * 1000 + F.col("id")).alias("card_id"), "owner", "id", "rank", "color")


def test_catalog_and_rules(spark):
    assert card_catalog(spark).count() == 108
    assert as_set(card_catalog(spark).filter("id IN (10, 11, 20, 481, 490, 533)"), "id", "color", "rank") == {
        (10, "green", 1), (11, "green", 1), (20, "yellow", 1), (481, "purple", 12), (490, "blue", 13), (533, "blue", 14)
    }
    assert phase_rules(spark).count() == 72


def test_every_attempt(spark):
    rows = [(i, "me", p, [int(c) for c in cards.split(",")]) for i, (p, cards, _, _) in enumerate(ATTEMPTS)]
    attempts = spark.createDataFrame(rows, "attempt_id long, username string, phase int, cards array<long>")
    got = {
        r.attempt_id: (r.fail_pos, r.message)
        for r in phases.verdicts(phases.assemble(attempts, held_by(spark, "me"))).collect()
    }
    assert got == {i: (pos, text) for i, (_, _, pos, text) in enumerate(ATTEMPTS)}


def test_other_players_cards_do_not_count(spark):
    attempts = spark.createDataFrame(
        [(1, "me", 1, [10, 20, 30, 50, 60, 1070])], "attempt_id long, username string, phase int, cards array<long>"
    )
    row = phases.verdicts(phases.assemble(attempts, held_by(spark, "me", "you"))).first()
    assert (row.fail_pos, row.message, row.distinct_cards) == (0, WRONG, 5)


SET6 = [10, 20, 30, 50, 60, 70]


def table(spark, phase=1, extra=(), turn="a"):
    ring = [("a", "c"), ("b", "a"), ("c", "b")]
    mine = [1000 + c for c in SET6 + [90, 100, 110, 120]]
    other = [1000 + c for c in (130, 140, 150, 160, 170, 180, 190, 200, 210, 220)]
    third = [1000 + c for c in (230, 240, 250, 260, 270, 280, 290, 300, 310, 320)]
    return build(
        spark,
        {
            1: dict(ring=ring, table=1330, phase=phase, points={"a": 5}),
            2: dict(ring=[("x", None)], table=None, wants=2),
            3: dict(ring=[("p", "q"), ("q", "p")], table=3330, phase=2),
        },
        {"a": mine + list(extra), "b": other, "c": third, "p": [3010, 3050, 3090, 3130, 3170, 3011, 3051, 3091, 3131, 3171],
         "q": [3020 + 10 * i for i in (0, 1, 4, 5, 8, 9, 12, 13, 16, 17)]},
        turns=[turn, "p"],
        users=["idle"],
    )


CLAIM = "request_id long, ts timestamp_ntz, login string, pw string, phase int, cards array<long>"


def claims(spark, *rows):
    from datetime import datetime

    return spark.createDataFrame(
        [(i, datetime(2024, 1, 1, 0, i), who, pw or f"pw-{who}", phase, cards) for i, (who, pw, phase, cards) in enumerate(rows)],
        CLAIM,
    )


def test_claim_statuses(spark):
    mine = [1000 + c for c in SET6]
    status, _ = phases.claim(
        table(spark),
        claims(
            spark,
            ("a", "bad", 1, mine),
            ("idle", None, 1, mine),
            ("x", None, 1, mine),
            ("b", None, 1, mine),
            ("a", None, 2, mine[:5]),
            ("a", None, 1, mine[:5]),
            ("a", None, 1, mine[:5] + [1130]),
            ("a", None, 1, mine),
            ("a", None, 1, mine),
        ),
        7,
    )
    got = {r.request_id: (r.status_code, r.message) for r in status.collect()}
    assert got == {
        0: ("wrong_password", "Wrong password"),
        1: ("not_in_game", "Connect to game or create new first"),
        2: ("waiting", "Waiting for players"),
        3: ("not_your_turn", "Wait for your turn"),
        4: ("wrong_phase", "Sorry"),
        5: ("refused", WRONG),
        6: ("refused", WRONG),
        7: ("ok", ACCEPTED),
        8: ("deferred", ACCEPTED),
    }
    told = {r.request_id: (r.waiting_players, r.current_phase) for r in status.collect()}
    assert told.pop(2)[0] == 1 and told.pop(4) == (None, 1) and set(told.values()) == {(None, None)}


@pytest.mark.parametrize("extra", [(), (1340,)])
def test_claim_scores_redeals_and_passes(spark, extra):
    before = table(spark, extra=extra)
    _, after = phases.claim(before, claims(spark, ("a", None, 1, [1000 + c for c in SET6])), 7)
    assert as_map(after["players"].filter("game_id = 1"), "username", "points") == {"a": 6, "b": 0, "c": 0}
    assert as_map(after["games"], "game_id", "game_phase") == {1: 2, 2: 1, 3: 2}
    assert as_set(after["turns"], "current_player") == {"c", "p"}
    hands = after["hands"].collect()
    sizes = {}
    for r in hands:
        sizes[r.username] = sizes.get(r.username, 0) + 1
    assert sizes == {"a": 10, "b": 10, "c": 10, "p": 10, "q": 10}
    assert len({r.card_id for r in hands}) == len(hands)
    face_up = as_map(after["games"], "game_id", "card_on_table")
    assert face_up[1] not in {r.card_id for r in hands}
    if extra:
        old = {r.card_id for r in before["hands"].collect()}
        assert face_up[1] not in old
    else:
        assert face_up[1] == 1330
    assert as_set(after["hands"].filter("username IN ('p', 'q')"), "card_id", "username") == as_set(
        before["hands"].filter("username IN ('p', 'q')"), "card_id", "username"
    )
    assert HAND_SIZE == 10


def test_last_phase_ends_the_game(spark):
    state = table(spark, phase=10)
    state["hands"] = state["hands"].filter("username <> 'a'").unionByName(
        spark.createDataFrame([(1000 + c, "a") for c in (10, 11, 50, 51, 90, 91, 131, 490, 20, 21)], "card_id long, username string")
    )
    cards = [1000 + c for c in (10, 11, 50, 51, 90, 91, 131, 490)]
    status, after = phases.claim(state, claims(spark, ("a", None, 10, cards)), 7)
    assert status.first().status_code == "ok"
    assert as_map(after["games"], "game_id", "game_phase")[1] == 11
    assert as_map(after["players"], "username", "points")["a"] == 5 + 19
    assert as_set(after["turns"], "current_player") == {"p"}
    told = {tuple(r) for r in phases.final_standings(status, after).collect()}
    assert told == {(0, 1, "Game is over", "a", 24, 3), (0, 1, "Game is over", "b", 0, 1), (0, 1, "Game is over", "c", 0, 1)}
    other, later = phases.claim(table(spark), claims(spark, ("a", None, 1, [1000 + c for c in SET6])), 7)
    assert other.first().status_code == "ok" and phases.final_standings(other, later).count() == 0


def test_turn_check_of_three_phases_can_be_left_out(spark):
    run = [3020, 3060, 3100, 3140, 3180]
    state = table(spark)
    for check_all, code in ((True, "not_your_turn"), (False, "refused")):
        status, _ = phases.claim(state, claims(spark, ("q", None, 2, [3020, 3030, 3060, 3070, 3100])), 7, check_all)
        assert status.first().status_code == code
    assert run
