import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablestakes.operators import lobby
from tables import NOW, as_map, as_set, build



def as_of():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def at(i):
    return datetime(2024, 1, 1) + timedelta(seconds=i)


def test_registration_equals_serving_one_by_one(spark):
    rng = random.Random(2)
    names = ["ab", "cd", "x", "é", "", "old", "zz"]
    rows = [(i, at(rng.randrange(40)), rng.choice(names), rng.choice(["pw", "p", "é", ""])) for i in range(200)]
    users = spark.createDataFrame([("old",)], "username string")
    known, want = {"old"}, {}
    for i, _, login, pw in sorted(rows, key=lambda r: (r[1], r[0])):
        if login in known:
            want[i] = "taken_login"
        elif len(login.encode()) < 2:
            want[i] = "short_login"
        elif len(pw.encode()) < 2:
            want[i] = "short_password"
        else:
            known.add(login)
            want[i] = "ok"
    asked = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, login string, pw string")
    assert as_map(lobby.register(users, asked), "request_id", "status_code") == want
    state = {"users": spark.createDataFrame([("old", "d", NOW, 2)], "username string, u_password string, activity timestamp_ntz, p_count int")}
    _, after = lobby.register_users(state, asked, as_of(), F.sha2("pw", 256))
    assert as_set(after["users"], "username") == known


def test_lobby_window(spark):
    hours = {"edge": timedelta(hours=-6), "late": timedelta(hours=-6, seconds=-1), "future": timedelta(hours=1), "now": timedelta(0)}
    state = build(
        spark,
        {i: dict(ring=[(n, None)], table=None) for i, n in enumerate(hours)} | {9: dict(ring=[("r", "r")], table=9010)},
        {},
        activity={n: NOW + d for n, d in hours.items()},
        users=["idle"],
    )
    rows = lobby.lobby(state, as_of()).collect()
    assert [(r.created_by, r.minutes_ago) for r in rows] == [("edge", 360), ("now", 0), ("future", -60)]
    asked = spark.createDataFrame(
        [(1, "idle", "pw-idle"), (2, "edge", "pw-edge"), (3, "idle", "no")], "request_id long, login string, pw string"
    )
    got = {r.request_id: (r.status_code, r.game_id) for r in lobby.route(state, asked, as_of()).collect()}
    assert got == {1: ("list", None), 2: ("seated", 0), 3: ("wrong_password", None)}
    old = lobby.route(state, asked, F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'"))
    assert as_map(old, "request_id", "status_code")[1] == "empty"


def test_create_games(spark):
    state = build(spark, {1: dict(ring=[("s", None)], table=None)}, {}, users=["a", "b", "c"])
    asked = spark.createDataFrame(
        [
            (1, at(1), "a", "pw-a", 3, 101), (2, at(2), "a", "pw-a", 2, 102), (3, at(3), "b", "pw-b", 7, 103),
            (4, at(4), "c", "bad", 2, 104), (5, at(5), "s", "pw-s", 2, 105), (6, at(6), "b", "pw-b", 2, 106),
        ],
        "request_id long, ts timestamp_ntz, login string, pw string, pl_count int, game_id long",
    )
    status, after = lobby.create_games(state, asked, as_of(), 7)
    assert as_map(status, "request_id", "status_code") == {
        1: "ok", 2: "seated", 3: "wrong_count", 4: "wrong_password", 5: "seated", 6: "ok"
    }
    assert as_set(after["games"], "game_id", "game_phase") == {(1, 1), (101, 1), (106, 1)}
    assert as_map(after["decks"].groupBy("game_id").count(), "game_id", "count") == {1: 108, 101: 108, 106: 108}
    assert as_map(after["hands"].groupBy("username").count(), "username", "count") == {"a": 10, "b": 10}
    assert as_set(after["turns"], "current_player") == {"a", "b"}
    assert as_map(after["users"], "username", "p_count")["a"] == 3


def test_joining_equals_serving_one_by_one(spark):
    """Four waiting games, one running one; a third of all requests want game 1."""
    rng = random.Random(4)
    users = [f"n{i}" for i in range(12)]
    wants = {1: 6, 2: 2, 3: 3, 4: 5}
    rings = {
        1: [("h1", None)], 2: [("h2", None)], 3: [("h3", None), ("k3", "h3")],
        4: [("h4", None), ("k4", "h4"), ("m4", "k4")], 5: [("r", "r")],
    }
    turn = {1: "h1", 2: "h2", 3: "k3", 4: "m4", 5: "r"}
    games = {g: dict(ring=r, table=5010 if g == 5 else None, wants=wants.get(g, 2)) for g, r in rings.items()}
    held = {n: [1000 * g + 10 * (10 * s + k + 1) for k in range(10)] for g, r in rings.items() if g < 5
            for s, (n, _) in enumerate(r)}
    state = build(spark, games, held, users=users, turns=turn.values())
    rows = [
        (i, at(rng.randrange(60)), rng.choice([*users, "h1"]), rng.choice([1, 1, 2, 3, 4, 5, 77]), rng.random() < 0.1)
        for i in range(40)
    ]
    # One by one, each login with its first sound request; its later ones wait for the outcome.
    seated = {n for r in rings.values() for n, _ in r}
    before, tried, got_seat = set(seated), set(), set()
    chain = {g: dict(r) for g, r in rings.items()}
    want = {}
    for i, _, login, game, wrong in sorted(rows, key=lambda r: (r[1], r[0])):
        sound = not wrong and game in rings and login not in before and game != 5
        if wrong:
            want[i] = "wrong_password"
        elif game not in rings:
            want[i] = "wrong_game"
        elif login in before:
            want[i] = "seated"
        elif game == 5:
            want[i] = "full"
        elif login in tried:
            want[i] = ("later", login)
        else:
            tried.add(login)
            if len(chain[game]) >= wants[game]:
                want[i] = "full"
                continue
            want[i] = "ok"
            got_seat.add(login)
            chain[game][login] = turn[game]
            if len(chain[game]) < wants[game]:
                turn[game] = login
            else:
                chain[game][f"h{game}"] = login
        assert sound or want[i] != "ok"
    want = {
        i: c if isinstance(c, str) else "seated" if c[1] in got_seat else "deferred" for i, c in want.items()
    }
    asked = spark.createDataFrame(
        [(i, ts, who, "no" if wrong else f"pw-{who}", g) for i, ts, who, g, wrong in rows],
        "request_id long, ts timestamp_ntz, login string, pw string, game_id long",
    )
    status, after = lobby.join_games(state, asked, as_of(), 7)
    assert as_map(status, "request_id", "status_code") == want
    rows_after = after["players"].collect()
    by_game = {}
    for r in rows_after:
        by_game.setdefault(r.game_id, {})[r.username] = r.next_player
    assert by_game == chain
    table = as_map(after["games"], "game_id", "card_on_table")
    sizes = as_map(after["hands"].groupBy("username").count(), "username", "count")
    turns = as_set(after["turns"], "current_player")
    for g in range(1, 5):
        ring = by_game[g]
        assert (table[g] is not None) == (len(ring) == wants[g])
        assert sum(n is None for n in ring.values()) == (0 if table[g] else 1)
        assert all(sizes[n] == 10 for n in ring)
        assert turns & set(ring) == {turn[g]}
    cards = [r.card_id for r in after["hands"].collect()]
    assert len(cards) == len(set(cards)) and not set(cards) & {t for t in table.values() if t}


@pytest.mark.parametrize("logins", [["n1", "n2", "n3", "n4"]])
def test_seats_go_to_the_first_comers_and_the_ring_closes(spark, logins):
    state = build(spark, {1: dict(ring=[("h", None)], table=None, wants=4)}, {"h": [1010 + 10 * k for k in range(10)]},
                  users=logins, turns=["h"])
    asked = spark.createDataFrame(
        [(i, at(i), n, f"pw-{n}", 1) for i, n in enumerate(logins)],
        "request_id long, ts timestamp_ntz, login string, pw string, game_id long",
    )
    status, after = lobby.join_games(state, asked, as_of(), 7)
    assert as_map(status, "login", "status_code") == {"n1": "ok", "n2": "ok", "n3": "ok", "n4": "full"}
    assert as_map(after["players"], "username", "next_player") == {"h": "n3", "n1": "h", "n2": "n1", "n3": "n2"}
    assert as_set(after["turns"], "current_player") == {"n2"}
    assert as_map(after["users"], "username", "p_count")["n1"] == 4
    shown = {}
    for r in lobby.players_shown(status, after).collect():
        shown.setdefault((r.request_id, r.info), set()).add(r.players_in_game)
    assert shown == {(0, None): {"h", "n1"}, (1, None): {"h", "n1", "n2"}, (2, "Game start!"): {"h", "n1", "n2", "n3"}}
    again, later = lobby.join_games(after, asked, as_of(), 7)
    assert lobby.players_shown(again, later).count() == 0


def test_snapshot_and_reports(spark):
    state = build(
        spark,
        {1: dict(ring=[("a", "b"), ("b", "a")], table=1490, phase=3, points={"a": 4}),
         2: dict(ring=[("w", None)], table=None),
         3: dict(ring=[("p", "q"), ("q", "p")], table=3010, phase=11, points={"p": 60, "q": 40})},
        {"a": [1010], "b": [1530]},
        turns=["a"],
    )
    rows = as_set(lobby.snapshot(state).filter("game_id = 1"), "viewer", "section_order", "info", "my_cards", "color", "rank")
    assert rows == {
        ("a", 1, "hand", "1010", "green", "1"), ("b", 1, "hand", "1530", "blue", "14"),
        (None, 2, "table", "1490", "blue", "13"), (None, 3, "current player", "a", "plase", "3"),
        (None, 4, "players in game", "a", "4", "b"), (None, 4, "players in game", "b", "0", "a"),
    }
    assert lobby.snapshot(state).filter("game_id = 2").count() == 0
    assert as_set(lobby.standings(state), "players", "place") == {("q", 1), ("p", 2)}
    report = {r.game_phase: (r.games, r.points_given, r.points_held) for r in lobby.progress(state).collect()}
    assert report == {1: (1, 0, 0), 3: (1, 4, 4), 11: (1, 100, 100)}
