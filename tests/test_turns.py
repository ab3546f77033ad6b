from datetime import datetime

from pyspark.sql import functions as F

from tablestakes.operators import numbering, turns
from tables import as_map, as_set, build

TAKE = "request_id long, ts timestamp_ntz, login string, pw string, source string"
PLACE = "request_id long, ts timestamp_ntz, login string, pw string, card_id long"


MINE = [10, 20, 30, 40, 50, 60, 70, 80, 530, 90, 100]


def one(g, held, table=330, phase=1, seats=3):
    """Game g as (game, hands): player a<g> is on turn with `held` cards."""
    a, b, c = (f"{x}{g}" for x in "abc")
    ring = {3: [(a, c), (b, a), (c, b)], 2: [(a, b), (b, a)]}[seats]
    hands = {a: [1000 * g + k for k in MINE[:held]], b: [1000 * g + 10 * k for k in range(20, 30)]}
    return dict(ring=ring, table=1000 * g + table, phase=phase), hands


def site(spark, *games):
    """One state with game 1, 2, … and a waiting game of player w."""
    table, hands = {0: dict(ring=[("w", None)], table=None)}, {}
    for g, spec in enumerate(games, start=1):
        table[g], held = one(g, **spec)
        hands.update(held)
    on = [f"a{g}" for g, spec in enumerate(games, start=1) if spec.get("phase", 1) < 11]
    return build(spark, table, hands, turns=on, users=["idle"])


def ask(spark, schema, *rows):
    return spark.createDataFrame(
        [(i, datetime(2024, 1, 1, 0, i), who, f"pw-{who}", what) for i, (who, what) in enumerate(rows)], schema
    )


def test_draw(spark):
    # held, source, table card, status, who is on turn after
    cases = [
        (10, "deck", 330, "ok", "a"),
        (10, "table", 330, "ok", "a"),
        (10, "table", 531, "deck_only", "a"),
        (9, "deck", 330, "ok", "c"),
        (9, "deck", 531, "ok", "b"),
        (9, "table", 330, "deck_only", "a"),
        (11, "deck", 330, "hand_full", "a"),
        (10, "pocket", 330, "bad_source", "a"),
    ]
    state = site(spark, *[dict(held=h, table=t) for h, _, t, _, _ in cases])
    status, after = turns.draw(state, ask(spark, TAKE, *[(f"a{g}", c[1]) for g, c in enumerate(cases, 1)]), 7)
    rows = {r.login: r for r in status.collect()}
    before = as_set(state["hands"], "card_id")
    owned = after["hands"].collect()
    for g, (held, source, table, code, turn) in enumerate(cases, start=1):
        row, mine = rows[f"a{g}"], {r.card_id for r in owned if r.username == f"a{g}"}
        assert row.status_code == code
        assert row.next_turn == (None if turn == "a" else f"{turn}{g}")
        assert len(mine) == held + (code == "ok")
        if code == "ok":
            assert row.card_id in mine - before and row.card_id // 1000 == g
            assert (row.card_id == 1000 * g + table) == (source == "table")
    assert as_set(after["turns"], "current_player") == {f"{c[4]}{g}" for g, c in enumerate(cases, 1)}


def test_draw_guards_and_one_request_per_game(spark):
    state = site(spark, dict(held=10), dict(held=10, phase=11))
    status, after = turns.draw(
        state,
        ask(spark, TAKE, *[(who, "deck") for who in ("idle", "w", "b1", "a1", "a1", "ghost", "a2")]),
        7,
    )
    assert as_map(status, "request_id", "status_code") == {
        0: "not_in_game", 1: "waiting", 2: "not_your_turn", 3: "ok", 4: "deferred", 5: "wrong_password", 6: "game_over"
    }
    assert after["hands"].count() == state["hands"].count() + 1


def test_discard(spark):
    # held, card, seats, status, who is on turn after
    cases = [
        (11, 10, 3, "ok", "c"),
        (11, 530, 3, "ok", "b"),
        (11, 530, 2, "ok", "a"),
        (10, 10, 3, "ok", None),
        (9, 10, 3, "already_placed", None),
        (11, 200, 3, "wrong_card", None),
        (11, None, 3, "wrong_card", None),
    ]
    state = site(spark, *[dict(held=h, seats=s) for h, _, s, _, _ in cases])
    asked = [(f"a{g}", None if c[1] is None else 1000 * g + c[1]) for g, c in enumerate(cases, 1)]
    status, after = turns.discard(state, ask(spark, PLACE, *asked))
    rows = {r.login: r for r in status.collect()}
    shown, owned = as_map(after["games"], "game_id", "card_on_table"), after["hands"].collect()
    for g, (held, card, _, code, turn) in enumerate(cases, start=1):
        row = rows[f"a{g}"]
        assert (row.status_code, row.next_turn) == (code, turn and f"{turn}{g}")
        assert shown[g] == 1000 * g + (card if code == "ok" else 330)
        assert sum(r.username == f"a{g}" for r in owned) == held - (code == "ok")
        assert sum(r.username == f"b{g}" for r in owned) == 10
    assert as_set(after["turns"], "current_player") == {f"{c[4] or 'a'}{g}" for g, c in enumerate(cases, 1)}


def test_clients_are_told_what_to_do(spark):
    state = site(spark, dict(held=11), dict(held=9), dict(held=10), dict(held=10, phase=11))
    taken, _ = turns.draw(state, ask(spark, TAKE, *[(n, "deck") for n in ("w", "b1", "a1", "a3", "a3", "a4", "ghost", "idle")]), 7)
    rows = {r.request_id: (r.status_code, r.waiting_players, r.turn_holder, r.table_card, r.hint) for r in taken.collect()}
    nothing = (None, None, None, None)
    assert rows == {
        0: ("waiting", 1, None, None, None), 1: ("not_your_turn", None, "a1", 1330, None),
        2: ("hand_full", None, None, None, "Call p_card to finish your turn"), 3: ("ok", *nothing), 4: ("deferred", *nothing),
        5: ("game_over", *nothing), 6: ("wrong_password", *nothing), 7: ("not_in_game", *nothing),
    }
    placed, _ = turns.discard(state, ask(spark, PLACE, ("a1", 1010), ("a2", 2010), ("a3", 3020), ("a3", 3010), ("b3", 1), ("w", None)))
    rows = {r.request_id: (r.status_code, r.waiting_players, r.turn_holder, r.table_card, r.hint) for r in placed.collect()}
    take = "Call t_card to finish your turn"
    assert rows == {
        0: ("ok", *nothing), 1: ("already_placed", None, None, None, take), 2: ("ok", None, None, 3020, take), 3: ("deferred", *nothing),
        4: ("not_your_turn", None, "a3", 3330, None), 5: ("waiting", 1, None, None, None),
    }


LEAVE = "request_id long, ts timestamp_ntz, login string, pw string"


def leaves(spark, *who):
    return spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i), w, f"pw-{w}") for i, w in enumerate(who)], LEAVE)


def test_leave_unlinks_passes_and_tears_down(spark):
    ten = {n: [1000 * g + 10 * k + j for k in range(s, s + 10)] for n, g, s, j in
           (("a", 1, 1, 0), ("b", 1, 11, 0), ("c", 1, 21, 0), ("d", 1, 31, 0))}
    state = build(
        spark,
        {
            1: dict(ring=[("a", "d"), ("b", "a"), ("c", "b"), ("d", "c")], table=1490, wants=4),
            2: dict(ring=[("w", None), ("v", "w")], table=None, wants=3),
            3: dict(ring=[("s", "s")], table=3490),
        },
        {**ten, "w": [2010], "v": [2020], "s": [3010 + 10 * k for k in range(10)]},
        turns=["c", "v", "s"],
        users=["idle"],
    )
    status, after = turns.leave(state, leaves(spark, "c", "b", "w", "s", "idle", "c"))
    assert as_map(status, "request_id", "status_code") == {0: "ok", 1: "ok", 2: "ok", 3: "ok", 4: "not_seated", 5: "not_seated"}
    assert as_map(status.filter("route IS NOT NULL"), "login", "route") == {
        "c": "unlink", "b": "unlink", "w": "unlink", "s": "teardown"
    }
    assert as_map(after["players"], "username", "next_player") == {"a": "d", "d": "a", "v": None}
    assert as_set(after["turns"], "current_player") == {"a", "v"}
    assert as_set(after["games"], "game_id") == {1, 2}
    assert as_set(after["hands"], "username") == {"a", "d", "v"}
    assert after["decks"].count() == after["cards"].count() == 216
    assert after["users"].count() == state["users"].count()
    assert as_map(after["users"], "username", "p_count")["b"] == 2


def test_leave_needs_ten_cards_unless_the_game_is_over(spark):
    state = site(spark, dict(held=11), dict(held=11, phase=11))
    status = turns.leave_status(state, leaves(spark, "a1", "a2"))
    assert as_map(status, "login", "status_code") == {"a1": "end_turn", "a2": "ok"}


def brute_ledger(moves):
    sizes, out = {}, {}
    for user, ts, eid, delta, fresh in sorted(moves, key=lambda m: (m[1], m[2])):
        sizes[user] = 10 if fresh else sizes.get(user, 10) + delta
        out[eid] = sizes[user]
    return out


def test_ledger_with_a_hot_player(spark):
    import random

    rng = random.Random(5)
    moves = []
    for eid in range(600):
        user = "hot" if rng.random() < 0.6 else f"u{rng.randrange(5)}"
        fresh = rng.random() < 0.05
        moves.append((user, datetime(2024, 1, 1 + eid // 60, rng.randrange(24), rng.randrange(60)), eid,
                      0 if fresh else rng.choice([1, -1, 0]), fresh))
    df = spark.createDataFrame(moves, "username string, ts timestamp_ntz, event_id long, delta int, fresh boolean")
    for hot_rows in (50, 10**9):
        got = turns.ledger(df, numbering.time_slice("ts"), hot_rows)
        assert as_map(got, "event_id", "hand_size") == brute_ledger(moves)
    assert got.filter((F.col("hand_size") > 11) & F.col("legal")).count() == 0
