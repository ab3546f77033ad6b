"""Random claims against a plain reading of the rules, and a round of play."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tablestakes.operators import audits, lobby, phases, turns
from tablestakes.session import scratch_dir
from tablestakes.sources import buckets
from tablestakes.sources.catalog import ACCEPTED, PHASES, WRONG_CARDS, claim_size, refusal
from tables import as_map, as_set, build, frame


def rank_color(card):
    if card >= 530:
        return 14, "blue"
    if card >= 490:
        return 13, "blue"
    face = card // 10 - 1
    return face // 4 + 1, ["green", "yellow", "red", "purple"][face % 4]


def judge(phase, cards):
    """One card after the other, the way a referee would."""
    kind, lengths, _ = PHASES[phase]
    if len(set(cards)) != len(cards):
        return 0, WRONG_CARDS
    pos = 0
    for length in lengths:
        base = rank_color(cards[pos])
        for k in range(length):
            rank, color = rank_color(cards[pos])
            if k == 0:
                good = color != "blue" if kind == "color" else rank <= 12
            elif kind == "color":
                good = color == base[1] or rank == 13
            else:
                good = rank in (13, base[0] + (k if kind == "run" else 0))
            pos += 1
            if not good:
                return pos, refusal(phase, pos)
    return None, ACCEPTED


def near_miss(rng, phase):
    """A claim that is nearly right, so that all outcomes occur."""
    kind, lengths, _ = PHASES[phase]
    deck = [10 * (n // 2 + 1) + n % 2 for n in range(96)] + list(range(490, 498)) + list(range(530, 534))
    cards = []
    for length in lengths:
        low = rng.randrange(1, 14 - length if kind == "run" else 13)
        color = rng.choice(["green", "yellow", "red", "purple"])
        for k in range(length):
            def fits(card):
                rank, shade = rank_color(card)
                return shade == color if kind == "color" else rank == low + (k if kind == "run" else 0)

            roll = rng.random()
            pool = deck if roll < 0.04 else range(490, 498) if roll < 0.2 and k else [c for c in deck if fits(c)]
            free = [c for c in pool if c not in cards] if rng.random() < 0.97 else list(pool)
            cards.append(rng.choice(free or deck))
    return cards


def test_random_claims(spark):
    rng = random.Random(11)
    claims = [(i, p, near_miss(rng, p)) for i, p in enumerate(rng.choice(list(PHASES)) for _ in range(3000))]
    want = {i: judge(p, cards) for i, p, cards in claims}
    rows = []
    for i, p, cards in claims:
        for pos, c in enumerate(cards, 1):
            rank, color = rank_color(c)
            rows.append((i, p, pos, c, rank, color))
    df = spark.createDataFrame(rows, "attempt_id long, phase int, pos int, id long, rank int, color string")
    got = {r.attempt_id: (r.fail_pos, r.message) for r in phases.verdicts(df).collect()}
    assert got == want
    assert len({(p, want[i][0]) for i, p, _ in claims if want[i][0] is not None}) > 50
    assert {p for i, p, _ in claims if want[i][1] == ACCEPTED} == set(PHASES)
    assert claim_size(10) == 8


def test_rounds_keep_every_rule(spark):
    """Create, join, then take, place and leave in batches; audits stay silent."""
    names = [f"n{i}" for i in range(7)]
    root, stored = scratch_dir(spark, "rounds"), []
    start = datetime(2024, 1, 1)
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")

    def commit(state):
        """Write back the games and accounts a batch may have touched, the first time all."""
        games, users = (state[t].select(c) for t, c in (("games", "game_id"), ("users", "username")))
        if stored:
            games = games.union(stored[-1]["games"].select("game_id"))
            buckets.write_back(spark, root, state, games, users, 4)
        else:
            buckets.write_back(spark, root, state, buckets=4)
        stored.append(buckets.load(spark, root))
        return stored[-1]

    def ask(rows, extra):
        return frame(
            spark,
            [(i, start + timedelta(seconds=i), who, f"pw-{who}", *rest) for i, (who, *rest) in enumerate(rows)],
            f"request_id long, ts timestamp_ntz, login string, pw string, {extra}",
        )

    state = build(spark, {}, {}, users=names)
    state["card_type"] = state["card_type"].select("id", "color", "rank")
    _, state = lobby.create_games(state, ask([("n0", 3, 1), ("n1", 2, 2)], "pl_count int, game_id long"), now, 1)
    state = commit(state)
    _, state = lobby.join_games(
        state, ask([("n2", 1), ("n3", 2), ("n4", 1), ("n5", 1), ("n6", 2)], "game_id long"), now, 2
    )
    state = commit(state)
    assert audits.game_invariants(state).count() == 0
    assert as_map(state["players"].groupBy("game_id").count(), "game_id", "count") == {1: 3, 2: 2}
    for step in (0,):
        on = as_set(state["turns"], "current_player")
        assert len(on) == 2
        status, state = turns.draw(state, ask([(n, "deck") for n in sorted(on)], "source string"), step)
        assert as_set(status, "status_code") == {"ok"}
        state = commit(state)
        assert as_set(state["turns"], "current_player") == on
        low = as_map(state["hands"].groupBy("username").agg(F.min("card_id").alias("c")), "username", "c")
        status, state = turns.discard(state, ask([(n, low[n]) for n in sorted(on)], "card_id long"))
        assert as_set(status, "status_code") == {"ok"}
        state = commit(state)
        assert audits.game_invariants(state).count() == 0
        sizes = as_map(state["hands"].groupBy("username").count(), "username", "count")
        assert set(sizes.values()) == {10}
    status, state = turns.leave(state, ask([("n0", 0), ("n1", 0), ("n3", 0)], "x int"))
    state = commit(state)
    assert as_map(status, "login", "route") == {"n0": "unlink", "n1": "teardown", "n3": "teardown"}
    assert as_set(state["games"], "game_id") == {1} and state["cards"].count() == state["decks"].count() == 108
    assert audits.game_invariants(state).count() == 0
    assert as_set(state["turns"], "current_player") <= {"n2", "n4"} and state["turns"].count() == 1
