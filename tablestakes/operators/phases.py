"""Phase claims: assembling the cards, judging them, scoring and redealing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestakes.functions.scalars import first_match, phase_points
from tablestakes.operators.changes import append, apply_deletes, apply_increment, apply_updates, serialise
from tablestakes.operators.deal import pick, redeal
from tablestakes.operators.guards import CLAIM_MESSAGES, account_guards, accounts, of_batch, told
from tablestakes.operators.joins import free_cards, lookup, unpacked
from tablestakes.operators.lobby import standings
from tablestakes.session import cut
from tablestakes.sources.catalog import (
    ACCEPTED, COLORS, LAST_PHASE, MAX_CLAIM, PHASES, SPECIAL_COLOR, WILD, WRONG_CARDS,
    claim_size, refusal, rule_rows,
)

PALETTE = [*COLORS, SPECIAL_COLOR]


def assemble(attempts: DataFrame, held: DataFrame) -> DataFrame:
    """Attempts (attempt_id, username, phase, cards) to one row per listed card.

    `held` is (card_id, owner, id, rank, color). Cards of other players count
    as missing. Lists of the wrong length for their phase keep no card, so
    the distinct count refuses them.
    """
    listed = attempts.select("attempt_id", "username", "phase", F.posexplode_outer("cards").alias("_p", "card_id"))
    rows = listed.select(
        "attempt_id", "username", "phase", (F.col("_p") + 1).alias("pos"), "card_id",
        F.xxhash64("attempt_id", "_p").alias("_row"),
    )
    rows = lookup(rows, held, ["card_id"], "_row").drop("_row")
    mine = F.col("owner") == F.col("username")
    return rows.select(
        "attempt_id",
        "phase",
        "pos",
        "card_id",
        *[F.when(mine, F.col(c)).alias(c) for c in ("id", "rank", "color")],
    )


def _rules_of(phase: str):
    """Size, kind, block starts, steps and refusals of a phase as one struct.

    Ten constant entries indexed by the phase: no rule table has to be joined.
    """
    entries = []
    for number, (kind, _, _) in sorted(PHASES.items()):
        mine = [r for r in rule_rows() if r[0] == number]
        entries.append(
            F.struct(
                F.lit(claim_size(number)).alias("n"),
                F.lit(kind).alias("kind"),
                F.array(*[F.lit(r[4]) for r in mine]).alias("starts"),
                F.array(*[F.lit(r[6]) for r in mine]).alias("steps"),
                F.array(*[F.lit(r[7]) for r in mine]).alias("texts"),
            )
        )
    return F.when(F.col(phase).between(1, LAST_PHASE), F.try_element_at(F.array(*entries), F.col(phase).cast("int")))


def verdicts(rows: DataFrame) -> DataFrame:
    """Judge claims given as (attempt_id, phase, pos, id, rank, color) rows.

    One aggregation: each position of a claim becomes a packed BIGINT (id, rank
    and color in one number), so the nine buffers are plain longs, combine
    map-side and stay in the hash aggregate. The rules then are a row-local
    expression over at most nine numbers; the first failing position names the
    refusal. Result: (attempt_id, phase, distinct_cards, fail_pos, message);
    fail_pos 0 refuses a wrong number of cards (too few different ones, or a list
    longer than the phase), NULL means accepted.
    """
    color_no = F.array_position(F.array(*map(F.lit, PALETTE)), F.col("color")) - 1
    packed = (F.col("id") * 1000 + F.col("rank") * 10 + color_no).cast("bigint")
    slots = [F.max(F.when(F.col("pos") == k, packed)).alias(f"s{k}") for k in range(1, MAX_CLAIM + 1)]
    claims = rows.groupBy("attempt_id", "phase").agg(*slots, F.max("pos").alias("longest"))
    ruled = (
        claims.withColumn("rule", _rules_of("phase"))
        .filter(F.col("rule").isNotNull())
        .select("attempt_id", "phase", "longest", "rule.*", *[f"s{k}" for k in range(1, MAX_CLAIM + 1)])
        .withColumn("c", F.slice(F.array(*[f"s{k}" for k in range(1, MAX_CLAIM + 1)]), F.lit(1), F.col("n")))
    )
    wrong = (F.col("distinct_cards") != F.col("n")) | (F.col("longest") > F.col("n"))
    blue = len(PALETTE) - 1
    rank, color = "((c[k - 1] div 10) % 100)", "(c[k - 1] % 10)"
    base_rank, base_color = rank.replace("k - 1", "starts[k - 1] - 1"), color.replace("k - 1", "starts[k - 1] - 1")
    bad = f"""CASE
        WHEN k = starts[k - 1] AND kind = 'color' THEN {color} = {blue}
        WHEN k = starts[k - 1] THEN {rank} > 12
        WHEN kind = 'color' THEN {color} <> {base_color} AND {rank} <> {WILD}
        ELSE {rank} <> {base_rank} + steps[k - 1] AND {rank} <> {WILD} END"""
    return (
        ruled.withColumn(
            "distinct_cards",
            F.expr("size(array_distinct(transform(filter(c, x -> x IS NOT NULL), x -> x div 1000)))"),
        )
        .withColumn("failed", F.expr(f"array_min(filter(sequence(1, n), k -> {bad}))"))
        .select(
            "attempt_id",
            "phase",
            F.col("distinct_cards").cast("bigint").alias("distinct_cards"),
            F.when(wrong, 0).otherwise(F.col("failed")).cast("int").alias("fail_pos"),
            F.when(wrong, WRONG_CARDS)
            .when(F.col("failed").isNotNull(), F.expr("texts[failed - 1]"))
            .otherwise(ACCEPTED)
            .alias("message"),
        )
    )


def advance(state: Mapping[str, DataFrame], accepted: DataFrame) -> dict[str, DataFrame]:
    """Score accepted claims (game_id, username) and move their games on a phase."""
    scored = accepted.join(state["games"].select("game_id", "game_phase").hint("merge"), "game_id")
    out = dict(state)
    out["players"] = apply_increment(
        state["players"], scored.select("username", phase_points("game_phase").alias("delta")), "username", "points"
    )
    out["games"] = apply_increment(
        state["games"], accepted.select("game_id").distinct().withColumn("delta", F.lit(1)), "game_id", "game_phase"
    )
    return out


def claim(
    state: Mapping[str, DataFrame], attempts: DataFrame, seed: int | str, check_all_turns: bool = True
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A batch of phase claims (request_id, ts, login, pw, phase, cards).

    Returns the status of every claim and the new state. One claim per game
    is carried out; a later one that would pass too is deferred. A client is told
    how many players wait, or the phase its game is in; `final_standings` answers
    the claims that end their games.
    """
    # Accounts, hands and lists are all looked up by the batch: put it together once, or every
    # one of them holds its whole plan and its broadcasts, in one query and at one time.
    attempts = unpacked(cut(attempts))
    batch = of_batch(state, attempts)
    seen = account_guards(lookup(attempts, accounts(batch).withColumnRenamed("username", "login"), ["login"], "request_id"))
    turn_free = [p for p, (_, _, checked) in PHASES.items() if not checked]
    not_turn = F.col("on_turn") == F.lit(False)
    if not check_all_turns:
        not_turn = not_turn & ~F.col("phase").isin(*turn_free)
    size = F.create_map(*[F.lit(x) for p in PHASES for x in (p, claim_size(p))])[F.col("phase")]
    held = (
        batch["hands"].join(state["cards"], "card_id").join(F.broadcast(state["card_type"]), "id")
        .select("card_id", F.col("username").alias("owner"), "id", "rank", "color")
    )
    judged = unpacked(cut(verdicts(
        assemble(
            attempts.select(
                F.col("request_id").alias("attempt_id"),
                F.col("login").alias("username"),
                "phase",
                F.when(F.size("cards") == size, F.col("cards")).alias("cards"),
            ),
            held,
        )
    ).select(F.col("attempt_id").alias("request_id"), "fail_pos", F.col("message").alias("verdict"))))
    code, text = first_match(
        [
            (F.col("bad_password"), "wrong_password", CLAIM_MESSAGES["wrong_password"]),
            (F.col("game_id").isNull(), "not_in_game", CLAIM_MESSAGES["not_in_game"]),
            (F.col("card_on_table").isNull(), "waiting", CLAIM_MESSAGES["waiting"]),
            (not_turn, "not_your_turn", CLAIM_MESSAGES["not_your_turn"]),
            (F.col("phase") != F.col("game_phase"), "wrong_phase", CLAIM_MESSAGES["wrong_phase"]),
            (F.col("verdict").isNull(), "refused", WRONG_CARDS),
            (F.col("verdict") != ACCEPTED, "refused", F.col("verdict")),
        ],
        ("ok", ACCEPTED),
    )
    # Six tables follow from the status: judge the batch once.
    status = unpacked(cut(
        seen.join(judged.hint("merge"), "request_id", "left").select(
            "request_id", "ts", "login", "game_id", "hand_size", "game_phase", "next_player", "fail_pos", code, text,
            "players_in_game", "current_player", "card_on_table",
        )
        .withColumn("waiting_players", told()["waiting_players"])
        .withColumn("current_phase", F.when(F.col("status_code") == "wrong_phase", F.col("game_phase")))
        .drop("players_in_game", "current_player", "card_on_table")
    ))
    winners = unpacked(cut(
        serialise(status.filter("status_code = 'ok'")).filter("admitted").select(
            "request_id", "game_id", F.col("login").alias("username"), "hand_size", "game_phase", "next_player"
        )
    ))
    done = winners.select("request_id", F.lit(True).alias("_done"))
    status = status.join(done, "request_id", "left").select(
        "request_id", "login", "game_id", "game_phase", "fail_pos",
        F.when((F.col("status_code") == "ok") & F.col("_done").isNull(), "deferred")
        .otherwise(F.col("status_code")).alias("status_code"),
        "message", "waiting_players", "current_phase",
    )
    out = advance(state, winners.select("game_id", "username"))
    going = winners.filter(F.col("game_phase") < LAST_PHASE)
    took = going.filter("hand_size = 11").select("game_id")
    free = free_cards(state["decks"].join(took, "game_id", "left_semi"), state["hands"])
    out["games"] = apply_updates(
        out["games"], pick(free, seed).withColumnRenamed("card_id", "card_on_table"), "game_id", ["card_on_table"]
    )
    out = redeal(out, going, seed)
    passed = going.select(F.col("username").alias("current_player"), "next_player")
    out["turns"] = append(
        apply_deletes(out["turns"], winners.select(F.col("username").alias("current_player")), "current_player"),
        passed.select(F.col("next_player").alias("current_player")),
    )
    return status, out



def final_standings(status: DataFrame, state: Mapping[str, DataFrame]) -> DataFrame:
    """What a claim of the last phase is answered with: the standings of its game.

    `status` and `state` are the results of `claim`. One row per player of each game that
    the batch ended, with the request that ended it; other claims have none.
    """
    ended = status.filter((F.col("status_code") == "ok") & (F.col("game_phase") == LAST_PHASE))
    return ended.select("request_id", "game_id").join(standings(state), "game_id").select(
        "request_id", "game_id", "info", "players", "points", "place"
    )
