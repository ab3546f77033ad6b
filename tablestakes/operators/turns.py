"""Batches of turn requests: taking, placing, leaving, and the move ledger."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.functions.scalars import first_match
from tablestakes.operators.changes import append, apply_deletes, apply_updates, serialise, teardown
from tablestakes.operators.deal import pick
from tablestakes.operators.guards import MESSAGES, entry_rules, place_rules, take_rules, told, with_account
from tablestakes.operators.joins import HOT_ROWS, lookup
from tablestakes.operators.numbering import with_slices
from tablestakes.operators.ring import unlink
from tablestakes.session import cut
from tablestakes.sources.catalog import HAND_SIZE, LAST_PHASE, SKIP


# What the effects of a judged request need; judged once, then written.
JUDGED = ["request_id", "ts", "login", "game_id", "hand_size", "next_player", "card_on_table"]
TOLD = ["waiting_players", "turn_holder", "table_card", "hint"]


def _settle(judged: DataFrame, detail: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests carried out (one per game), and their ids as a marker."""
    winners = (
        serialise(judged.filter("status_code = 'ok'"))
        .filter("admitted")
        .select("request_id", "login", "game_id", "hand_size", "next_player", "card_on_table", *detail)
    )
    return winners, winners.select("request_id", F.lit(True).alias("_done"))


def _final_code() -> Column:
    lost = (F.col("status_code") == "ok") & F.col("_done").isNull()
    return F.when(lost, "deferred").otherwise(F.col("status_code")).alias("status_code")


def _next_turn(players: DataFrame, winners: DataFrame, passes: Column, skips: Column) -> DataFrame:
    """(request_id, next_turn): who is on turn after the winners moved."""
    second = players.select(F.col("username").alias("next_player"), F.col("next_player").alias("_hop2"))
    return (
        winners.filter(passes)
        .join(second, "next_player", "left")
        .select("request_id", F.when(skips, F.col("_hop2")).otherwise(F.col("next_player")).alias("next_turn"))
    )


def _pass_turns(turns: DataFrame, moved: DataFrame) -> DataFrame:
    """Replace the turn of each `login` in `moved` by its `next_turn`."""
    old = moved.select(F.col("login").alias("current_player"))
    return append(
        apply_deletes(turns, old, "current_player"), moved.select(F.col("next_turn").alias("current_player"))
    )


def draw(
    state: Mapping[str, DataFrame], requests: DataFrame, seed: int | str
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Take requests (request_id, ts, login, pw, source).

    From the deck at ten cards the turn goes on; at nine it ends, and a skip
    card on the table passes it twice. The table card is only for ten. Refusals
    carry what the client is told with them (TOLD).
    """
    seen = with_account(state, requests, table_rank=True)
    judged = cut(
        seen.select(*JUDGED, "players_in_game", "current_player", "source", "table_rank", *first_match(take_rules(), ("ok", "ok")))
        .withColumns(told({"hand_full": "place_to_finish"}))
        .drop("players_in_game", "current_player")
    )
    winners, done = _settle(judged, ["source", "table_rank"])

    from_deck = winners.filter("source = 'deck'").select("request_id", "game_id", "card_on_table")
    offered = state["decks"].join(from_deck, "game_id").filter(F.col("card_id") != F.col("card_on_table"))
    held = state["hands"].select("card_id").join(offered.select("card_id"), "card_id", "left_semi")
    free = offered.join(held, "card_id", "left_anti")
    drawn = pick(free, seed, "request_id").withColumnRenamed("card_id", "drawn")
    moves = (
        winners.join(drawn, "request_id", "left")
        .join(
            _next_turn(state["players"], winners, F.col("hand_size") == 9, F.col("table_rank") == SKIP),
            "request_id",
            "left",
        )
        .select(
            "request_id", "login", "next_turn",
            F.when(F.col("source") == "deck", F.col("drawn")).otherwise(F.col("card_on_table")).alias("card_id"),
        )
    )
    status = (
        judged.select("request_id", "login", "status_code", "message", *TOLD)
        .join(done, "request_id", "left")
        .join(moves.select("request_id", "card_id", "next_turn"), "request_id", "left")
        .select("request_id", "login", _final_code(), "message", "card_id", "next_turn", *TOLD)
    )
    out = dict(state)
    out["hands"] = append(
        state["hands"], moves.filter("card_id IS NOT NULL").select("card_id", F.col("login").alias("username"))
    )
    out["turns"] = _pass_turns(state["turns"], moves.filter("next_turn IS NOT NULL"))
    return status, out


def discard(
    state: Mapping[str, DataFrame], requests: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Place requests (request_id, ts, login, pw, card_id).

    The card must be in the player's own hand. At eleven cards the turn ends
    (a skip card passes it twice); at ten a card has still to be taken, which the
    client is told with the new table card (TOLD).
    """
    owners = state["hands"].select("card_id", F.col("username").alias("owner"))
    seen = with_account(state, lookup(requests, owners, ["card_id"], "request_id"), counted=requests)
    judged = cut(
        seen.select(*JUDGED, "players_in_game", "current_player", "card_id", *first_match(place_rules(), ("ok", "ok")))
        .withColumns(told({"already_placed": "take_to_finish"}))
        .drop("players_in_game", "current_player")
    )
    winners, done = _settle(judged, ["card_id"])
    unfinished = F.col("_done") & (F.col("hand_size") == HAND_SIZE)

    faces = state["cards"].join(F.broadcast(state["card_type"]), "id").select("card_id", "rank")
    ranked = winners.join(faces, "card_id", "left")
    moves = winners.join(
        _next_turn(state["players"], ranked, F.col("hand_size") == 11, F.col("rank") == SKIP), "request_id", "left"
    )
    status = (
        judged.select("request_id", "login", "hand_size", "card_id", "status_code", "message", *TOLD)
        .join(done, "request_id", "left")
        .join(moves.select("request_id", "next_turn"), "request_id", "left")
        .withColumn("table_card", F.when(unfinished, F.col("card_id")).otherwise(F.col("table_card")))
        .withColumn("hint", F.when(unfinished, MESSAGES["take_to_finish"]).otherwise(F.col("hint")))
        .select("request_id", "login", "card_id", _final_code(), "message", "next_turn", *TOLD)
    )
    out = dict(state)
    out["hands"] = apply_deletes(state["hands"], winners.select("card_id"), "card_id")
    out["games"] = apply_updates(
        state["games"], winners.select("game_id", F.col("card_id").alias("card_on_table")), "game_id",
        ["card_on_table"],
    )
    out["turns"] = _pass_turns(state["turns"], moves.filter("next_turn IS NOT NULL"))
    return status, out


def leave_rules() -> list:
    wrong, absent, _ = entry_rules()
    return [
        wrong,
        (absent[0], "not_seated", MESSAGES["not_seated"]),
        (
            (F.col("card_on_table").isNotNull())
            & (F.col("players_in_game") > 1)
            & (F.col("hand_size") != HAND_SIZE)
            & (F.col("game_phase") <= LAST_PHASE),
            "end_turn",
            MESSAGES["end_turn"],
        ),
    ]


def leave_status(state: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Status of leave requests; `route` says what follows for the game:
    'teardown' when nobody stays, else 'unlink'. The first request of a
    player counts, later ones find no seat any more."""
    judged = cut(
        with_account(state, requests).select(
            "request_id", "ts", "login", "game_id", "players_in_game",
            *first_match(leave_rules(), ("ok", MESSAGES["left"])),
        )
    )
    first = (
        judged.filter("status_code = 'ok'")
        .groupBy("login", "game_id", "players_in_game")
        .agg(F.min(F.struct("ts", "request_id")).alias("_first"))
    )
    leaving = first.groupBy("game_id").agg(F.count("*").alias("_leaving"))
    routed = first.join(leaving, "game_id").select(
        F.col("_first.request_id").alias("request_id"),
        F.when(F.col("_leaving") == F.col("players_in_game"), "teardown").otherwise("unlink").alias("route"),
    )
    late = (F.col("status_code") == "ok") & F.col("route").isNull()
    return judged.join(routed, "request_id", "left").select(
        "request_id",
        "login",
        "game_id",
        F.when(late, "not_seated").otherwise(F.col("status_code")).alias("status_code"),
        F.when(late, MESSAGES["not_seated"]).otherwise(F.col("message")).alias("message"),
        "route",
    )


def leave(
    state: Mapping[str, DataFrame], requests: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Carry out a batch of leaves: rings are closed over the gaps, the turn
    moves to whoever follows, empty games are torn down."""
    status = cut(leave_status(state, requests))
    gone = status.filter("route IS NOT NULL").select(F.col("login").alias("username"), "game_id", "route")
    out = teardown(state, gone.filter("route = 'teardown'"))
    leavers = gone.filter("route = 'unlink'").select("username")
    before = out["players"]
    out["players"] = unlink(before, leavers)
    out["hands"] = apply_deletes(out["hands"], leavers, "username")
    holders = out["turns"].join(leavers.select(F.col("username").alias("current_player")), "current_player", "left_semi")
    # Keep a leaving turn holder's pointer and drop only the others: what it
    # then points to is the next player who stays.
    others = leavers.join(holders.select(F.col("current_player").alias("username")), "username", "left_anti")
    passed = unlink(before, others).join(
        holders.select(F.col("current_player").alias("username")), "username", "left_semi"
    )
    out["turns"] = append(
        apply_deletes(out["turns"], holders, "current_player"),
        passed.select(F.col("next_player").alias("current_player")),
    )
    reset = gone.select("username", F.lit(2).alias("p_count"))
    out["users"] = apply_updates(out["users"], reset, "username", ["p_count"])
    return status, out


def ledger(moves: DataFrame, slice_by: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hand size after every move (username, ts, event_id, delta, fresh).

    A player goes 10, 11, 10 or 10, 9, 10; anything else is flagged. A `fresh`
    row (redeal) sets the count back to ten. A player with a third of all
    moves is split by time slices: each slice runs on its own, and per slice
    only its sum and the sum at its last redeal are carried on.
    """
    upto = W.partitionBy("username", "_slice").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_sum", F.sum("delta").over(upto)).withColumn(
            "_base", F.last(F.when(F.col("fresh"), F.col("_sum")), ignorenulls=True).over(upto)
        )

    sliced = with_slices(moves, ["username"], slice_by, hot_rows)
    totals = summed(sliced.filter("_slice IS NOT NULL")).groupBy("username", "_slice").agg(
        F.sum("delta").alias("_total"),
        F.max_by("_sum", F.when(F.col("fresh"), F.struct("ts", "event_id"))).alias("_reset"),
    )
    before = W.partitionBy("username").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        totals.withColumn("_carried", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_at_reset", F.last(F.col("_carried") + F.col("_reset"), ignorenulls=True).over(before))
        .select("username", "_slice", "_carried", "_at_reset")
    )
    carry = F.coalesce("_carried", F.lit(0))
    size = F.lit(HAND_SIZE) + carry + F.col("_sum") - F.coalesce(carry + F.col("_base"), F.col("_at_reset"), F.lit(0))
    return (
        summed(sliced)
        .join(carried, ["username", "_slice"], "left")
        .select("username", "ts", "event_id", "delta", size.cast("bigint").alias("hand_size"))
        .withColumn("legal", F.col("hand_size").between(HAND_SIZE - 1, HAND_SIZE + 1))
    )
