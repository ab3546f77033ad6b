"""The seat ring: closing it, walking it, cutting players out, starting games."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.operators.deal import pick
from tablestakes.operators.joins import free_cards
from tablestakes.session import cut


def seat_ring(seats: DataFrame) -> DataFrame:
    """Close the ring of (game_id, username, seat): each seat hands on to the
    one that joined before it, the first to the last. At most MAX_SEATS rows
    share a game, so the window stays tiny."""
    table = W.partitionBy("game_id").orderBy("seat")
    last = F.last("username").over(table.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return seats.select(
        "game_id", "username", F.coalesce(F.lag("username").over(table), last).alias("next_player")
    )


def successors(players: DataFrame) -> DataFrame:
    """(username, hop1, hop2): next in turn and the one after."""
    second = players.select(F.col("username").alias("hop1"), F.col("next_player").alias("hop2"))
    return players.select("username", F.col("next_player").alias("hop1")).join(second, "hop1", "left")


def unlink(players: DataFrame, leavers: DataFrame) -> DataFrame:
    """Players left after a batch of leavers, pointers closed over the gaps.

    A run of adjacent leavers is crossed by pointer jumping on the leavers
    alone: each round doubles the distance, until it covers the most leavers of a game.
    """
    gone = players.join(leavers.select("username").distinct(), "username", "left_semi")
    jump = cut(gone.select("username", "next_player", "game_id"))
    most = jump.groupBy("game_id").count().agg(F.max("count")).first()[0] or 0
    hop, reach = jump.select("username", "next_player"), 1
    while reach < most:
        far = hop.select(
            F.col("username").alias("next_player"), F.col("next_player").alias("_far"), F.lit(True).alias("_gone")
        )
        hop = hop.join(far, "next_player", "left").select(
            "username", F.when(F.col("_gone"), F.col("_far")).otherwise(F.col("next_player")).alias("next_player")
        )
        reach *= 2
    stay = players.join(jump.select("username"), "username", "left_anti")
    over = hop.select(
        F.col("username").alias("next_player"), F.col("next_player").alias("_to"), F.lit(True).alias("_gone")
    )
    return stay.join(over, "next_player", "left").select(
        *[
            F.when(F.col("_gone"), F.col("_to")).otherwise(F.col("next_player")).alias("next_player")
            if c == "next_player"
            else F.col(c)
            for c in players.columns
        ]
    )


def seats_filled(state: Mapping[str, DataFrame]) -> DataFrame:
    """Waiting games: seats taken against the number the host asked for."""
    waiting = state["games"].filter(F.col("card_on_table").isNull()).select("game_id")
    return (
        state["players"].join(waiting, "game_id", "left_semi")
        .join(state["users"].select("username", "p_count"), "username")
        .groupBy("game_id")
        .agg(
            F.count("*").alias("seats"),
            F.max(F.when(F.col("next_player").isNull(), F.col("p_count"))).alias("p_count"),
        )
        .withColumn("filled", F.col("seats") >= F.col("p_count"))
    )


def start_games(state: Mapping[str, DataFrame], seed: int | str) -> DataFrame:
    """Filled waiting games as (game_id, card_on_table, current_player, host, last_joiner).

    The last joiner is the seat nobody points to; the turn starts with the one
    who joined just before.
    """
    ready = cut(seats_filled(state).filter("filled").select("game_id"))
    inside = state["players"].join(ready, "game_id", "left_semi")
    pointed = inside.filter(F.col("next_player").isNotNull()).select(F.col("next_player").alias("username"))
    last = inside.join(pointed, "username", "left_anti").select(
        "game_id", F.col("username").alias("last_joiner"), F.col("next_player").alias("current_player")
    )
    host = inside.filter(F.col("next_player").isNull()).select("game_id", F.col("username").alias("host"))
    free = free_cards(state["decks"].join(ready, "game_id", "left_semi"), state["hands"])
    table = pick(free, seed).withColumnRenamed("card_id", "card_on_table")
    return last.join(host, "game_id").join(table, "game_id").select(
        "game_id", "card_on_table", "current_player", "host", "last_joiner"
    )
