"""Decks, seeded dealing, random picks and redeals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.functions.scalars import seeded_hash, seeded_rank
from tablestakes.operators.changes import append, apply_deletes
from tablestakes.session import cut
from tablestakes.sources.catalog import (
    DECK_SIZE, HAND_SIZE, card_key, nth_card_id, shuffled_deck,
)


def build_decks(games: DataFrame) -> DataFrame:
    """(game_id, card_id, id): 108 cards per game, generated without a join."""
    return (
        games.select("game_id", F.explode(F.sequence(F.lit(0), F.lit(DECK_SIZE - 1))).alias("n"))
        .selectExpr(
            "game_id",
            f"cast({card_key('game_id', 'n')} as bigint) AS card_id",
            f"cast({nth_card_id('n')} as int) AS id",
        )
    )


def initial_deal(seats: DataFrame, seed: int) -> DataFrame:
    """Ten distinct cards of a new deck for each (game_id, username, seat).

    The seats of a game (no more than a deck has hands) meet in one row; its
    deck is then ordered once, inside the row, and cut into hands. The only
    shuffle is that of the seats. A seat the deck has no hand for gets one row
    without a card.
    """
    unserved = seats.filter(F.col("seat") > DECK_SIZE // HAND_SIZE).select(
        "game_id", "username", F.lit(None).cast("bigint").alias("card_id")
    )
    games = (
        seats.filter(F.col("seat") <= DECK_SIZE // HAND_SIZE)
        .groupBy("game_id")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("seat").cast("int"), "username"))).alias("names"))
    )
    return (
        games.select("game_id", "names", F.posexplode(shuffled_deck("game_id", seed)).alias("pos", "card_id"))
        .select(
            "game_id",
            F.try_element_at("names", (F.floor(F.col("pos") / HAND_SIZE) + 1).cast("int")).alias("username"),
            F.col("card_id").cast("bigint").alias("card_id"),
        )
        .filter(F.col("username").isNotNull())
        .unionByName(unserved)
    )


def sample(decks: DataFrame, k: int, seed: int | str) -> DataFrame:
    """Seeded random k of each game's cards, numbered 1..k.

    The rank filter is pushed below the shuffle (window group limit).
    """
    order = W.partitionBy("game_id").orderBy("_h", "card_id")
    return (
        decks.withColumn("_h", seeded_hash("card_id", seed))
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= k)
        .drop("_h")
    )


def pick(decks: DataFrame, seed: int | str, by: str = "game_id") -> DataFrame:
    """Seeded random single card per game, or other key: one hash aggregate, no sort of the deck."""
    return decks.groupBy(by).agg(F.min_by("card_id", seeded_rank("card_id", seed)).alias("card_id"))


def hand_slots(players: DataFrame) -> DataFrame:
    """Ten empty places per player, numbered through the table as `rn`."""
    table = W.partitionBy("game_id").orderBy("username")
    return (
        players.select("game_id", "username", F.row_number().over(table).alias("_seat"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(HAND_SIZE))).alias("slot_no"))
        .select(
            "game_id", "username", "slot_no", ((F.col("_seat") - 1) * HAND_SIZE + F.col("slot_no")).alias("rn")
        )
    )


def redeal_hands(
    players: DataFrame, decks: DataFrame, games: DataFrame, seed: int | str
) -> DataFrame:
    """Fresh (card_id, username, game_id) for all seats of `games`.

    `games` is (game_id, card_on_table); the table card is left out. Cards and
    slots are numbered per game and paired on the number; a slot beyond the
    deck has no card.
    """
    pool = decks.join(games.select("game_id", "card_on_table"), "game_id").filter(
        F.col("card_on_table").isNull() | (F.col("card_id") != F.col("card_on_table"))
    )
    cards = sample(pool.select("game_id", "card_id"), DECK_SIZE, seed)
    slots = hand_slots(players.join(games.select("game_id"), "game_id", "left_semi"))
    return slots.join(cards, ["game_id", "rn"], "left").select("card_id", "username", "game_id")


def redeal(state: Mapping[str, DataFrame], games: DataFrame, seed: int | str) -> dict[str, DataFrame]:
    """State with the hands of `games` (game_id) replaced; other games keep theirs.

    Slots the deck cannot fill stay out of the hands; `redeal_hands` shows them.
    """
    target = cut(state["games"].join(games.select("game_id").distinct(), "game_id", "left_semi"))
    fresh = redeal_hands(state["players"], state["decks"], target, seed).filter(F.col("card_id").isNotNull())
    owners = state["players"].join(target.select("game_id"), "game_id", "left_semi").select("username")
    out = dict(state)
    out["hands"] = append(apply_deletes(state["hands"], owners, "username"), fresh)
    return out
