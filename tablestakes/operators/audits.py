"""Constraint audits over whole tables: what a database would refuse row by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestakes.operators.joins import lookup
from tablestakes.session import cut
from tablestakes.sources.catalog import DECK_SIZE, HAND_SIZE


def pk_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def fk_orphans(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, row_id: str
) -> DataFrame:
    """Child rows whose non-null key has no parent. Hot keys of the child are split."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return lookup(child.filter(F.col(column).isNotNull()), keys, [column], row_id, "left_anti")


def fk_audit(tables: Mapping[str, DataFrame], relations: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(relation, key, n): keys of child rows that no parent has, and how many rows hold them.

    `relations` lists (child, column, parent, parent column). Child keys are counted
    map-side first, so of a table only one row per key and task is shuffled, and a key
    with a third of all rows weighs as much as any other.
    """
    found = []
    for child, column, parent, parent_column in relations:
        held = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
        known = tables[parent].select(F.col(parent_column).cast("string").alias("key"))
        name = f"{child}.{column} -> {parent}.{parent_column}"
        found.append(held.join(known, "key", "left_anti").select(F.lit(name).alias("relation"), "key", "n"))
    return union_all(found)


def ring_audit(players: DataFrame, running: DataFrame) -> DataFrame:
    """Broken seat rings of `running` games (game_id) as (game_id, rule, n).

    Every seat learns by pointer doubling the least name it meets within as many steps as
    its game has seats, and after how many steps it first meets it. A game is sound if
    all its seats meet one least seat, which meets itself again after as many steps:

    * pointer out of the game: seats whose next player is nobody's or another game's seat,
    * ring in parts: least names met, if more than one,
    * seat outside the ring: seats more than the rings of the least seats have steps; a
      least seat that never comes back has no ring.

    Each round joins a table with itself on the seat and is written, so plans do not grow.
    """
    seats = cut(players.join(running.select("game_id").distinct(), "game_id", "left_semi").select("username", "next_player", "game_id"))
    place = seats.select(F.col("username").alias("next_player"), F.col("game_id").alias("_game"))
    inside = seats.join(place, "next_player", "left").withColumn("_to", F.when(F.col("_game") == F.col("game_id"), F.col("next_player")))
    most = seats.groupBy("game_id").count().agg(F.max("count")).first()[0] or 0
    walk, reach = cut(inside.select("game_id", "username", "_to", F.col("username").alias("least"), F.lit(0).alias("steps"))), 1
    while reach < most:
        further = walk.select(
            F.col("username").alias("_to"), F.col("_to").alias("_then"), F.col("least").alias("_least"), (F.col("steps") + reach).alias("_steps")
        )
        nearer = F.col("_least").isNull() | (F.col("least") <= F.col("_least"))
        walk = cut(
            walk.join(further, "_to", "left").select(
                "game_id", "username", F.col("_then").alias("_to"),
                F.when(nearer, F.col("least")).otherwise(F.col("_least")).alias("least"),
                F.when(nearer, F.col("steps")).otherwise(F.col("_steps")).alias("steps"),
            )
        )
        reach *= 2
    out = inside.where("next_player IS NOT NULL AND _to IS NULL").groupBy("game_id").agg(F.count("*").alias("n"))
    # From the seat behind a least seat it takes one step less than around the ring.
    behind = inside.select(F.col("username").alias("least"), F.col("_to").alias("username")).where("username IS NOT NULL")
    around = walk.join(behind, ["least", "username"]).select("game_id", "least", (F.col("steps") + 1).alias("ring"))
    groups = walk.groupBy("game_id", "least").agg(F.count("*").alias("n")).join(around, ["game_id", "least"], "left")
    met = groups.groupBy("game_id").agg(
        F.count("*").alias("parts"), F.sum(F.col("n") - F.coalesce("ring", F.lit(0))).cast("bigint").alias("outside")
    )
    return union_all(
        [
            out.select("game_id", F.lit("pointer out of the game").alias("rule"), "n"),
            met.where("parts > 1").select("game_id", F.lit("ring in parts").alias("rule"), F.col("parts").alias("n")),
            met.where("outside > 0").select("game_id", F.lit("seat outside the ring").alias("rule"), F.col("outside").alias("n")),
        ]
    )


def count_by_rule(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """One pass over `df`: how many rows break each rule, as (table_name, rule, n)."""
    counted = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, n)").select(
        F.lit(table).alias("table_name"), "rule", "n"
    )


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return count_by_rule(df, table, {c: F.col(c).isNull() for c in columns})


def too_long(column: str, limit: int) -> Column:
    return F.char_length(column) > limit


def outside(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def game_invariants(state: Mapping[str, DataFrame]) -> DataFrame:
    """Broken rules of the game state as (game_id, rule, n)."""
    players, games = state["players"], state["games"]
    hand_size = state["hands"].groupBy("username").agg(F.count("*").alias("held"))
    hosts = state["users"].select("username", "p_count")
    lasts = players.select(F.col("next_player").alias("username"), F.lit(1).alias("pointed")).distinct()
    seated = (
        players.join(hand_size, "username", "left").join(hosts, "username", "left").join(lasts, "username", "left")
    )
    by_game = seated.groupBy("game_id").agg(
        F.count("*").alias("seats"),
        F.count_if(F.col("next_player").isNull()).alias("open_seats"),
        F.count_if(F.col("pointed").isNull()).alias("unpointed"),
        F.max(F.when(F.col("next_player").isNull(), F.col("p_count"))).alias("wanted"),
        F.count_if(~F.coalesce("held", F.lit(0)).between(HAND_SIZE - 1, HAND_SIZE + 1)).alias("bad_hands"),
    )
    deck = state["decks"].groupBy("game_id").agg(F.count("*").alias("deck_cards"))
    facts = games.join(by_game, "game_id", "left").join(deck, "game_id", "left")
    waiting = F.col("card_on_table").isNull()
    rules = {
        "waiting game without exactly one open seat": F.when(
            waiting & (F.coalesce("open_seats", F.lit(0)) != 1), F.coalesce("open_seats", F.lit(0))
        ),
        "running game with an open ring": F.when(
            ~waiting & (F.col("open_seats") + F.col("unpointed") > 0), F.col("open_seats") + F.col("unpointed")
        ),
        "more seats than wanted": F.when(F.col("seats") > F.col("wanted"), F.col("seats")),
        "deck without 108 cards": F.when(
            F.coalesce("deck_cards", F.lit(0)) != DECK_SIZE, F.coalesce("deck_cards", F.lit(0))
        ),
        "hand outside 9 to 11": F.when(F.col("bad_hands") > 0, F.col("bad_hands")),
    }
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    per_game = (
        facts.select("game_id", *[c.cast("bigint").alias(f"r{i}") for i, c in enumerate(rules.values())])
        .selectExpr("game_id", f"stack({len(rules)}, {pairs}) AS (rule, n)")
        .filter("n IS NOT NULL")
    )
    twice = (
        state["hands"].groupBy("card_id").agg(F.count("*").alias("places")).filter("places > 1")
        .join(state["decks"], "card_id")
        .groupBy("game_id")
        .agg(F.count("*").alias("n"))
        .select("game_id", F.lit("card in two hands").alias("rule"), "n")
    )
    on_table = games.filter(F.col("card_on_table").isNotNull()).select("game_id", F.col("card_on_table").alias("card_id"))
    out_of_turn = (
        state["hands"].join(on_table, "card_id")
        .join(state["turns"].select(F.col("current_player").alias("username")), "username", "left_anti")
        .groupBy("game_id")
        .agg(F.count("*").alias("n"))
        .select("game_id", F.lit("table card in a hand out of turn").alias("rule"), "n")
    )
    return per_game.unionByName(twice).unionByName(out_of_turn)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
