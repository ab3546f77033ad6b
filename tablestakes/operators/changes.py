"""Table changes as set operations: every function returns the changed table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestakes.operators.joins import anti


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def apply_updates(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Set `columns` from `changes` (one row per key); a new NULL counts."""
    new = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )


def apply_increment(table: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """column = column + the sum of `delta`; deltas are summed map-side first."""
    total = deltas.groupBy(key).agg(F.sum("delta").alias("_delta"))
    kind = table.schema[column].dataType
    return table.join(total, key, "left").select(
        *[
            (F.col(c) + F.coalesce("_delta", F.lit(0))).cast(kind).alias(c) if c == column else F.col(c)
            for c in table.columns
        ]
    )


def apply_deletes(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return anti(table, keys, [key]).select(*table.columns)


def serialise(
    requests: DataFrame, game: str = "game_id", order: Sequence[str] = ("ts", "request_id")
) -> DataFrame:
    """Adds `admitted`: the first request of each game in the batch.

    The winner per game is an aggregate (map-side combine), joined back on the
    unique request id, so a game with a third of all requests is no hot spot.
    """
    first = (
        requests.filter(F.col(game).isNotNull())
        .groupBy(game)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select("_first.request_id", F.lit(True).alias("_admitted"))
    )
    return (
        requests.join(first, "request_id", "left")
        .withColumn("admitted", F.coalesce("_admitted", F.lit(False)))
        .drop("_admitted")
    )


def teardown(state: Mapping[str, DataFrame], dead: DataFrame) -> dict[str, DataFrame]:
    """Remove everything of the games in `dead` (game_id), one anti join per table."""
    dead = dead.select("game_id").distinct()
    gone_players = state["players"].join(dead, "game_id", "left_semi").select("username")
    gone_cards = state["decks"].join(dead, "game_id", "left_semi").select("card_id")
    out = dict(state)
    out["hands"] = apply_deletes(state["hands"], gone_players, "username")
    out["turns"] = apply_deletes(
        state["turns"], gone_players.withColumnRenamed("username", "current_player"), "current_player"
    )
    out["players"] = apply_deletes(state["players"], dead, "game_id")
    out["games"] = apply_deletes(state["games"], dead, "game_id")
    out["decks"] = apply_deletes(state["decks"], dead, "game_id")
    out["cards"] = apply_deletes(state["cards"], gone_cards, "card_id")
    return out
