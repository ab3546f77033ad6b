"""Write-back of game tables: a batch rewrites only the buckets of the games it touched.

Every row lies in a folder of its game's bucket (accounts: of their name's), so all rows of
a game move together. A batch replaces whole buckets by dynamic partition overwrite; other
folders are not opened. Each rewritten bucket also holds one row that is not live, so that
a bucket whose games are gone is replaced too.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestakes.session import cut
from tablestakes.sources.schema import GAME_TABLES

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def placed(state: Mapping[str, DataFrame], buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """The tables with the `bucket` of each row. Cards follow their deck, a turn its player."""
    decks = state["decks"].select("card_id", "game_id")
    players = state["players"].select(F.col("username").alias("current_player"), "game_id")
    keyed = {
        **{t: state[t] for t in ("games", "players", "decks")},
        **{t: state[t].join(decks, "card_id", "left") for t in ("cards", "hands")},
        "turns": state["turns"].join(players, "current_player", "left"),
    }
    found = {t: df.withColumn("bucket", bucket_of("game_id", buckets)).select("bucket", *state[t].columns) for t, df in keyed.items()}
    found["users"] = state["users"].withColumn("bucket", bucket_of("username", buckets)).select("bucket", *state["users"].columns)
    found["card_type"] = state["card_type"].withColumn("bucket", F.lit(0))
    return found


def _held(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """The `rows` (with bucket) of the `touched` buckets, written apart, as they may be read from what is replaced."""
    live = rows.join(F.broadcast(touched), "bucket", "left_semi").withColumn("live", F.lit(True))
    return cut(live.unionByName(touched.withColumn("live", F.lit(False)), allowMissingColumns=True).repartition("bucket"))


def _replace(held: DataFrame, path: str) -> None:
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_back(
    spark: SparkSession, root: str, state: Mapping[str, DataFrame], games: DataFrame | None = None,
    users: DataFrame | None = None, buckets: int = BUCKETS,
) -> None:
    """Write what a batch left of `games` (game_id) and `users` (username); everything without them.

    `games` names the games before and after the batch, the removed ones included. The
    list of touched buckets is broadcast; it has at most `buckets` rows.
    """
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    of_games = every if games is None else games.select(bucket_of("game_id", buckets).alias("bucket")).distinct()
    of_users = every if users is None and games is None else None if users is None else users.select(bucket_of("username", buckets).alias("bucket")).distinct()
    rows = placed(state, buckets)
    # All tables are read before one is replaced: a card is placed by its deck, a turn by its player.
    ready = {t: _held(rows[t], of_users if t == "users" else of_games) for t in rows if t != "card_type" and not (t == "users" and of_users is None)}
    for name, df in ready.items():
        _replace(df, f"{root}/{name}")
    if games is None:
        _replace(_held(rows["card_type"], every.where("bucket = 0")), f"{root}/card_type")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables as written last."""
    return {
        name: spark.read.schema(f"{ddl.replace(' NOT NULL', '')}, live BOOLEAN, bucket INT").parquet(f"{root}/{name}").where("live").drop("live", "bucket")
        for name, ddl in GAME_TABLES.items()
    }
