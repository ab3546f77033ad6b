"""Game tables derived from the star-schema inputs.

The library works on any tables with the schemas in `schema.GAME_TABLES`.
These views let every operator run on the whole of the given inputs:
customers sit at tables of up to five, events are their requests, order lines
are the cards of claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.operators.joins import times, unpacked
from tablestakes.operators.numbering import numbered_in_blocks
from tablestakes.sources.catalog import (
    COLORS, DECK_SIZE, HAND_SIZE, PHASES, card_catalog, card_key, claim_size, nth_card_id,
)
from tablestakes.sources.schema import load

SEED = 7
AS_OF = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def as_of():
    return F.expr(AS_OF)


def laid_card(pos: str) -> str:
    """SQL text: the card at a place of a game's deck as it lies in these views.

    A fixed permutation (29 and 108 share no factor), so the views stay plain
    arithmetic; seeded dealing is the library's business.
    """
    return f"cast({card_key('game_id', f'((29 * ({pos}) + 17 * game_id) % {DECK_SIZE})')} as bigint)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(load(spark, sf_dir, "customer"))


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers sit five to a table, in key order."""
    table = W.partitionBy("game_id")
    return (
        _customers(spark, sf_dir)
        .selectExpr(
            "concat('u', c_custkey) AS username", "c_custkey", "c_custkey div 5 AS game_id",
            "abs(cast(floor(c_acctbal) as int)) % 100 AS points",
        )
        .withColumn("seat", F.row_number().over(table.orderBy("c_custkey")))
        .withColumn("seats", F.count("*").over(table).cast("int"))
        .withColumn("waiting", F.expr("game_id % 4 = 0"))
        .withColumn("on_turn", F.expr("game_id % 4 <> 0 AND game_id % 11 <> 10 AND seat = game_id % seats + 1"))
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.partitionBy("game_id").orderBy("seat")
    last = F.last("username").over(table.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return seats(spark, sf_dir).select(
        "username",
        "points",
        F.coalesce(F.lag("username").over(table), F.when(~F.col("waiting"), last)).alias("next_player"),
        "game_id",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seats(spark, sf_dir).filter("on_turn").select(F.col("username").alias("current_player"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _customers(spark, sf_dir)
        .selectExpr("c_custkey div 5 AS game_id")
        .distinct()
        .select(
            "game_id",
            F.expr(f"CASE WHEN game_id % 4 <> 0 THEN {laid_card('60')} END AS card_on_table"),
            F.expr("cast(CASE WHEN game_id % 4 = 0 THEN 1 ELSE 1 + game_id % 11 END as int)").alias("game_phase"),
        )
    )


def _deck_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, n): the 108 places of every game's deck.

    The games lie in as many partitions as the session's shuffles have. Left to itself,
    adaptive execution makes one task of these few small rows, and that task all decks.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    game_ids = _customers(spark, sf_dir).selectExpr("c_custkey div 5 AS game_id")
    return times(game_ids.repartition(parts, "game_id").distinct(), DECK_SIZE, "n")


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deck_places(spark, sf_dir).select(
        F.expr(f"cast({card_key('game_id', 'n')} as bigint)").alias("card_id"), "game_id"
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deck_places(spark, sf_dir).selectExpr(
        f"cast({card_key('game_id', 'n')} as bigint) AS card_id", f"cast({nth_card_id('n')} as int) AS id"
    )


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten cards a seat; whoever is on turn may hold eleven (took) or nine (placed)."""
    held = times(seats(spark, sf_dir), HAND_SIZE + 1, "k").filter(
        F.expr(
            f"CASE WHEN on_turn AND game_id % 4 = 1 THEN true "
            f"WHEN on_turn AND game_id % 4 = 2 THEN k < {HAND_SIZE - 1} ELSE k < {HAND_SIZE} END"
        )
    )
    place = f"CASE WHEN k < {HAND_SIZE} THEN (seat - 1) * {HAND_SIZE} + k ELSE 61 END"
    return held.select(F.expr(laid_card(f"({place})")).alias("card_id"), "username")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers have accounts; activity is the latest event. Suppliers have no seat."""
    seen = (
        load(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(F.max("ts").alias("seen"))
    )
    seatless = load(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey) AS username", "md5(concat('pw:s', s_suppkey)) AS u_password",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS activity", "2 + s_nationkey % 5 AS p_count",
    )
    return (
        _customers(spark, sf_dir)
        .join(seen, "c_custkey", "left")
        .selectExpr(
            "concat('u', c_custkey) AS username",
            "md5(concat('pw:u', c_custkey)) AS u_password",
            "coalesce(seen, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS activity",
            "2 + c_nationkey % 5 AS p_count",
        )
        .unionByName(seatless)
    )


# Fixed mapping of event types to kinds of request.
REQUEST_KINDS = {"view": "take", "click": "place", "signup": "list", "purchase": "claim", "error": "leave"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; small values stand for a mistyped password."""
    kind = F.create_map(*[F.lit(x) for pair in REQUEST_KINDS.items() for x in pair])[F.col("event_type")]
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.expr("concat('u', user_id)").alias("login"),
        F.expr("CASE WHEN value < 1 THEN 'wrong' ELSE md5(concat('pw:u', user_id)) END").alias("pw"),
        kind.alias("kind"),
        F.expr("CASE WHEN value < 25 THEN 'deck' ELSE 'table' END").alias("source"),
        F.expr("cast(event_id % 11 as int)").alias("number"),
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand moves: take +1, place -1; a claim deals a fresh hand."""
    return load(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) AS username", "ts", "event_id",
        "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS delta",
        "event_type = 'purchase' AS fresh",
    )


def claim_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cards of every order, numbered; `cut_claims` makes claims of them.

    An order of many lines is numbered in blocks of them, not in one task.
    """
    order = ["l_linenumber", "id", "l_suppkey", "l_extendedprice", "l_shipdate"]
    colors = ", ".join(f"'{c}'" for c in COLORS)
    lines = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS attempt_id", "l_partkey AS id", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_shipdate", "cast(l_quantity as int) AS qty",
    )
    block = F.greatest(F.expr("l_linenumber div 1000"), F.lit(0))
    return (
        numbered_in_blocks(lines, ["attempt_id"], order, block, "pos")
        .withColumn("pos", F.col("pos").cast("int"))
        .withColumn(
            "rank",
            F.expr("cast(CASE WHEN qty % 5 = 0 THEN 13 WHEN qty = 49 THEN 14 ELSE 1 + id % 3 END as int)"),
        )
        .select(
            "attempt_id",
            "pos",
            "id",
            "rank",
            F.expr(
                f"CASE WHEN rank >= 13 THEN 'blue' "
                f"ELSE element_at(array({colors}), cast(l_suppkey % 4 + 1 as int)) END"
            ).alias("color"),
        )
    )


def cut_claims(cards: DataFrame, phase: str) -> DataFrame:
    """Consecutive claims of as many cards as the phase asks for: every card is in exactly one.

    A claim is named `<order>-<number>`; the last one of an order may be short, and is refused.
    """
    sizes = F.create_map(*[F.lit(x) for p in PHASES for x in (p, claim_size(p))])
    return (
        cards.withColumn("phase", F.expr(phase).cast("int"))
        .withColumn("n", sizes[F.col("phase")])
        .select(
            F.concat_ws("-", "attempt_id", F.expr("(pos - 1) div n")).alias("attempt_id"),
            "phase",
            F.expr("cast((pos - 1) % n + 1 as int)").alias("pos"),
            "id",
            "rank",
            "color",
        )
    )


def state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All eight game tables."""
    return {
        "users": users(spark, sf_dir),
        "players": players(spark, sf_dir),
        "card_type": card_catalog(spark),
        "cards": cards(spark, sf_dir),
        "turns": turns(spark, sf_dir),
        "hands": hands(spark, sf_dir),
        "games": games(spark, sf_dir),
        "decks": decks(spark, sf_dir),
    }
