"""Fixed schemas: the eight game tables and the typed parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# DDL texts of the game tables. Keys are BIGINT where a busy site outgrows INT.
GAME_TABLES = {
    "users": (
        "username STRING NOT NULL, u_password STRING NOT NULL, "
        "activity TIMESTAMP_NTZ NOT NULL, p_count INT NOT NULL"
    ),
    "players": (
        "username STRING NOT NULL, points INT NOT NULL, next_player STRING, game_id BIGINT NOT NULL"
    ),
    "card_type": ("id INT NOT NULL, color STRING NOT NULL, rank INT NOT NULL"),
    "cards": ("card_id BIGINT NOT NULL, id INT NOT NULL"),
    "turns": ("current_player STRING NOT NULL"),
    "hands": ("card_id BIGINT NOT NULL, username STRING NOT NULL"),
    "games": ("game_id BIGINT NOT NULL, card_on_table BIGINT, game_phase INT NOT NULL"),
    "decks": ("card_id BIGINT NOT NULL, game_id BIGINT NOT NULL"),
}

PRIMARY_KEYS = {
    "users": ["username"],
    "players": ["username"],
    "card_type": ["id"],
    "cards": ["card_id"],
    "turns": ["current_player"],
    "hands": ["card_id"],
    "games": ["game_id"],
    "decks": ["card_id"],
}


def required(table: str) -> list[str]:
    """Columns of a game table that must not be null."""
    return [c.split()[0] for c in GAME_TABLES[table].split(", ") if c.endswith("NOT NULL")]


# child table, child column, parent table, parent column
FOREIGN_KEYS = [
    ("players", "username", "users", "username"),
    ("players", "next_player", "players", "username"),
    ("players", "game_id", "games", "game_id"),
    ("cards", "id", "card_type", "id"),
    ("turns", "current_player", "players", "username"),
    ("hands", "card_id", "cards", "card_id"),
    ("hands", "username", "users", "username"),
    ("games", "card_on_table", "cards", "card_id"),
    ("decks", "card_id", "cards", "card_id"),
    ("decks", "game_id", "games", "game_id"),
]

# Column widths in characters.
MAX_LENGTH = {"username": 30, "u_password": 30, "color": 10}

INPUTS = {
    "nation": ("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": ("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
    "pages": ("page_id BIGINT, url STRING, html STRING"),
    "conversations": ("conv_id BIGINT, turn BIGINT, role STRING, text STRING"),
}


def input_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Typed scan: no inference, so no footer is read before the plan runs."""
    return spark.read.schema(INPUTS[name]).parquet(input_path(sf_dir, name))
