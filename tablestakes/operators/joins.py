"""Join shapes: natural, skew-safe lookup, semi, anti, NOT IN, fan-out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # a key below this many rows needs no splitting; also rows per salt
MAX_HOT = 4096  # at most this many keys are split; the rest take the plain join
PACKED = 32  # a byte of packed keys and names takes about so many in a join's table


def natural_join(*frames: DataFrame) -> DataFrame:
    """Equi-join on all common names, each kept once."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], "inner"), frames)


def hot_keys(facts: DataFrame, key: Sequence[str], hot_rows: int = HOT_ROWS, nulls: bool = False) -> DataFrame:
    """The heaviest keys, at most MAX_HOT, so the result is safe to broadcast.

    `_hot` says into how many parts of about `hot_rows` rows a key falls. Counted with
    map-side combine. A key outside the first MAX_HOT holds less than 1/MAX_HOT of all
    rows, so the plain join copes with it. Keys with a NULL count with `nulls` only.
    """
    known = F.lit(True) if nulls else reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return (
        facts.groupBy(*key)
        .agg(F.count("*").alias("_rows"))
        .filter((F.col("_rows") >= hot_rows) & known)
        .orderBy(F.desc("_rows"), *key)
        .limit(MAX_HOT)
        .select(*key, F.ceil(F.col("_rows") / hot_rows).alias("_hot"))
    )


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: Sequence[str],
    row_id: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join `facts` to `dim`, whose `key` is unique, however skewed facts are.

    Rows of a hot key spread by their `row_id` over as many buckets as it has
    millions of rows; only the dim rows of hot keys are copied, once per
    bucket. NULL keys match nothing and spread by row. Works for left, inner,
    left_semi, left_anti.
    Keys are counted on `counted` when given: the plain table `facts` was
    built from, so that its joins do not run a second time for the count.
    """
    key = list(key)
    hot = F.broadcast(hot_keys(facts if counted is None else counted, key, hot_rows))
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    row = F.xxhash64(row_id)
    salt = F.when(some_null, row).when(F.col("_hot") > 1, F.pmod(row, F.col("_hot"))).otherwise(F.lit(0))
    left = facts.join(hot, key, "left").withColumn("_salt", salt.cast("bigint"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_hot") - 1, F.lit(0)).cast("bigint"))
    right = dim.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.drop("_hot").join(right, [*key, "_salt"], how).drop("_salt")


def times(df: DataFrame, n: int, name: str) -> DataFrame:
    """Every row of `df` with 0 .. n-1 as `name`.

    A product with n broadcast numbers instead of an explode: the planner takes a generator
    for one row per row and broadcasts tables a hundred times larger than it believes. Of a
    product it knows the size. Rows stay where they are, so their partitioning does too.
    """
    numbers = df.sparkSession.range(n, numPartitions=1).select(F.col("id").cast("int").alias(name))
    return df.crossJoin(F.broadcast(numbers))


def unpacked(df: DataFrame) -> DataFrame:
    """`df` as it is, taken by the planner for PACKED times the size of its files.

    Parquet packs keys to a few bytes a row and the planner goes by the file, so it broadcasts
    tables of hundreds of MB through the driver. A product with one row, picked from a few
    numbers, is weighed by all of them; it is not broadcast, because adaptive execution would
    weigh it anew by what was sent. Tables whose shuffle turns out small are still broadcast.
    """
    one = df.sparkSession.range(PACKED // 4, numPartitions=1).filter("id = 0").select()
    return df.crossJoin(one.hint("shuffle_replicate_nl"))


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `df` with a partner. The key side is made distinct first (map-side
    combine), so a key repeated millions of times there weighs one row."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def not_in(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """`column NOT IN (SELECT listed_column …)` with SQL's NULL rules.

    A NULL in the list empties the result; a NULL on the left survives only an
    empty list. Written as one aggregate and an anti join: the planner's own
    null-aware form has to broadcast the list or fall to a nested loop.
    """
    values = listed.select(F.col(listed_column).alias(column))
    facts = values.agg(
        F.struct(
            F.count("*").alias("n"),
            F.count_if(F.col(column).isNull()).alias("nulls"),
        ).alias("facts")
    ).scalar()
    kept = df.withColumn("_list", facts)
    kept = kept.filter(
        (F.col("_list.nulls") == 0) & (F.col(column).isNotNull() | (F.col("_list.n") == 0))
    ).drop("_list")
    return anti(kept, values.filter(F.col(column).isNotNull()), [column])


def free_cards(decks: DataFrame, hands: DataFrame) -> DataFrame:
    """Cards of a deck in nobody's hand (card_id is never NULL in hands)."""
    return decks.join(hands.select("card_id"), "card_id", "left_anti")


def fanout_distinct(decks: DataFrame, hands: DataFrame) -> DataFrame:
    """DISTINCT over decks × hands less the held cards, without the product:
    the free cards if any hand exists, nothing otherwise."""
    return free_cards(decks, hands).filter(hands.limit(1).exists())

