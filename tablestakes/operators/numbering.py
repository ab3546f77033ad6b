"""Order-dependent operators that never put a heavy key, or all rows, in one task.

A plain running window sends a whole key to one task. Here the rows of a heavy
key are cut along the order into slices (a second, a block of ids); each slice
runs its own small window, slice totals are pre-aggregated map-side, and the
value carried into each slice is joined back. Light keys are not sliced and
carry nothing. `slice_by` must not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.operators.joins import HOT_ROWS, hot_keys
from tablestakes.session import cut


def time_slice(ts: str) -> Column:
    """Seconds since 1970: the usual slice for rows ordered by time."""
    return F.expr(
        f"datediff(cast({ts} as date), date'1970-01-01') * 86400L"
        f" + hour({ts}) * 3600 + minute({ts}) * 60 + cast(floor(second({ts})) as int)"
    )


def id_slice(column: str, rows: int = 1 << 20) -> Column:
    """Blocks of a unique id; a block never holds more than `rows` rows."""
    return F.floor(F.col(column) / F.lit(rows))


def with_slices(df: DataFrame, by: Sequence[str], slice_by: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds `_slice`: `slice_by` for keys of `hot_rows` rows and more, else NULL.

    Without a key everything is one group and always sliced.
    """
    if not by:
        return df.withColumn("_slice", slice_by.cast("bigint"))
    hot = F.broadcast(hot_keys(df, by, hot_rows, nulls=True).withColumnsRenamed({k: f"_hot_{k}" for k in by}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in by])
    fine = F.when(F.col("_hot").isNotNull(), slice_by.cast("bigint"))
    return df.join(hot, same, "left").withColumn("_slice", fine).select(*df.columns, "_slice")


def _same_slice(by: Sequence[str]) -> Column:
    """Rows of a slice with what is carried into it; a NULL key is a key like others."""
    keys = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by]
    return reduce(lambda a, b: a & b, keys, F.col("_slice") == F.col("_at"))


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    delta: Column,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact running sum of `delta` along `order` inside each `by` group."""
    by = list(by)
    sliced = with_slices(df, by, slice_by, hot_rows).withColumn("_delta", delta)
    totals = sliced.filter("_slice IS NOT NULL").groupBy(*by, "_slice").agg(F.sum("_delta").alias("_total"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*by, F.col("_slice").alias("_at"), F.sum("_total").over(before).alias("_carried"))
    upto = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        sliced.withColumn("_local", F.sum("_delta").over(upto))
        .join(carried.withColumnsRenamed({k: f"_of_{k}" for k in by}), _same_slice(by), "left")
        .withColumn(out, F.coalesce(F.col("_carried"), F.lit(0)) + F.col("_local"))
        .select(*df.columns, out)
    )


def range_numbered(df: DataFrame, order: Sequence[str], out: str = "rank", start: int | Column = 1) -> DataFrame:
    """Dense table-wide numbers along `order`, which no two rows share.

    Spark samples borders and deals rows into ranges of equal size; each range is sorted
    and numbered by itself and written once, in order. A range's offset is the sum of the
    counts before it, so the only single step sees one count per range, whatever the keys
    look like.
    """
    first = start if isinstance(start, Column) else F.lit(start)
    # The id a row gets holds the range in its upper part and the place in the range below.
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ordered = counts.agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("c"))
    before = F.transform(
        "c", lambda x, i: F.struct(x["_part"].alias("_part"), F.aggregate(F.slice("c", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y["_n"]).alias("_before"))
    )
    offsets = ordered.select(F.inline(before))
    numbered_ = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per range
    return numbered_.select(*df.columns, (F.col("_before") + place + first).cast("bigint").alias(out))


def number_rows(df: DataFrame, order: Sequence[str], start: int | Column = 1, out: str = "seq") -> DataFrame:
    """Surrogate keys: dense numbers along a unique `order`, sparse and hashed ids included."""
    return range_numbered(df, order, out, start)


def numbered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    slice_by: Column | None = None,
) -> DataFrame:
    """1, 2, … inside each group. Groups without a fixed bound (more than a
    deck or a table's seats) need `slice_by`."""
    if slice_by is None:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return running_sum(df, by, order, slice_by, F.lit(1).cast("bigint"), out)


def numbered_in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, out: str = "rn") -> DataFrame:
    """1, 2, ... inside each group along `order`, long groups cut into blocks.

    `block` must not decrease along the order, and be 0 for all rows of usual groups:
    only groups that reach further are counted by block, so the rest pay nothing but the
    search for them. A group of any size is numbered by as many tasks as it has blocks.
    """
    by = list(by)
    cut_up = df.withColumn("_block", block.cast("bigint"))
    long = cut_up.filter("_block > 0").select(*by).distinct()
    totals = cut_up.join(long, by, "left_semi").groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*by, "_block", F.sum("_n").over(before).alias("_before"))
    place = F.row_number().over(W.partitionBy(*by, "_block").orderBy(*order))
    return (
        cut_up.withColumn("_place", place)
        .join(carried, [*by, "_block"], "left")
        .withColumn(out, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .select(*df.columns, out)
    )


def zip_join(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    order_a: Sequence[str],
    order_b: Sequence[str],
    slice_a: Column | None = None,
    slice_b: Column | None = None,
) -> DataFrame:
    """Pair the k-th row of `a` with the k-th row of `b` inside each group."""
    left = numbered(a, by, order_a, "rn", slice_a)
    right = numbered(b, by, order_b, "rn", slice_b)
    return left.join(right, [*by, "rn"], "inner")
