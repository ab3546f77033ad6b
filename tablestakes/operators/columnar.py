"""Results turned into one JSON object of column arrays per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestakes.operators.joins import HOT_ROWS
from tablestakes.operators.numbering import running_sum

PIECE_ROWS = 4096


def columnar_json(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """{"column": [values…]} per group, values in `order`.

    For groups with a fixed bound (a table's seats, a player's hand): the
    rows of one group become one value. `columnar_pieces` takes groups of any size.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    grouped = df.groupBy(*by).agg(rows.alias("_rows"))
    return grouped.select(
        *by, F.to_json(F.struct(*[F.col(f"_rows.{c}").alias(c) for c in columns])).alias("result")
    )


def columnar_pieces(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    slice_by: Column,
    piece_rows: int = PIECE_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """{"column": [values…]} per numbered piece of a group: (by…, piece, n, result).

    For groups without a bound: rows are numbered along a unique `order`, heavy groups by
    slices (`slice_by` must not decrease along the order), and every `piece_rows` of them
    become one value, so no value and no task grows with its group. Pieces count from 1
    and are full but for the last; put in order they are the whole group. A NULL key is a
    group like others, an empty table has no piece.
    """
    numbered = running_sum(df, by, order, slice_by, F.lit(1).cast("bigint"), "_rn", hot_rows)
    piece = F.expr(f"(_rn - 1) div {int(piece_rows)} + 1").alias("piece")
    rows = F.sort_array(F.collect_list(F.struct("_rn", *columns)))
    grouped = numbered.groupBy(*by, piece).agg(F.count("*").alias("n"), rows.alias("_rows"))
    result = F.to_json(F.struct(*[F.col(f"_rows.{c}").alias(c) for c in columns]))
    return grouped.select(*by, "piece", "n", result.alias("result"))
