"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(column: str) -> Column:
    """Length in bytes, which is what the minimum-length checks count."""
    return F.octet_length(column)


def minutes_between(earlier: str, later: Column) -> Column:
    """Whole elapsed minutes, truncated."""
    return F.timestamp_diff("MINUTE", F.col(earlier), later).cast("bigint")


def recent(column: str, as_of: Column, hours: int = 6) -> Column:
    """Active within the last `hours`; a stamp in the future passes too."""
    return as_of - F.col(column) <= F.expr(f"INTERVAL '{hours}' HOUR")


def phase_points(phase: str) -> Column:
    return 2 * F.col(phase) - 1


def normal_login(column: str) -> Column:
    return F.lower(column)


def card_label(rank: str) -> Column:
    r = F.col(rank)
    return (
        F.when(r < 13, r.cast("string"))
        .when(r == 13, F.lit("★"))
        .when(r == 14, F.lit("Skip"))
        .when(r == 15, F.lit("Deck"))
    )


def seeded_hash(column: str, seed: int | str) -> Column:
    """Repeatable stand-in for a random sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def seeded_rank(column: str, seed: int | str) -> Column:
    """The order of `seeded_hash`, NULL first, as a number of its first 120 bits.

    An aggregate keeps numbers in its hash table; for the text it sorts all rows.
    """
    digest = seeded_hash(column, seed)
    high, low = (F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(19,0)") for at in (1, 16))
    return F.coalesce(high * F.lit(1 << 60) + low, F.lit(-1))


def fingerprint(columns: Sequence[str]) -> Column:
    """md5 of a row; each value goes in behind its byte length, so different rows differ before hashing."""
    parts = []
    for c in columns:
        value = F.col(c).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value), F.lit("="), value)))
    return F.md5(F.concat_ws("|", *parts))


def first_match(rules: Sequence[tuple[Column, str, str]], default: tuple[str, str]) -> list[Column]:
    """Ladder of guards: the first one that holds names status and message."""
    code = text = None
    for condition, c, t in rules:
        code = F.when(condition, c) if code is None else code.when(condition, c)
        text = F.when(condition, t) if text is None else text.when(condition, t)
    return [code.otherwise(default[0]).alias("status_code"), text.otherwise(default[1]).alias("message")]
