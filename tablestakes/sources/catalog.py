"""The card catalogue and the phase rules: the only constant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECK_SIZE = 108
HAND_SIZE = 10
MIN_SEATS, MAX_SEATS = 2, 6
WILD, SKIP = 13, 14
LAST_PHASE = 10
MAX_CLAIM = 9  # longest list of cards any phase asks for

# Colors of ordinary cards in catalogue order, then the special one.
COLORS = ["green", "yellow", "red", "purple"]
SPECIAL_COLOR = "blue"

# Phase -> (kind of block, block lengths, is the turn checked).
PHASES = {
    1: ("set", [3, 3], True),
    2: ("run", [5], False),
    3: ("color", [5], False),
    4: ("run", [7], True),
    5: ("run", [8], True),
    6: ("set", [4, 4], True),
    7: ("run", [9], True),
    8: ("color", [7], False),
    9: ("set", [3, 3, 3], True),
    10: ("set", [2, 2, 2, 2], True),
}

# Refusal texts. Some name another card than the one that failed;
# clients match on the text, so they stay as they are.
STARTS_WITH = "Combination starts with card from 1 to 12, not jocker"
STATS_FOR = "Combination stats for 1 to 12, not jocker"
NOT_BLUE = "Combination starts not from blue card"
WRONG_CARDS = "Something wrong with your cards"
ACCEPTED = "You get points!"
TROUBLES = "Troubles with {} card"

# Phase -> refusal by position; a plain word goes into TROUBLES.
REFUSALS = {
    1: [STARTS_WITH, "second", "third", STATS_FOR, "fifth", "fifth"],
    2: [STATS_FOR, "second", "third", "fourth", "fifth"],
    3: [NOT_BLUE, "second", "third", "fourth", "fifth"],
    4: [STATS_FOR, "second", "third", "fourth", "fifth", "sixth", "seventh"],
    5: [STATS_FOR, "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"],
    6: [STARTS_WITH, "second", "third", "fourth", STATS_FOR, "fifth", "fifth", "fifth"],
    7: [STATS_FOR, "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "eighth"],
    8: [NOT_BLUE, "second", "third", "fourth", "fifth", "sixth", "seventh"],
    9: [STARTS_WITH, "second", "third", STATS_FOR, "fifth", "fifth", STATS_FOR, "fifth", "fifth"],
    10: [STARTS_WITH, "second", STARTS_WITH, "fourth", STARTS_WITH, "sixth", STARTS_WITH, "fourth"],
}


def claim_size(phase: int) -> int:
    return sum(PHASES[phase][1])


def refusal(phase: int, pos: int) -> str:
    text = REFUSALS[phase][pos - 1]
    return TROUBLES.format(text) if " " not in text else text


def rule_rows() -> list[tuple]:
    """(phase, pos, n, block_no, block_start, kind, step, message, check_turn)"""
    rows = []
    for phase, (kind, lengths, check_turn) in PHASES.items():
        pos = 1
        for block_no, length in enumerate(lengths, start=1):
            start = pos
            for pos in range(start, start + length):
                step = pos - start if kind == "run" else 0
                rows.append(
                    (phase, pos, sum(lengths), block_no, start, kind, step, refusal(phase, pos), check_turn)
                )
            pos += 1
    return rows


RULE_COLUMNS = (
    "phase INT, pos INT, n INT, block_no INT, block_start INT, kind STRING, step INT, "
    "message STRING, check_turn BOOLEAN"
)


def phase_rules(spark: SparkSession) -> DataFrame:
    """One row per phase and position (72 rows, so safe to broadcast)."""
    return spark.createDataFrame(rule_rows(), RULE_COLUMNS)


def nth_card_id(n: str) -> str:
    """SQL text: catalogue id of the n-th card, n = 0..107."""
    return (
        f"(CASE WHEN {n} < 96 THEN 10 * ({n} div 2 + 1) + {n} % 2 "
        f"WHEN {n} < 104 THEN 490 + {n} - 96 ELSE 530 + {n} - 104 END)"
    )


def card_catalog(spark: SparkSession) -> DataFrame:
    """The 108 cards of one deck as (id, color, rank)."""
    face = "(id div 10 - 1)"
    colors = ", ".join(f"'{c}'" for c in COLORS)
    return spark.range(DECK_SIZE, numPartitions=1).selectExpr(
        f"cast({nth_card_id('id')} as int) AS id"
    ).selectExpr(
        "id",
        f"CASE WHEN id >= 490 THEN '{SPECIAL_COLOR}' "
        f"ELSE element_at(array({colors}), cast({face} % 4 + 1 as int)) END AS color",
        f"cast(CASE WHEN id >= 530 THEN {SKIP} WHEN id >= 490 THEN {WILD} "
        f"ELSE {face} div 4 + 1 END as int) AS rank",
    )


def card_key(game_id: str, n: str) -> str:
    """SQL text: id of the n-th physical card of a game."""
    return f"({game_id} * 1000 + {nth_card_id(n)})"


def shuffled_deck(game_id: str, seed: int) -> Column:
    """Array of a new deck's 108 card ids in seeded order.

    Row-local on purpose: a deck is generated from its game id, so dealing it
    needs neither a shuffle nor a window. 108 elements is the fixed deck size.
    """
    key = f"({game_id} * 1000 + id)"
    types = f"transform(sequence(0, {DECK_SIZE - 1}), n -> {nth_card_id('n')})"
    return F.expr(
        f"transform(sort_array(transform({types}, id -> named_struct("
        f"'h', md5(concat('{seed}:', cast({key} as string))), 'card_id', {key}))), c -> c.card_id)"
    )
