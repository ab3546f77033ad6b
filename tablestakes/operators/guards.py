"""Who may do what: account facts and the ladders of guards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestakes.functions.scalars import first_match
from tablestakes.operators.joins import lookup
from tablestakes.sources.catalog import LAST_PHASE, SKIP

# Texts by status.
MESSAGES = {
    "wrong_password": "Wrong password",
    "not_in_game": "Connect to game or create new first",
    "waiting": "Waiting for players",
    "game_over": "Game is over",
    "not_your_turn": "Error",
    "hand_full": "You can't take more cards",
    "deck_only": "You can take card from deck(1)",
    "bad_source": "Select deck(1) or table(2)",
    "wrong_card": "Wrong card id",
    "already_placed": "You already did this",
    "take_to_finish": "Call t_card to finish your turn",
    "place_to_finish": "Call p_card to finish your turn",
    "not_seated": "You are not in game now",
    "end_turn": "End your turn first",
    "left": "now you can find new game",
    "wrong_count": "Wrong number of players",
    "seated": "You are in game already",
    "wrong_game": "Wrong game_id, check list of games",
    "empty_lobby": "Create your own game",
    "taken_login": "Same login already exists",
    "short_login": "Login is too short",
    "short_password": "Password is too short",
    "registered": "Account created!",
    "started": "Game start!",
}
CLAIM_MESSAGES = {**MESSAGES, "not_your_turn": "Wait for your turn", "wrong_phase": "Sorry"}


def accounts(state: Mapping[str, DataFrame], table_rank: bool = False) -> DataFrame:
    """One row per user: password digest, seat, table and hand size.

    All inputs are unique on their join key, so these joins cannot skew;
    requests then need a single lookup. Tables of the whole state are merged: a
    broadcast of each, just below the planner's limit, would meet in the driver.
    """
    hand_size = state["hands"].groupBy("username").agg(F.count("*").alias("hand_size"))
    turn = state["turns"].select(F.col("current_player").alias("username"), F.lit(True).alias("_turn"))
    seated = state["players"].select("username", "next_player", "game_id").join(turn.hint("merge"), "username", "left")
    games = state["games"]
    if table_rank:
        faces = state["cards"].join(F.broadcast(state["card_type"]), "id").select(
            F.col("card_id").alias("card_on_table"), F.col("rank").alias("table_rank")
        )
        games = games.join(faces, "card_on_table", "left")
    tables = (
        seated.groupBy("game_id")
        .agg(
            F.count("*").alias("players_in_game"),
            F.max(F.when(F.col("_turn"), F.col("username"))).alias("current_player"),
        )
        .join(games.hint("merge"), "game_id", "left")
    )
    seats = (
        seated.drop("_turn").join(hand_size.hint("merge"), "username", "left")
        .join(tables.hint("merge"), "game_id", "left")
    )
    return (
        state["users"].select("username", "u_password").join(seats.hint("merge"), "username", "left")
        .withColumn("hand_size", F.coalesce("hand_size", F.lit(0)))
    )


def of_batch(state: Mapping[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """The rows of the game tables that a batch's logins can be judged by.

    Semi joins from the batch: its logins reduce accounts, seats and hands, the games of
    those seats reduce players and games, and their table cards the cards. A small batch
    is broadcast, so large tables are read once and nothing of them is shuffled.
    """
    logins = requests.select(F.col("login").alias("username")).distinct()
    own = state["players"].join(logins, "username", "left_semi")
    games = state["games"].join(own.select("game_id").distinct(), "game_id", "left_semi")
    tables = games.select(F.col("card_on_table").alias("card_id")).where("card_id IS NOT NULL").distinct()
    return {
        **state,
        "users": state["users"].join(logins, "username", "left_semi"),
        "hands": state["hands"].join(logins, "username", "left_semi"),
        "players": state["players"].join(own.select("game_id").distinct(), "game_id", "left_semi"),
        "games": games,
        "cards": state["cards"].join(tables, "card_id", "left_semi"),
    }


def account_guards(looked: DataFrame) -> DataFrame:
    """Adds `bad_password` and `on_turn` to requests joined to their account."""
    return looked.withColumn(
        "bad_password", F.col("u_password").isNull() | ~F.col("u_password").eqNullSafe(F.col("pw"))
    ).withColumn("on_turn", F.coalesce(F.col("current_player") == F.col("login"), F.lit(False)))


def with_account(
    state: Mapping[str, DataFrame],
    requests: DataFrame,
    table_rank: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    batch = requests if counted is None else counted
    facts = accounts(of_batch(state, batch), table_rank).withColumnRenamed("username", "login")
    return account_guards(lookup(requests, facts, ["login"], "request_id", counted=counted))


def entry_rules(messages: Mapping[str, str] = MESSAGES) -> list:
    """Guards every table action starts with, in order."""
    return [
        (F.col("bad_password"), "wrong_password", messages["wrong_password"]),
        (F.col("game_id").isNull(), "not_in_game", messages["not_in_game"]),
        (F.col("card_on_table").isNull(), "waiting", messages["waiting"]),
    ]


def turn_rules() -> list:
    return [
        *entry_rules(),
        (F.col("game_phase") > LAST_PHASE, "game_over", MESSAGES["game_over"]),
        (~F.col("on_turn"), "not_your_turn", MESSAGES["not_your_turn"]),
    ]


def take_rules() -> list:
    return [
        *turn_rules(),
        (F.col("hand_size") >= 11, "hand_full", MESSAGES["hand_full"]),
        (~F.col("source").isin("deck", "table") | F.col("source").isNull(), "bad_source", MESSAGES["bad_source"]),
        (
            (F.col("source") == "table") & ((F.col("hand_size") == 9) | (F.col("table_rank") == SKIP)),
            "deck_only",
            MESSAGES["deck_only"],
        ),
    ]


def place_rules() -> list:
    return [
        *turn_rules(),
        (F.coalesce(F.col("owner") != F.col("login"), F.lit(True)), "wrong_card", MESSAGES["wrong_card"]),
        (F.col("hand_size") <= 9, "already_placed", MESSAGES["already_placed"]),
    ]


def told(hints: Mapping[str, str] = {}) -> dict[str, Column]:
    """What a client is told beside the text of a refusal, by its status.

    How many players wait; who is on turn and which card lies on the table; the next
    thing to do (`hints`: status to key of MESSAGES).
    """
    code = F.col("status_code")
    hint = F.lit(None).cast("string")
    for status, key in hints.items():
        hint = F.when(code == status, MESSAGES[key]).otherwise(hint)
    return {
        "waiting_players": F.when(code == "waiting", F.col("players_in_game")),
        "turn_holder": F.when(code == "not_your_turn", F.col("current_player")),
        "table_card": F.when(code == "not_your_turn", F.col("card_on_table")),
        "hint": hint,
    }


def claim_rules() -> list:
    """Guards of a claim before its cards are looked at; `number` is the phase asked for."""
    return [
        *entry_rules(CLAIM_MESSAGES),
        (~F.col("on_turn"), "not_your_turn", CLAIM_MESSAGES["not_your_turn"]),
        (F.col("number") != F.col("game_phase"), "wrong_phase", CLAIM_MESSAGES["wrong_phase"]),
    ]


def guard(state: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Status of every request before its action: turn guards for take and
    place, claim guards for claims. `detail` is what clients show with it."""
    seen = with_account(state, requests)
    turn_code, turn_text = first_match(turn_rules(), ("ok", "ok"))
    claim_code, claim_text = first_match(claim_rules(), ("ok", "ok"))
    is_claim = F.col("kind") == "claim"
    return (
        seen.withColumn("status_code", F.when(is_claim, claim_code).otherwise(turn_code))
        .withColumn("message", F.when(is_claim, claim_text).otherwise(turn_text))
        .withColumn(
            "detail",
            F.when(F.col("status_code") == "waiting", F.col("players_in_game"))
            .when(F.col("status_code") == "wrong_phase", F.col("game_phase"))
            .when((F.col("status_code") == "not_your_turn") & ~is_claim, F.col("card_on_table"))
            .cast("bigint"),
        )
    )


def view_status(state: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """What a request to see one's game gets: a refusal, the number of players
    waiting, the final standings or the snapshot of `game_id`."""
    seen = with_account(state, requests).select(
        "request_id",
        "login",
        *first_match(
            [*entry_rules(), (F.col("game_phase") > LAST_PHASE, "game_over", MESSAGES["game_over"])], ("ok", "ok")
        ),
        "game_id",
        "players_in_game",
    )
    code = F.col("status_code")
    return seen.withColumn("game_id", F.when(code != "wrong_password", F.col("game_id"))).withColumn(
        "players_in_game", F.when(code == "waiting", F.col("players_in_game"))
    )
