"""Accounts, lobby, game creation and joining, snapshots and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestakes.functions.scalars import first_match, minutes_between, recent
from tablestakes.operators.changes import append, apply_deletes, apply_updates
from tablestakes.operators.deal import build_decks, initial_deal, pick, sample
from tablestakes.operators.guards import MESSAGES, account_guards
from tablestakes.operators.joins import free_cards, lookup
from tablestakes.operators.numbering import range_numbered
from tablestakes.session import cut
from tablestakes.sources.catalog import HAND_SIZE, LAST_PHASE, MAX_SEATS, MIN_SEATS

MIN_LENGTH = 2  # bytes, of login and password


def _first_per(requests: DataFrame, key: str, out: str) -> DataFrame:
    """Earliest (ts, request_id) per key, by map-side combine."""
    return requests.groupBy(key).agg(F.min(F.struct("ts", "request_id")).alias(out))


def register(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Status of sign-ups (request_id, ts, login, pw) as if served in (ts, request_id) order.

    A login is taken if it exists or if an earlier request of the batch got it.
    """
    long_enough = (F.octet_length("login") >= MIN_LENGTH) & (F.octet_length("pw") >= MIN_LENGTH)
    winners = _first_per(requests.filter(long_enough), "login", "_won")
    known = users.select(F.col("username").alias("login"), F.lit(True).alias("_exists"))
    logins = (
        known.withColumn("_won", F.lit(None).cast(winners.schema["_won"].dataType))
        .unionByName(winners.withColumn("_exists", F.lit(None).cast("boolean")))
        .groupBy("login")
        .agg(F.max("_exists").alias("_exists"), F.max("_won").alias("_won"))
    )
    taken = F.coalesce("_exists", F.lit(False)) | F.coalesce(
        F.col("_won") < F.struct("ts", "request_id"), F.lit(False)
    )
    return lookup(requests, logins, ["login"], "request_id").select(
        "request_id",
        "login",
        *first_match(
            [
                (taken, "taken_login", MESSAGES["taken_login"]),
                (F.coalesce(F.octet_length("login"), F.lit(0)) < MIN_LENGTH, "short_login", MESSAGES["short_login"]),
                (F.coalesce(F.octet_length("pw"), F.lit(0)) < MIN_LENGTH, "short_password", MESSAGES["short_password"]),
            ],
            ("ok", MESSAGES["registered"]),
        ),
    )


def register_users(
    state: Mapping[str, DataFrame], requests: DataFrame, as_of: Column, digest: Column
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sign-ups carried out. `digest` turns a request's pw into what is stored."""
    status = cut(register(state["users"], requests))
    new = requests.join(status.filter("status_code = 'ok'").select("request_id"), "request_id", "left_semi").select(
        F.col("login").alias("username"), digest.alias("u_password"), as_of.alias("activity"), F.lit(2).alias("p_count")
    )
    return status, {**state, "users": append(state["users"], new)}


def open_games(state: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """Waiting games with an open seat whose holder was lately active."""
    seats = state["players"].filter(F.col("next_player").isNull()).select("username", "game_id")
    return (
        state["users"].filter(recent("activity", as_of)).select("username", "activity")
        .join(seats, "username")
        .join(state["games"].filter(F.col("card_on_table").isNull()).select("game_id"), "game_id")
        .select("game_id", F.col("username").alias("created_by"), "activity",
                minutes_between("activity", as_of).alias("minutes_ago"))
    )


def lobby(state: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """The list of games with their rank, longest waiting first."""
    ranked = range_numbered(open_games(state, as_of), ["activity", "game_id"])
    return ranked.orderBy("rank").select("rank", "game_id", "created_by", "minutes_ago")


def _membership(state: Mapping[str, DataFrame]) -> DataFrame:
    return (
        state["users"].select(F.col("username").alias("login"), "u_password")
        .join(state["players"].select(F.col("username").alias("login"), "game_id"), "login", "left")
    )


def _checked(state: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Requests with bad_password and the login's present game, if any."""
    seen = lookup(requests, _membership(state).withColumnRenamed("game_id", "seated_in"), ["login"], "request_id")
    return seen.withColumn(
        "bad_password", F.col("u_password").isNull() | ~F.col("u_password").eqNullSafe(F.col("pw"))
    )


def route(state: Mapping[str, DataFrame], requests: DataFrame, as_of: Column) -> DataFrame:
    """Where a list-of-games request leads: own game, empty lobby or the list."""
    code, text = first_match(
        [
            (F.col("bad_password"), "wrong_password", MESSAGES["wrong_password"]),
            (F.col("seated_in").isNotNull(), "seated", MESSAGES["seated"]),
            (~open_games(state, as_of).exists(), "empty", MESSAGES["empty_lobby"]),
        ],
        ("list", "list"),
    )
    seen = _checked(state, requests).select("*", code, text)
    shown = F.when(F.col("status_code") == "seated", F.col("seated_in")).alias("game_id")
    return seen.select("request_id", "login", "status_code", "message", shown)


def _stamp(users: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """Restamp activity and p_count of (username, p_count)."""
    return apply_updates(users, done.withColumn("activity", as_of), "username", ["activity", "p_count"])


def create_games(
    state: Mapping[str, DataFrame], requests: DataFrame, as_of: Column, seed: int
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Create requests (request_id, ts, login, pw, pl_count, game_id).

    The request carries the id of the game to be made. A login makes one game
    per batch; its deck and the host's hand come with it.
    """
    judged = _checked(state, requests).select(
        "request_id", "ts", "login", "pl_count", "game_id",
        *first_match(
            [
                (F.col("bad_password"), "wrong_password", MESSAGES["wrong_password"]),
                (~F.coalesce(F.col("pl_count").between(MIN_SEATS, MAX_SEATS), F.lit(False)), "wrong_count",
                 MESSAGES["wrong_count"]),
                (F.col("seated_in").isNotNull(), "seated", MESSAGES["seated"]),
            ],
            ("ok", "ok"),
        ),
    )
    judged = cut(judged)
    first = _first_per(judged.filter("status_code = 'ok'"), "login", "_f").select("_f.request_id")
    won = F.col("_done").isNotNull()
    status = judged.join(first.withColumn("_done", F.lit(True)), "request_id", "left").select(
        "request_id",
        "login",
        F.when((F.col("status_code") == "ok") & ~won, "seated").otherwise(F.col("status_code")).alias("status_code"),
        F.when((F.col("status_code") == "ok") & ~won, MESSAGES["seated"]).otherwise(F.col("message")).alias("message"),
        F.when(won, F.col("game_id")).alias("game_id"),
    )
    made = judged.join(first, "request_id", "left_semi").select(
        "game_id", F.col("login").alias("username"), F.col("pl_count").alias("p_count")
    )
    deck = build_decks(made)
    out = dict(state)
    out["games"] = append(
        state["games"],
        made.select("game_id", F.lit(None).cast("bigint").alias("card_on_table"), F.lit(1).alias("game_phase")),
    )
    out["players"] = append(
        state["players"],
        made.select("username", F.lit(0).alias("points"), F.lit(None).cast("string").alias("next_player"), "game_id"),
    )
    out["cards"] = append(state["cards"], deck)
    out["decks"] = append(state["decks"], deck)
    out["turns"] = append(state["turns"], made.select(F.col("username").alias("current_player")))
    out["hands"] = append(state["hands"], initial_deal(made.withColumn("seat", F.lit(1)), seed))
    out["users"] = _stamp(state["users"], made.select("username", "p_count"), as_of)
    return status, out


def join_games(
    state: Mapping[str, DataFrame], requests: DataFrame, as_of: Column, seed: int | str
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Join requests (request_id, ts, login, pw, game_id), served in order.

    Free seats go to the first comers; a game that fills up starts: it gets a
    table card, its ring closes and the joiner before the last is on turn. Each
    login is served with its first sound request; if that finds the game full,
    its later ones are deferred to the next batch.
    A game asked for by millions costs as many rows per map task as a game has
    free seats at most, because the rank filter runs below the shuffle.
    `place` counts those who got a seat of a game in this batch; `info` tells who
    filled it up that the game starts.
    """
    waiting = state["games"].filter(F.col("card_on_table").isNull()).select("game_id")
    # Seats, rooms and turns follow from it: join the accounts once, and merge what grows with the tables.
    seats = cut(
        state["players"].join(waiting.hint("merge"), "game_id", "left_semi")
        .join(state["users"].select("username", F.col("p_count").alias("_wants")).hint("merge"), "username")
        .select("username", "next_player", "game_id", "_wants")
    )
    pointed = seats.filter(F.col("next_player").isNotNull()).select(F.col("next_player").alias("username"))
    last = seats.join(pointed.hint("merge"), "username", "left_anti").select("game_id", F.col("username").alias("last_in"))
    room = cut(
        seats.groupBy("game_id")
        .agg(
            F.count("*").alias("seats"),
            F.max(F.when(F.col("next_player").isNull(), F.col("_wants"))).alias("p_count"),
            F.max(F.when(F.col("next_player").isNull(), F.col("username"))).alias("host"),
        )
        .join(last.hint("merge"), "game_id")
    )
    tables = state["games"].select("game_id", F.lit(True).alias("_known")).join(room.hint("merge"), "game_id", "left")
    judged = lookup(_checked(state, requests), tables, ["game_id"], "request_id", counted=requests).select(
        "request_id", "ts", "login", "game_id", "seats", "p_count", "host", "last_in",
        *first_match(
            [
                (F.col("bad_password"), "wrong_password", MESSAGES["wrong_password"]),
                (F.col("_known").isNull(), "wrong_game", MESSAGES["wrong_game"]),
                (F.col("seated_in").isNotNull(), "seated", MESSAGES["seated"]),
                (F.coalesce(F.col("seats") >= F.col("p_count"), F.lit(True)), "full", MESSAGES["wrong_game"]),
            ],
            ("ok", "ok"),
        ),
    )
    judged = cut(judged)
    asked = judged.filter("status_code = 'ok'")
    one_each = _first_per(asked, "login", "_f").select("_f.request_id")
    queue = W.partitionBy("game_id").orderBy("ts", "request_id")
    most = room.agg(F.max(F.col("p_count") - F.col("seats"))).first()[0] or 0  # free seats of any game
    taken = cut(
        asked.join(one_each, "request_id", "left_semi")
        .withColumn("place", F.row_number().over(queue))
        .filter(F.col("place") <= most)
        .filter(F.col("place") <= F.col("p_count") - F.col("seats"))
        .select("request_id", "login", "game_id", "place", "seats", "p_count", "host", "last_in")
    )
    first = one_each.withColumn("_first", F.lit(True))
    starts = F.col("seats") + F.col("place") >= F.col("p_count")
    seated = taken.select("login", F.col("request_id").alias("_seat"), F.col("place").alias("_place"), starts.alias("_starts"))
    settled = lookup(judged.join(first, "request_id", "left"), seated, ["login"], "request_id", counted=judged)
    ok = F.col("status_code") == "ok"
    code, text = first_match(
        [
            (~ok | (F.col("_seat") == F.col("request_id")), F.col("status_code"), F.col("message")),
            (F.col("_seat").isNotNull(), F.lit("seated"), MESSAGES["seated"]),
            (F.col("_first"), F.lit("full"), MESSAGES["wrong_game"]),
        ],
        ("deferred", "ok"),
    )
    mine = F.col("_seat") == F.col("request_id")
    told = {"place": F.when(mine, F.col("_place")), "info": F.when(mine & F.col("_starts"), MESSAGES["started"])}
    status = settled.select("request_id", "login", "game_id", code, text, *[c.alias(n) for n, c in told.items()])
    by_place = W.partitionBy("game_id").orderBy("place")
    joined = taken.select(
        "*", F.coalesce(F.lag("login").over(by_place), F.col("last_in")).alias("next_player")
    )
    newest = joined.groupBy("game_id", "host", "seats", "p_count").agg(
        F.count("*").alias("_in"), F.max_by("login", "place").alias("newest"),
        F.max_by("next_player", "place").alias("before"),
    )
    full = newest.filter(F.col("seats") + F.col("_in") >= F.col("p_count"))
    pool = free_cards(state["decks"].join(newest.select("game_id"), "game_id", "left_semi"), state["hands"])
    dealt = sample(pool, most * HAND_SIZE, seed).withColumn(
        "place", (F.floor((F.col("rn") - 1) / HAND_SIZE) + 1).cast("int")
    )
    new_hands = dealt.join(joined.select("game_id", "place", "login"), ["game_id", "place"]).select(
        "card_id", F.col("login").alias("username")
    )
    out = dict(state)
    out["hands"] = append(state["hands"], new_hands)
    players = append(
        state["players"],
        joined.select(F.col("login").alias("username"), F.lit(0).alias("points"), "next_player", "game_id"),
    )
    out["players"] = apply_updates(
        players, full.select(F.col("host").alias("username"), F.col("newest").alias("next_player")), "username",
        ["next_player"],
    )
    free = free_cards(state["decks"].join(full.select("game_id"), "game_id", "left_semi"), out["hands"])
    out["games"] = apply_updates(
        state["games"], pick(free, seed).withColumnRenamed("card_id", "card_on_table"), "game_id", ["card_on_table"]
    )
    now = newest.select(
        F.when(F.col("seats") + F.col("_in") >= F.col("p_count"), F.col("before"))
        .otherwise(F.col("newest")).alias("current_player")
    )
    out["turns"] = append(
        apply_deletes(
            state["turns"],
            seats.join(newest.select("game_id"), "game_id", "left_semi").select(F.col("username").alias("current_player")),
            "current_player",
        ),
        now,
    )
    out["users"] = _stamp(state["users"], taken.select(F.col("login").alias("username"), "p_count"), as_of)
    return status, out


# Fixed value: third column of the current-player row, spelled as clients receive it.
PHASE_MARK = "plase"


def snapshot(state: Mapping[str, DataFrame]) -> DataFrame:
    """What the players of running games see.

    Hand rows belong to one `viewer`; table, current player and player rows are
    the same for all seats and appear once per game with no viewer, so the
    result grows with the seats, not with their square. The branches mix
    numbers and names, so all four value columns are text. Keys make the rows
    distinct already; no deduplicating shuffle is needed.
    """
    running = state["games"].filter(F.col("card_on_table").isNotNull())
    faces = state["cards"].join(F.broadcast(state["card_type"]), "id").select("card_id", "color", "rank")
    seated = state["players"].join(running.select("game_id", "game_phase"), "game_id")
    nobody = F.lit(None).cast("string").alias("viewer")

    def branch(df: DataFrame, viewer: Column, order: int, info: str, *values: Column) -> DataFrame:
        names = ("my_cards", "color", "rank")
        return df.select(
            "game_id", viewer, F.lit(order).alias("section_order"), F.lit(info).alias("info"),
            *[v.cast("string").alias(n) for v, n in zip(values, names)],
        )

    col = F.col
    hand = branch(
        state["hands"].join(faces, "card_id").join(seated.select("username", "game_id"), "username"),
        col("username").alias("viewer"), 1, "hand", col("card_id"), col("color"), col("rank"),
    )
    table = branch(
        running.join(faces, running["card_on_table"] == faces["card_id"]),
        nobody, 2, "table", col("card_on_table"), col("color"), col("rank"),
    )
    current = branch(
        seated.join(state["turns"].select(col("current_player").alias("username")), "username"),
        nobody, 3, "current player", col("username"), F.lit(PHASE_MARK), col("game_phase"),
    )
    inside = branch(seated, nobody, 4, "players in game", col("username"), col("points"), col("next_player"))
    return hand.unionByName(table).unionByName(current).unionByName(inside)


def standings(state: Mapping[str, DataFrame]) -> DataFrame:
    """Finished games: players by points, fewest first."""
    over = state["games"].filter(F.col("game_phase") > LAST_PHASE).select("game_id")
    place = F.rank().over(W.partitionBy("game_id").orderBy("points"))
    return state["players"].join(over, "game_id", "left_semi").select(
        "game_id", F.lit("Game is over").alias("info"), F.col("username").alias("players"), "points",
        place.cast("int").alias("place"),
    )


def progress(state: Mapping[str, DataFrame]) -> DataFrame:
    """Games per phase with the points their claims have given out so far:
    1 + 3 + … is a square, so a finished game has given exactly 100."""
    held = state["players"].groupBy("game_id").agg(F.sum("points").alias("_held"))
    return (
        state["games"].join(held, "game_id", "left")
        .groupBy("game_phase")
        .agg(
            F.count("*").alias("games"),
            F.sum((F.col("game_phase") - 1) * (F.col("game_phase") - 1)).cast("bigint").alias("points_given"),
            F.sum("_held").cast("bigint").alias("points_held"),
        )
    )


def players_shown(status: DataFrame, state: Mapping[str, DataFrame]) -> DataFrame:
    """What a request that got a seat is answered with: the players at its table.

    `status` and `state` are the results of `join_games`. One row per player and request,
    as if the requests were served one by one: who sat there before the batch and who
    came in it up to the request itself.
    """
    got = status.filter("status_code = 'ok'").select("request_id", "login", "game_id", "place", "info")
    came = got.select(F.col("login").alias("username"), F.col("place").alias("_came"))
    table = state["players"].join(got.select("game_id").distinct(), "game_id", "left_semi").select("username", "game_id")
    shown = got.drop("login").join(table.join(came, "username", "left"), "game_id")
    return shown.filter(F.coalesce("_came", F.lit(0)) <= F.col("place")).select(
        "request_id", "game_id", "info", F.col("username").alias("players_in_game")
    )
