"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestakes.functions import scalars
from tablestakes.operators import (
    audits, changes, columnar, deal, guards, joins, lobby, numbering, phases, ring, turns,
)
from tablestakes.session import cut, scratch_dir
from tablestakes.sources import catalog, roles, schema
from tablestakes.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


col, lit = F.col, F.lit
SEED = roles.SEED


# --- sources and sinks -------------------------------------------------------


@query
def scan_typed(spark, d):
    return schema.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")


@query
def card_catalog(spark, d):
    """The catalogue with how many cards of each type are held."""
    held = roles.hands(spark, d).join(roles.cards(spark, d), "card_id").groupBy("id").agg(F.count("*").alias("n"))
    return catalog.card_catalog(spark).join(held, "id", "left").select(
        "id", "color", "rank", F.coalesce("n", lit(0)).cast("bigint").alias("held")
    )


@query
def append_select(spark, d):
    """Players on turn take the table card: hands with the new rows appended."""
    games, players = roles.games(spark, d), roles.players(spark, d)
    taken = (
        roles.turns(spark, d).withColumnRenamed("current_player", "username")
        .join(players.select("username", "game_id"), "username")
        .join(games.filter("card_on_table IS NOT NULL"), "game_id")
        .select(col("card_on_table").alias("card_id"), "username")
    )
    return changes.append(roles.hands(spark, d), taken)


@query
def surrogate_keys(spark, d):
    """New dense numbers for all orders, after the largest key in use."""
    orders = schema.load(spark, d, "orders").select("o_orderkey")
    start = orders.agg(F.max("o_orderkey") + 1).scalar()
    return numbering.number_rows(orders, ["o_orderkey"], start, "card_id")


@query
def hashed_keys(spark, d):
    """Dense numbers for all order lines along hashed 64-bit ids."""
    lines = schema.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    hashed = lines.groupBy(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("line")).agg(F.count("*").alias("n"))
    return numbering.number_rows(hashed, ["line"], 1, "line_id")


@query
def columnar_json(spark, d):
    return columnar.columnar_json(
        roles.players(spark, d), ["game_id"], "username", ["username", "points", "next_player"]
    )


@query
def columnar_pieces(spark, d):
    """Events of a type in pieces of 512 rows, whatever their number."""
    events = schema.load(spark, d, "events")
    return columnar.columnar_pieces(
        events, ["event_type"], ["event_id"], ["event_id", "user_id"], numbering.id_slice("event_id"), piece_rows=512
    )


# --- audits ------------------------------------------------------------------


@query
def pk_violations(spark, d):
    return audits.pk_violations(schema.load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def fk_orphans(spark, d):
    """Requests of logins without a seat."""
    child = roles.requests(spark, d).select("request_id", _from_seatless("request_id", "login").alias("login"))
    return audits.fk_orphans(child, "login", roles.players(spark, d), "username", "request_id")


@query
def not_null_audit(spark, d):
    state = roles.state(spark, d)
    return audits.union_all([audits.not_null(state[t], t, schema.required(t)) for t in schema.GAME_TABLES])


@query
def fk_audit(spark, d):
    """All declared relations, over tables that lost every seventh game and some parents."""
    state = roles.state(spark, d)
    kept = {
        "users": "cast(substr(username, 2) as bigint) % 13 <> 5", "players": "cast(substr(username, 2) as bigint) % 11 <> 3",
        "games": "game_id % 7 <> 2", "cards": "card_id % 9 <> 4", "card_type": "id % 100 <> 30",
    }
    parents = {t: df.where(kept[t]) if t in kept else df for t, df in state.items()}
    lost = {f"{t} kept": df for t, df in parents.items()}
    relations = [(c, column, f"{p} kept", key) for c, column, p, key in schema.FOREIGN_KEYS]
    return audits.fk_audit({**state, **lost}, relations)


@query
def ring_audit(spark, d):
    """Rings of the running games after planted faults: split in two, led into the next game, or with a tail."""
    seats = roles.seats(spark, d)
    here = seats.select("game_id", col("seat").alias("_to"), col("username").alias("_name"))
    broken = F.expr(
        """CASE WHEN game_id % 6 = 1 AND seat = 1 THEN 2 WHEN game_id % 6 = 1 AND seat = 3 THEN seats
                WHEN game_id % 6 = 5 AND seat = 1 THEN 2 WHEN seat = 1 THEN seats ELSE seat - 1 END"""
    )
    pointed = seats.withColumn("_to", broken.cast("int")).join(here, ["game_id", "_to"], "left")
    led_away = F.expr("CASE WHEN game_id % 6 = 3 AND seat = 1 THEN concat('u', c_custkey + 5) ELSE _name END")
    players = pointed.select("username", led_away.alias("next_player"), "game_id")
    return audits.ring_audit(players, roles.games(spark, d).where("card_on_table IS NOT NULL"))


@query
def domain_audit(spark, d):
    return audits.union_all(
        [
            audits.count_by_rule(
                schema.load(spark, d, "pages"), "pages", {"url longer than 30": audits.too_long("url", 30)}
            ),
            audits.count_by_rule(
                roles.users(spark, d),
                "users",
                {
                    f"{c} longer than {n}": audits.too_long(c, n)
                    for c, n in (("username", 30), ("u_password", 30))
                },
            ),
            audits.count_by_rule(
                schema.load(spark, d, "conversations"),
                "conversations",
                {"role outside user, assistant": audits.outside("role", ["user", "assistant"])},
            ),
            audits.count_by_rule(
                roles.requests(spark, d),
                "requests",
                {
                    "source outside deck, table": audits.outside("source", ["deck", "table"]),
                    "kind outside take, place": audits.outside("kind", ["take", "place"]),
                },
            ),
        ]
    )


@query
def game_invariants(spark, d):
    return audits.game_invariants(roles.state(spark, d))


# --- projections and predicates ----------------------------------------------


@query
def project_literals(spark, d):
    return roles.hands(spark, d).select(lit("hand").alias("info"), col("card_id").alias("my_cards"))


@query
def credential_match(spark, d):
    users = roles.users(spark, d).select(col("username").alias("login"), col("u_password").alias("pw"))
    asked = roles.requests(spark, d).select("request_id", "login", "pw")
    return joins.lookup(asked, users, ["login", "pw"], "request_id", "left_semi").select("request_id", "login")


@query
def open_seats(spark, d):
    waiting = roles.games(spark, d).filter(col("card_on_table").isNull())
    seats = roles.players(spark, d).filter(col("next_player").isNull())
    return seats.join(waiting, "game_id", "left_semi").select("game_id", "username")


@query
def player_count_check(spark, d):
    c = col("number")
    return roles.requests(spark, d).select(
        "request_id", "number", ((c < catalog.MIN_SEATS) | (c > catalog.MAX_SEATS)).alias("refused")
    )


@query
def not_table_card(spark, d):
    """Deck cards other than the table card; a waiting game has none to differ from."""
    return roles.decks(spark, d).join(roles.games(spark, d), "game_id").filter(
        col("card_id") != col("card_on_table")
    ).select("game_id", "card_id")


@query
def request_guard(spark, d):
    return guards.guard(roles.state(spark, d), roles.requests(spark, d)).select(
        "request_id", "login", "kind", "status_code", "message", "detail"
    )


@query
def game_state(spark, d):
    return guards.view_status(roles.state(spark, d), roles.requests(spark, d))


# --- joins -------------------------------------------------------------------


@query
def natural_join_cards(spark, d):
    return joins.natural_join(
        roles.hands(spark, d), roles.cards(spark, d), F.broadcast(catalog.card_catalog(spark))
    ).select("card_id", "username", "id", "color", "rank")


@query
def current_player(spark, d):
    players, turns_ = roles.players(spark, d), roles.turns(spark, d)
    return players.join(turns_, players["username"] == turns_["current_player"]).select("game_id", "current_player")


@query
def deck_build(spark, d):
    return deal.build_decks(roles.games(spark, d))


@query
def hand_slots(spark, d):
    return deal.hand_slots(roles.players(spark, d)).select("game_id", "username", "slot_no")


@query
def zip_join(spark, d):
    """The k-th player of each game with its k-th card in seeded order."""
    cards = deal.sample(roles.decks(spark, d), catalog.DECK_SIZE, SEED).drop("rn")
    return numbering.zip_join(
        roles.players(spark, d).select("game_id", "username"),
        cards.withColumn("h", scalars.seeded_hash("card_id", SEED)),
        ["game_id"],
        ["username"],
        ["h", "card_id"],
    ).select("game_id", "username", "card_id")


@query
def semi_join(spark, d):
    """Players who sent a request."""
    return joins.semi(
        roles.players(spark, d), roles.requests(spark, d).select(col("login").alias("username")), ["username"]
    ).select("username", "game_id")


@query
def anti_join(spark, d):
    """Cards in nobody's hand."""
    return joins.anti(roles.decks(spark, d), roles.hands(spark, d), ["card_id"]).select("game_id", "card_id")


@query
def not_in_null_aware(spark, d):
    """NOT IN over a nullable list (empty result) and over the same list without NULLs."""
    decks, games = roles.decks(spark, d), roles.games(spark, d)
    parts = [
        joins.not_in(decks, "card_id", listed, "card_on_table").select(lit(name).alias("list"), "game_id", "card_id")
        for name, listed in (("with nulls", games), ("without nulls", games.filter("card_on_table IS NOT NULL")))
    ]
    return parts[0].unionByName(parts[1])


@query
def distinct_fanout(spark, d):
    return joins.fanout_distinct(roles.decks(spark, d), roles.hands(spark, d)).select("game_id", "card_id")


@query
def scalar_lookup(spark, d):
    """Everyone at the table of the player with the most points."""
    players = roles.players(spark, d)
    table = players.agg(F.max(F.struct("points", "game_id")).alias("m")).select("m.game_id").scalar()
    return players.filter(col("game_id") == table).select("username", "points", "game_id")


@query
def turn_successor(spark, d):
    players = roles.players(spark, d)
    following = players.select(col("username").alias("next_player"), col("points").alias("next_points"))
    return players.join(following, "next_player").select("username", "next_player", "next_points")


@query
def skip_successor(spark, d):
    """Next on turn in running games; a skip card on the table passes twice."""
    state = roles.state(spark, d)
    faces = state["cards"].join(F.broadcast(state["card_type"]), "id").select(
        col("card_id").alias("card_on_table"), "rank"
    )
    now = state["turns"].select(col("current_player").alias("username")).join(
        state["players"].select("username", "game_id"), "username"
    )
    return (
        now.join(state["games"], "game_id").join(faces, "card_on_table")
        .join(ring.successors(state["players"]), "username")
        .select(
            "game_id", col("username").alias("current_player"), "rank",
            F.when(col("rank") == catalog.SKIP, col("hop2")).otherwise(col("hop1")).alias("next_turn"),
        )
    )


# --- aggregates --------------------------------------------------------------


@query
def hand_size(spark, d):
    return roles.hands(spark, d).groupBy("username").agg(F.count("*").alias("cards"))


@query
def waiting_games(spark, d):
    """COUNT of a nullable column: zero table cards means the game waits."""
    return roles.games(spark, d).groupBy("game_id").agg(F.count("card_on_table").alias("table_cards")).withColumn(
        "waiting", col("table_cards") == 0
    )


@query
def distinct_in_attempt(spark, d):
    lines = schema.load(spark, d, "lineitem").select(col("l_orderkey").alias("attempt_id"), col("l_partkey").alias("id"))
    return lines.groupBy("attempt_id").agg(F.count("*").alias("cards"), F.count_distinct("id").alias("distinct_cards"))


@query
def cards_needed(spark, d):
    return roles.players(spark, d).groupBy("game_id").agg((F.count("*") * catalog.HAND_SIZE).alias("cards"))


@query
def score_totals(spark, d):
    """Points per player over all orders taken as finished phases."""
    done = schema.load(spark, d, "orders").selectExpr("o_custkey", "1 + o_orderkey % 10 AS phase")
    return done.groupBy("o_custkey").agg(F.sum(scalars.phase_points("phase")).alias("points"))


@query
def seats_filled(spark, d):
    return ring.seats_filled(roles.state(spark, d)).select("game_id", "seats", "p_count", "filled")


# --- top-k and sampling ------------------------------------------------------


@query
def latest_game(spark, d):
    return roles.games(spark, d).orderBy(F.desc("game_id")).limit(1).select("game_id", "game_phase")


@query
def top_k(spark, d):
    """The newest deck: the 108 largest card ids."""
    return roles.decks(spark, d).orderBy(F.desc("card_id")).limit(catalog.DECK_SIZE).select("card_id", "game_id")


@query
def lobby_list(spark, d):
    return lobby.lobby(roles.state(spark, d), roles.as_of())


@query
def deal_sample(spark, d):
    return deal.sample(roles.decks(spark, d), catalog.HAND_SIZE, SEED).select("game_id", "card_id", col("rn").cast("bigint").alias("rn"))


@query
def random_pick(spark, d):
    return deal.pick(roles.decks(spark, d), SEED)


# --- set operations ----------------------------------------------------------


@query
def state_snapshot(spark, d):
    return lobby.snapshot(roles.state(spark, d))


@query
def union_distinct(spark, d):
    names = [
        roles.players(spark, d).select("username"),
        roles.turns(spark, d).select(col("current_player").alias("username")),
        roles.requests(spark, d).select(col("login").alias("username")),
    ]
    return names[0].union(names[1]).union(names[2]).distinct()


# --- table changes -----------------------------------------------------------


@query
def apply_updates(spark, d):
    """Stamp activity and wanted seats of every login from its latest request."""
    latest = (
        roles.requests(spark, d).groupBy(col("login").alias("username"))
        .agg(F.max(F.struct("ts", "request_id", "number")).alias("m"))
        .select("username", col("m.ts").alias("activity"), (2 + col("m.number") % 5).alias("p_count"))
    )
    return changes.apply_updates(roles.users(spark, d), latest, "username", ["activity", "p_count"])


@query
def apply_increment(spark, d):
    """Every claim request scores: points of its phase are added per player."""
    deltas = roles.requests(spark, d).filter("kind = 'claim'").selectExpr("login AS username", "2 * number - 1 AS delta")
    return changes.apply_increment(roles.players(spark, d), deltas, "username", "points")


@query
def advance_turn(spark, d):
    """Every turn passes on: the table updated from a lookup in players."""
    following = roles.players(spark, d).select(col("username").alias("current_player"), "next_player")
    return roles.turns(spark, d).join(following, "current_player").select(col("next_player").alias("current_player"))


@query
def apply_deletes(spark, d):
    """Hands without those of players who asked to leave."""
    gone = roles.requests(spark, d).filter("kind = 'leave'").select(col("login").alias("username"))
    return changes.apply_deletes(roles.hands(spark, d), gone, "username")


def _askers(spark, d):
    """Players with a right leave request."""
    asked = roles.requests(spark, d).filter("kind = 'leave'")
    users = roles.users(spark, d).select(col("username").alias("login"), col("u_password").alias("pw"))
    return joins.lookup(asked, users, ["login", "pw"], "request_id", "left_semi").select(col("login").alias("username"))


@query
def ring_unlink(spark, d):
    return ring.unlink(roles.players(spark, d), _askers(spark, d)).select("username", "next_player", "game_id")


@query
def teardown_games(spark, d):
    """Finished games are removed from every table; rows that stay, by table."""
    state = roles.state(spark, d)
    after = changes.teardown(state, state["games"].filter("game_phase = 11"))
    return audits.union_all(
        [
            after[t].agg(F.count("*").alias("rows_left")).select(lit(t).alias("table_name"), "rows_left")
            for t in ("hands", "turns", "players", "games", "decks", "cards")
        ]
    )


@query
def teardown_rows(spark, d):
    """Key and game or owner of every row that stays after finished games are removed, by table."""
    state = roles.state(spark, d)
    after = changes.teardown(state, state["games"].filter("game_phase = 11"))
    shown = {
        "hands": ("card_id", "username"), "turns": ("current_player", "current_player"), "players": ("username", "game_id"),
        "games": ("game_id", "game_phase"), "decks": ("card_id", "game_id"), "cards": ("card_id", "id"),
    }
    return audits.union_all(
        [after[t].select(lit(t).alias("table_name"), col(a).cast("string").alias("a"), col(b).cast("string").alias("b")) for t, (a, b) in shown.items()]
    )


@query
def serialise_requests(spark, d):
    seat = roles.players(spark, d).select(col("username").alias("login"), "game_id")
    asked = joins.lookup(roles.requests(spark, d).select("request_id", "ts", "login"), seat, ["login"], "request_id", "inner")
    return changes.serialise(asked).select("request_id", "game_id", "admitted")


# --- scalar functions --------------------------------------------------------


@query
def byte_length_check(spark, d):
    size = scalars.byte_length("text")
    return schema.load(spark, d, "documents").select(
        "doc_id", size.cast("bigint").alias("bytes"), F.char_length("text").cast("bigint").alias("chars"),
        (size < lobby.MIN_LENGTH).alias("too_short"),
    )


@query
def minutes_ago(spark, d):
    return roles.users(spark, d).select("username", scalars.minutes_between("activity", roles.as_of()).alias("minutes_ago"))


@query
def recent_activity(spark, d):
    return roles.users(spark, d).filter(scalars.recent("activity", roles.as_of())).select("username", "activity")


@query
def phase_points(spark, d):
    return roles.games(spark, d).select("game_id", "game_phase", scalars.phase_points("game_phase").alias("points"))


@query
def normalise_login(spark, d):
    return schema.load(spark, d, "customer").select("c_custkey", scalars.normal_login("c_name").alias("login"))


@query
def card_label(spark, d):
    """What clients print on every card held, and the back of each deck."""
    face = roles.hands(spark, d).join(roles.cards(spark, d), "card_id").join(
        F.broadcast(catalog.card_catalog(spark)), "id"
    ).select("card_id", "rank")
    backs = roles.games(spark, d).select((-col("game_id")).alias("card_id"), lit(15).alias("rank"))
    return face.unionByName(backs).select("card_id", scalars.card_label("rank").alias("label"))


@query
def state_fingerprint(spark, d):
    return roles.players(spark, d).select(
        "username", scalars.fingerprint(["username", "points", "next_player", "game_id"]).alias("fp")
    )


# --- composed operators ------------------------------------------------------


def _sign_ups(spark, d):
    """Orders as sign-up requests: many share one too-short login."""
    return schema.load(spark, d, "orders").selectExpr(
        "o_orderkey AS request_id",
        "o_orderdate AS ts",
        "CASE o_orderpriority WHEN '5-LOW' THEN 'x' ELSE concat('u', o_custkey * 2) END AS login",
        "CASE o_orderstatus WHEN 'P' THEN 'p' ELSE 'secret' END AS pw",
    )


@query
def register_users(spark, d):
    return lobby.register(roles.users(spark, d), _sign_ups(spark, d))


@query
def sign_up_users(spark, d):
    """All accounts after the batch of sign-ups."""
    return lobby.register_users({"users": roles.users(spark, d)}, _sign_ups(spark, d), roles.as_of(), F.md5("pw"))[1]["users"]


@query
def initial_deal(spark, d):
    return deal.initial_deal(roles.seats(spark, d), SEED)


@query
def seat_ring(spark, d):
    return ring.seat_ring(roles.seats(spark, d))


@query
def game_start(spark, d):
    return ring.start_games(roles.state(spark, d), SEED)


@query
def lobby_route(spark, d):
    return lobby.route(roles.state(spark, d), roles.requests(spark, d), roles.as_of())


def _takes(spark, d):
    """Every event as a take request."""
    return roles.requests(spark, d).select("request_id", "ts", "login", "pw", "source")


@query
def draw_cards(spark, d):
    return turns.draw(roles.state(spark, d), _takes(spark, d), SEED)[0].drop(*turns.TOLD)


@query
def draw_replies(spark, d):
    """What the client is told with each refused take."""
    return turns.draw(roles.state(spark, d), _takes(spark, d), SEED)[0].select("request_id", "status_code", *turns.TOLD)


@query
def draw_hands(spark, d):
    """All hands after the batch of takes."""
    return turns.draw(roles.state(spark, d), _takes(spark, d), SEED)[1]["hands"]


@query
def draw_turns(spark, d):
    """Who is on turn after the batch of takes."""
    return turns.draw(roles.state(spark, d), _takes(spark, d), SEED)[1]["turns"]


def _discard(spark, d):
    """Every request places the lowest card of the hand, or names the id after it."""
    state = roles.state(spark, d)
    lowest = state["hands"].groupBy(col("username").alias("login")).agg(F.min("card_id").alias("lowest"))
    asked = joins.lookup(_takes(spark, d), lowest, ["login"], "request_id")
    card = F.when(col("source") == "deck", col("lowest")).otherwise(col("lowest") + 1)
    return turns.discard(state, asked.withColumn("card_id", card).drop("lowest", "source"))


@query
def discard_cards(spark, d):
    return _discard(spark, d)[0].drop(*turns.TOLD)


@query
def discard_replies(spark, d):
    """What the client is told with each place that is refused or leaves the turn open."""
    return _discard(spark, d)[0].select("request_id", "status_code", *turns.TOLD)


@query
def discard_games(spark, d):
    """All games with their table cards after the batch of places."""
    return _discard(spark, d)[1]["games"]


@query
def discard_hands(spark, d):
    """All hands after the batch of places."""
    return _discard(spark, d)[1]["hands"]


@query
def discard_turns(spark, d):
    """Who is on turn after the batch of places."""
    return _discard(spark, d)[1]["turns"]


def _leaves(spark, d):
    return roles.requests(spark, d).filter("kind = 'leave'").select("request_id", "ts", "login", "pw")


@query
def leave_route(spark, d):
    return turns.leave_status(roles.state(spark, d), _leaves(spark, d))


@query
def leave_players(spark, d):
    """All seats after the batch of leaves."""
    return turns.leave(roles.state(spark, d), _leaves(spark, d))[1]["players"].select("username", "next_player", "game_id")


@query
def leave_hands(spark, d):
    """All hands after the batch of leaves."""
    return turns.leave(roles.state(spark, d), _leaves(spark, d))[1]["hands"]


@query
def leave_turns(spark, d):
    """Who is on turn after the batch of leaves: of a leaver, the next one who stays."""
    return turns.leave(roles.state(spark, d), _leaves(spark, d))[1]["turns"]


@query
def leave_users(spark, d):
    """All accounts after the batch of leaves."""
    return turns.leave(roles.state(spark, d), _leaves(spark, d))[1]["users"]


@query
def attempt_cards(spark, d):
    """Each hand cut into claims of five cards, checked for ownership.

    Every second claim is entered by the next player instead of the owner.
    """
    state = roles.state(spark, d)
    hand = numbering.numbered(state["hands"], ["username"], ["card_id"])
    lists = hand.groupBy("username", F.expr("(rn - 1) div 5").alias("k")).agg(F.sort_array(F.collect_list("card_id")).alias("cards"))
    attempts = lists.join(state["players"], "username").select(
        F.concat_ws("-", "username", "k").alias("attempt_id"),
        F.when(col("game_id") % 2 == 0, col("username")).otherwise(col("next_player")).alias("username"),
        lit(2).alias("phase"),
        "cards",
    )
    held = state["hands"].join(state["cards"], "card_id").join(F.broadcast(state["card_type"]), "id").select(
        "card_id", col("username").alias("owner"), "id", "rank", "color"
    )
    return phases.assemble(attempts, held).select("attempt_id", "pos", "card_id", "id", "rank", "color")


def _judged(spark, d, phase: str):
    return phases.verdicts(roles.cut_claims(roles.claim_cards(spark, d), phase))


@query
def phase_set_rule(spark, d):
    return _judged(spark, d, "1")


@query
def phase_run_rule(spark, d):
    return _judged(spark, d, "2")


@query
def phase_color_rule(spark, d):
    return _judged(spark, d, "3")


@query
def phase_blocks(spark, d):
    return _judged(spark, d, "element_at(array(1, 6, 9, 10), cast(attempt_id % 4 + 1 as int))")


@query
def phase_verdict(spark, d):
    return _judged(spark, d, "1 + attempt_id % 10")


def _granted(spark, d):
    """Claims taken as accepted: players on turn who sent a claim request."""
    asked = roles.requests(spark, d).filter("kind = 'claim'").select(col("login").alias("username"))
    on_turn = roles.turns(spark, d).select(col("current_player").alias("username"))
    seat = roles.players(spark, d).select("username", "game_id")
    return joins.semi(on_turn, asked, ["username"]).join(seat, "username").select("game_id", "username")


@query
def phase_advance(spark, d):
    after = phases.advance(roles.state(spark, d), _granted(spark, d))
    return after["players"].join(after["games"], "game_id").select("game_id", "username", "points", "game_phase")


@query
def redeal(spark, d):
    return deal.redeal(roles.state(spark, d), _granted(spark, d), "again")["hands"]


@query
def final_standings(spark, d):
    return lobby.standings(roles.state(spark, d))


@query
def move_ledger(spark, d):
    return turns.ledger(roles.moves(spark, d), numbering.time_slice("ts"))


@query
def phase_progress(spark, d):
    return lobby.progress(roles.state(spark, d))


def _from_seatless(row_id: str, login: str):
    """Every second request comes from an account without a seat."""
    return F.expr(f"CASE WHEN {row_id} % 2 = 0 THEN concat('s', 1 + {row_id} % 61) ELSE {login} END")


def _creates(spark, d):
    asked = roles.requests(spark, d).withColumn("by", _from_seatless("request_id", "login")).selectExpr(
        "request_id", "ts", "by AS login", "CASE WHEN by = login THEN pw ELSE md5(concat('pw:', by)) END AS pw",
        "number AS pl_count", "1000000 + request_id AS game_id",
    )
    return lobby.create_games(roles.state(spark, d), asked, roles.as_of(), SEED)


@query
def create_games(spark, d):
    return _creates(spark, d)[0]


@query
def create_hands(spark, d):
    """All hands after the batch of new games."""
    return _creates(spark, d)[1]["hands"]


@query
def create_players(spark, d):
    """All seats after the batch of new games."""
    return _creates(spark, d)[1]["players"]


def _joins(spark, d):
    """Accounts without a table ask for one; so do those who have one."""
    asked = (
        schema.load(spark, d, "orders").withColumn("login", _from_seatless("o_orderkey", "concat('u', o_custkey)"))
        .selectExpr(
            "o_orderkey AS request_id", "o_orderdate AS ts", "login",
            "md5(concat('pw:', login)) AS pw", "o_custkey div 20 * 4 AS game_id",
        )
    )
    return lobby.join_games(roles.state(spark, d), asked, roles.as_of(), SEED)


@query
def join_games(spark, d):
    return _joins(spark, d)[0].drop("place", "info")


@query
def join_replies(spark, d):
    """The players at the table for everyone who got a seat, and who made the game start."""
    return lobby.players_shown(*_joins(spark, d))


@query
def join_players(spark, d):
    """All seats after the batch of joins: rings of games that filled up are closed."""
    return _joins(spark, d)[1]["players"].select("username", "next_player", "game_id")


@query
def join_hands(spark, d):
    """All hands after the batch of joins."""
    return _joins(spark, d)[1]["hands"]


@query
def join_tables(spark, d):
    """All games after the batch of joins: those that filled up have a table card."""
    return _joins(spark, d)[1]["games"]


def _claims(spark, d):
    """Everyone claims the phase of the table with all cards of the hand, as many at a time as it asks for."""
    state = roles.state(spark, d)
    size = F.create_map(*[lit(x) for p in catalog.PHASES for x in (p, catalog.claim_size(p))])
    phase = F.least("game_phase", lit(10))
    seat = state["players"].join(state["games"].hint("merge"), "game_id").select("username", phase.alias("phase"))
    hand = numbering.numbered(state["hands"], ["username"], ["card_id"]).join(seat, "username")
    asked = (
        hand.groupBy("username", "phase", F.floor((col("rn") - 1) / size[col("phase")]).alias("k"))
        .agg(F.sort_array(F.collect_list("card_id")).alias("cards"))
        .select(
            (F.expr("cast(substr(username, 2) as bigint)") * 10 + col("k")).alias("request_id"),
            roles.as_of().alias("ts"),
            col("username").alias("login"),
            F.expr("md5(concat('pw:', username))").alias("pw"),
            "phase",
            "cards",
        )
    )
    return phases.claim(state, asked, SEED)


@query
def claim_phase(spark, d):
    return _claims(spark, d)[0].select("request_id", "login", "status_code", "fail_pos", "message")


@query
def claim_replies(spark, d):
    """What the client is told with each refused claim."""
    return _claims(spark, d)[0].select("request_id", "status_code", "waiting_players", "current_phase")


def _last_claims(spark, d):
    """Whoever is on turn holds four pairs and two more cards, and claims the last phase with the pairs."""
    state = roles.state(spark, d)
    on = state["turns"].select(col("current_player").alias("username"))
    seat = state["players"].join(on.hint("merge"), "username", "left_semi")
    # Hands and claims are made of these cards, and a claim reads the hands again and again.
    sets = joins.unpacked(cut(
        state["cards"].where(col("id").isin(10, 11, 50, 51, 90, 91, 130, 131, 170, 171)).join(state["decks"], "card_id")
        .join(seat.hint("merge"), "game_id").select("card_id", "id", "username")
    ))
    others = state["hands"].join(on, "username", "left_anti").join(sets, "card_id", "left_anti")
    state["hands"] = joins.unpacked(cut(
        changes.append(others.select("card_id", "username"), sets.select("card_id", "username"))
    ))
    asked = (
        sets.where("id < 170").groupBy(col("username").alias("login"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "card_id"))), lambda x: x["card_id"]).alias("cards"))
        .select(
            F.expr("cast(substr(login, 2) as bigint)").alias("request_id"), roles.as_of().alias("ts"), "login",
            F.expr("md5(concat('pw:', login))").alias("pw"), lit(10).alias("phase"), "cards",
        )
    )
    return phases.claim(state, asked, SEED)


@query
def claim_last_phase(spark, d):
    """Claims of the last phase: other games answer with the phase they are in."""
    return _last_claims(spark, d)[0].select("request_id", "status_code", "message", "current_phase")


@query
def claim_standings(spark, d):
    """Standings of the games that those claims ended."""
    return phases.final_standings(*_last_claims(spark, d))


@query
def claim_hands(spark, d):
    """All hands after the batch of claims: whoever sits with a winner got a new one."""
    return _claims(spark, d)[1]["hands"]


@query
def claim_games(spark, d):
    """All games after the batch of claims."""
    return _claims(spark, d)[1]["games"]


@query
def claim_players(spark, d):
    """All seats with their points after the batch of claims."""
    return _claims(spark, d)[1]["players"]


@query
def claim_turns(spark, d):
    """Who is on turn after the batch of claims."""
    return _claims(spark, d)[1]["turns"]


# --- streaming ---------------------------------------------------------------


def _stream(spark, d):
    # A pattern, because the source takes a plain path for a folder.
    return feeds.read_events(spark, f"{d.rstrip('/')}/event[s].parquet")


@query
def stream_last_activity(spark, d):
    return feeds.latest_activity(_stream(spark, d), scratch_dir(spark, "activity"))


def _replayed(spark, d, resend=False):
    """The events as parts that come about in time order and a closing mark, read one a batch."""
    events = schema.load(spark, d, "events")
    files = feeds.files_a_part(events)
    path = feeds.replay(events, scratch_dir(spark, "events"), resend=resend, mark=True, files=files)
    return feeds.read_events(spark, path, files)


def _moves(events):
    return events.selectExpr(
        "concat('u', user_id) AS username", "ts", "event_id",
        "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS delta",
        "event_type = 'purchase' AS fresh",
    )


@query
def stream_state_changes(spark, d):
    events = _replayed(spark, d).selectExpr("concat('u', user_id) AS username", "ts", "event_id", "event_type AS fp")
    return feeds.state_changes(events, scratch_dir(spark, "changes"), close=False)


@query
def stream_move_ledger(spark, d):
    return feeds.ledger_stream(_moves(_replayed(spark, d)), scratch_dir(spark, "ledger"), close=False)


@query
def stream_resent_events(spark, d):
    """The move ledger when every event but the last ones is sent twice."""
    return feeds.ledger_stream(_moves(_replayed(spark, d, resend=True)), scratch_dir(spark, "resent"), close=False, resent=True)
