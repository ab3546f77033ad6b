"""SQL twins of the registered queries, for a second engine to check them."""

from __future__ import annotations

from tablestakes.plans.ctes import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, **extra: str) -> None:
    ORACLES[name] = with_views(sql, **extra)


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# --- sources and sinks ---
oracle("scan_typed", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders")
oracle(
    "card_catalog",
    """SELECT id, color, rank, (SELECT count(*) FROM hands JOIN cards USING (card_id) WHERE cards.id = t.id) AS held
       FROM card_type t""",
)
_ON_TURN = "SELECT game_id, username FROM players JOIN turns ON username = current_player"
oracle(
    "append_select",
    """SELECT card_id, username FROM hands
       UNION ALL SELECT card_on_table, username FROM now_on JOIN games USING (game_id) WHERE card_on_table IS NOT NULL""",
    now_on=_ON_TURN,
)
oracle(
    "surrogate_keys",
    """SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS card_id
       FROM orders""",
)
oracle(
    "hashed_keys",
    """SELECT line, n, row_number() OVER (ORDER BY line) AS line_id
       FROM (SELECT md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS line, count(*) AS n FROM lineitem GROUP BY 1)""",
)
oracle(
    "columnar_json",
    """SELECT game_id, to_json({'username': list(username ORDER BY username), 'points': list(points ORDER BY username),
                'next_player': list(next_player ORDER BY username)})::VARCHAR AS result
       FROM players GROUP BY game_id""",
)

oracle(
    "columnar_pieces",
    """SELECT event_type, piece, count(*) AS n,
              to_json({'event_id': list(event_id ORDER BY event_id), 'user_id': list(user_id ORDER BY event_id)})::VARCHAR AS result
       FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 512 + 1 AS piece FROM events)
       GROUP BY event_type, piece""",
)

# --- audits ---
oracle(
    "pk_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
oracle(
    "fk_orphans",
    """SELECT request_id, asker AS login
       FROM (SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 's' || (1 + request_id % 61) ELSE login END AS asker FROM requests)
       WHERE NOT EXISTS (SELECT 1 FROM players WHERE username = asker)""",
)
oracle(
    "not_null_audit",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS n FROM {t}"
        for t, columns in {
            "users": ["username", "u_password", "activity", "p_count"],
            "players": ["username", "points", "game_id"],
            "card_type": ["id", "color", "rank"],
            "cards": ["card_id", "id"],
            "turns": ["current_player"],
            "hands": ["card_id", "username"],
            "games": ["game_id", "game_phase"],
            "decks": ["card_id", "game_id"],
        }.items()
        for c in columns
    ),
)
_KEPT = {
    "users": "substr(username, 2)::BIGINT % 13 <> 5", "players": "substr(username, 2)::BIGINT % 11 <> 3",
    "games": "game_id % 7 <> 2", "cards": "card_id % 9 <> 4", "card_type": "id % 100 <> 30",
}
oracle(
    "fk_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}.{k} -> {p} kept.{pk}' AS relation, {k}::VARCHAR AS key, count(*) AS n FROM {c}
            WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {_KEPT[p]}) GROUP BY {k}"""
        for c, k, p, pk in [
            ("players", "username", "users", "username"), ("players", "next_player", "players", "username"),
            ("players", "game_id", "games", "game_id"), ("cards", "id", "card_type", "id"),
            ("turns", "current_player", "players", "username"), ("hands", "card_id", "cards", "card_id"),
            ("hands", "username", "users", "username"), ("games", "card_on_table", "cards", "card_id"),
            ("decks", "card_id", "cards", "card_id"), ("decks", "game_id", "games", "game_id"),
        ]
    ),
)
oracle(
    "ring_audit",
    """SELECT game_id, 'pointer out of the game' AS rule, count(*) AS n FROM led
       WHERE next_player IS NOT NULL AND target IS NULL GROUP BY 1
       UNION ALL SELECT game_id, 'ring in parts', count(DISTINCT least) FROM firsts GROUP BY 1 HAVING count(DISTINCT least) > 1
       UNION ALL SELECT game_id, 'seat outside the ring', sum(n - coalesce(ring, 0))::BIGINT
       FROM (SELECT game_id, least, count(*) AS n FROM firsts GROUP BY ALL)
       LEFT JOIN (SELECT l.username AS least, f.k + 1 AS ring FROM led l JOIN firsts f ON f.username = l.target AND f.least = l.username) USING (least)
       GROUP BY 1 HAVING sum(n - coalesce(ring, 0)) > 0""",
    pointing="""
        SELECT s.*, CASE WHEN s.game_id % 6 IN (1, 5) AND s.seat = 1 THEN 2 WHEN s.game_id % 6 = 1 AND s.seat = 3 THEN s.seats
                         WHEN s.seat = 1 THEN s.seats ELSE s.seat - 1 END AS nth
        FROM seats s WHERE s.game_id % 4 <> 0""",
    led="""
        SELECT game_id, username, next_player, CASE WHEN next_player IN (SELECT username FROM pointing q WHERE q.game_id = z.game_id) THEN next_player END AS target
        FROM (SELECT p.game_id, p.username, CASE WHEN p.game_id % 6 = 3 AND p.seat = 1 THEN 'u' || (p.c_custkey + 5) ELSE t.username END AS next_player
              FROM pointing p LEFT JOIN seats t ON t.game_id = p.game_id AND t.seat = p.nth) z""",
    firsts="""
        SELECT game_id, username, min(arrived) AS least, arg_min(k, (arrived, k)) AS k
        FROM (WITH RECURSIVE walk(game_id, username, arrived, k) AS (
                SELECT game_id, username, username, 0 FROM led
                UNION ALL SELECT w.game_id, w.username, l.target, w.k + 1 FROM walk w JOIN led l ON l.username = w.arrived
                WHERE w.k < 7 AND l.target IS NOT NULL) SELECT * FROM walk)
        GROUP BY 1, 2""",
)
oracle(
    "domain_audit",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {test}) AS n FROM {t}"
        for t, rule, test in [
            ("pages", "url longer than 30", "length(url) > 30"),
            ("users", "username longer than 30", "length(username) > 30"),
            ("users", "u_password longer than 30", "length(u_password) > 30"),
            ("conversations", "role outside user, assistant", "role NOT IN ('user', 'assistant')"),
            ("requests", "source outside deck, table", "source NOT IN ('deck', 'table')"),
            ("requests", "kind outside take, place", "kind NOT IN ('take', 'place')"),
        ]
    ),
)
oracle(
    "game_invariants",
    """SELECT * FROM (
         SELECT game_id, 'waiting game without exactly one open seat' AS rule, open_n AS n FROM facts
         WHERE card_on_table IS NULL AND open_n <> 1
         UNION ALL SELECT game_id, 'running game with an open ring', open_n + unpointed FROM facts
         WHERE card_on_table IS NOT NULL AND open_n + unpointed > 0
         UNION ALL SELECT game_id, 'more seats than wanted', seats_n FROM facts WHERE seats_n > wanted
         UNION ALL SELECT game_id, 'deck without 108 cards', deck_n FROM facts WHERE deck_n <> 108
         UNION ALL SELECT game_id, 'hand outside 9 to 11', bad_n FROM facts WHERE bad_n > 0
         UNION ALL SELECT game_id, 'card in two hands', count(*) FROM decks
         WHERE card_id IN (SELECT card_id FROM hands GROUP BY 1 HAVING count(*) > 1) GROUP BY 1
         UNION ALL SELECT game_id, 'table card in a hand out of turn', count(*) FROM games JOIN hands ON card_id = card_on_table
         WHERE username NOT IN (SELECT current_player FROM turns) GROUP BY 1)""",
    facts="""
        SELECT g.game_id, g.card_on_table, count(*) AS seats_n,
               count(*) FILTER (WHERE p.next_player IS NULL) AS open_n,
               count(*) FILTER (WHERE p.username NOT IN (SELECT next_player FROM players WHERE next_player IS NOT NULL))
                 AS unpointed,
               max(u.p_count) FILTER (WHERE p.next_player IS NULL) AS wanted,
               count(*) FILTER (WHERE h.n NOT BETWEEN 9 AND 11) AS bad_n,
               max(k.n) AS deck_n
        FROM games g JOIN players p USING (game_id) JOIN users u USING (username)
        JOIN (SELECT username, count(*) AS n FROM hands GROUP BY 1) h USING (username)
        JOIN (SELECT game_id, count(*) AS n FROM decks GROUP BY 1) k USING (game_id)
        GROUP BY ALL""",
)

# --- projections and predicates ---
oracle("project_literals", "SELECT 'hand' AS info, card_id AS my_cards FROM hands")
oracle(
    "credential_match",
    "SELECT request_id, login FROM requests WHERE (login, pw) IN (SELECT (username, u_password) FROM users)",
)
oracle(
    "open_seats",
    "SELECT game_id, username FROM players JOIN games USING (game_id) WHERE next_player IS NULL AND card_on_table IS NULL",
)
oracle("player_count_check", "SELECT request_id, number, number < 2 OR number > 6 AS refused FROM requests")
oracle(
    "not_table_card",
    """SELECT game_id, card_id FROM decks d
       WHERE card_id <> (SELECT card_on_table FROM games g WHERE g.game_id = d.game_id)""",
)
_ENTRY = """CASE WHEN a.u_password IS NULL OR a.u_password <> r.pw THEN 'wrong_password'
    WHEN a.game_id IS NULL THEN 'not_in_game'
    WHEN a.card_on_table IS NULL THEN 'waiting' """
_TURN = """WHEN a.game_phase = 11 THEN 'game_over'
    WHEN a.current_player IS DISTINCT FROM r.login THEN 'not_your_turn' """
oracle(
    "request_guard",
    """SELECT request_id, login, kind, status_code,
         CASE status_code WHEN 'wrong_password' THEN 'Wrong password'
           WHEN 'not_in_game' THEN 'Connect to game or create new first'
           WHEN 'waiting' THEN 'Waiting for players' WHEN 'game_over' THEN 'Game is over'
           WHEN 'not_your_turn' THEN CASE kind WHEN 'claim' THEN 'Wait for your turn' ELSE 'Error' END
           WHEN 'wrong_phase' THEN 'Sorry' ELSE 'ok' END AS message,
         CASE WHEN status_code = 'waiting' THEN players_in_game
           WHEN status_code = 'wrong_phase' THEN game_phase
           WHEN status_code = 'not_your_turn' AND kind <> 'claim' THEN card_on_table END AS detail
       FROM guarded""",
    guarded=f"""
        SELECT r.request_id, r.login, r.kind, a.players_in_game, a.game_phase, a.card_on_table,
               CASE WHEN r.kind = 'claim' THEN
                 {_ENTRY} WHEN a.current_player IS DISTINCT FROM r.login THEN 'not_your_turn'
                 WHEN r.number <> a.game_phase THEN 'wrong_phase' ELSE 'ok' END
               ELSE {_ENTRY} {_TURN} ELSE 'ok' END END AS status_code
        FROM requests r LEFT JOIN accounts a ON a.username = r.login""",
)

oracle(
    "game_state",
    """SELECT request_id, login, code AS status_code,
         CASE code WHEN 'wrong_password' THEN 'Wrong password'
           WHEN 'not_in_game' THEN 'Connect to game or create new first'
           WHEN 'waiting' THEN 'Waiting for players' WHEN 'game_over' THEN 'Game is over' ELSE 'ok' END AS message,
         CASE WHEN code <> 'wrong_password' THEN game_id END AS game_id,
         CASE code WHEN 'waiting' THEN players_in_game END AS players_in_game
       FROM (SELECT r.request_id, r.login, a.game_id, a.players_in_game,
                    {entry} WHEN a.game_phase = 11 THEN 'game_over' ELSE 'ok' END AS code
             FROM requests r LEFT JOIN accounts a ON a.username = r.login)""".replace("{entry}", _ENTRY),
)

# --- joins ---
oracle(
    "natural_join_cards",
    "SELECT card_id, username, id, color, rank FROM hands NATURAL JOIN cards NATURAL JOIN card_type",
)
oracle("current_player", "SELECT game_id, current_player FROM players, turns WHERE username = current_player")
oracle("deck_build", "SELECT game_id, card_id, id FROM decks NATURAL JOIN cards")
oracle("hand_slots", "SELECT game_id, username, s::INT AS slot_no FROM players CROSS JOIN range(1, 11) t(s)")
oracle(
    "zip_join",
    """SELECT a.game_id, a.username, b.card_id FROM
         (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY username) AS rn FROM players) a
         JOIN dealt b ON a.game_id = b.game_id AND a.rn = b.pos""",
)
oracle("semi_join", "SELECT username, game_id FROM players WHERE EXISTS (SELECT 1 FROM requests WHERE login = username)")
oracle("anti_join", "SELECT game_id, card_id FROM decks WHERE card_id NOT IN (SELECT card_id FROM hands)")
oracle(
    "not_in_null_aware",
    """SELECT 'with nulls' AS list, game_id, card_id FROM decks WHERE card_id NOT IN (SELECT card_on_table FROM games)
       UNION ALL SELECT 'without nulls', game_id, card_id FROM decks
       WHERE card_id NOT IN (SELECT card_on_table FROM games WHERE card_on_table IS NOT NULL)""",
)
oracle(
    "distinct_fanout",
    """SELECT game_id, card_id FROM decks
       WHERE card_id NOT IN (SELECT card_id FROM hands) AND (SELECT count(*) FROM hands) > 0""",
)
oracle(
    "scalar_lookup",
    """SELECT username, points, game_id FROM players
       WHERE game_id = (SELECT game_id FROM players ORDER BY points DESC, game_id DESC LIMIT 1)""",
)
oracle(
    "turn_successor",
    """SELECT p.username, p.next_player, q.points AS next_points
       FROM players p JOIN players q ON p.next_player = q.username""",
)
oracle(
    "skip_successor",
    """SELECT game_id, current_player, rank,
         CASE WHEN rank = 14 THEN (SELECT next_player FROM players q WHERE q.username = p.next_player)
              ELSE p.next_player END AS next_turn
       FROM turns JOIN players p ON username = current_player JOIN games USING (game_id)
       JOIN cards ON card_id = card_on_table JOIN card_type USING (id)""",
)

# --- aggregates ---
oracle("hand_size", "SELECT username, count(*) AS cards FROM hands GROUP BY username")
oracle(
    "waiting_games",
    """SELECT game_id, count(card_on_table) AS table_cards, count(card_on_table) = 0 AS waiting
       FROM games GROUP BY game_id""",
)
oracle(
    "distinct_in_attempt",
    "SELECT attempt_id, count(*) AS cards, count(DISTINCT id) AS distinct_cards FROM order_cards GROUP BY attempt_id",
)
oracle("cards_needed", "SELECT game_id, count(*) * 10 AS cards FROM players GROUP BY game_id")
oracle(
    "score_totals",
    """SELECT o_custkey, sum(2 * (1 + o_orderkey % 10) - 1)::BIGINT AS points FROM orders GROUP BY o_custkey""",
)
oracle("seats_filled", "SELECT game_id, seats_n AS seats, p_count, seats_n >= p_count AS filled FROM room", room="""
    SELECT game_id, count(*) AS seats_n, max(p_count) FILTER (WHERE next_player IS NULL) AS p_count
    FROM players JOIN users USING (username) JOIN games USING (game_id) WHERE card_on_table IS NULL GROUP BY game_id""")

# --- top-k and sampling ---
oracle("latest_game", "SELECT game_id, game_phase FROM games ORDER BY game_id DESC LIMIT 1")
oracle("top_k", "SELECT card_id, game_id FROM decks ORDER BY card_id DESC LIMIT 108")
_LOBBY = f"""
    SELECT game_id, username AS created_by, datesub('minute', activity, {AS_OF}) AS minutes_ago
    FROM users NATURAL JOIN players NATURAL JOIN games
    WHERE next_player IS NULL AND card_on_table IS NULL AND {AS_OF} - activity <= INTERVAL 6 HOUR"""
oracle(
    "lobby_list",
    """SELECT row_number() OVER (ORDER BY activity, game_id) AS rank, game_id, created_by, minutes_ago
       FROM lobby JOIN users ON username = created_by""",
    lobby=_LOBBY,
)
oracle("deal_sample", "SELECT game_id, card_id, pos AS rn FROM dealt WHERE pos <= 10")
oracle("random_pick", "SELECT game_id, card_id FROM dealt WHERE pos = 1")

# --- set operations ---
oracle(
    "state_snapshot",
    """SELECT game_id, username AS viewer, 1 AS section_order, 'hand' AS info, card_id::VARCHAR AS my_cards, color,
              rank::VARCHAR AS rank
       FROM hands NATURAL JOIN cards NATURAL JOIN card_type NATURAL JOIN
            (SELECT username, game_id FROM players NATURAL JOIN games WHERE card_on_table IS NOT NULL)
       UNION SELECT game_id, NULL, 2, 'table', card_on_table::VARCHAR, color, rank::VARCHAR
       FROM games JOIN cards ON card_id = card_on_table NATURAL JOIN card_type
       UNION SELECT game_id, NULL, 3, 'current player', current_player, 'plase', game_phase::VARCHAR
       FROM turns JOIN players ON username = current_player NATURAL JOIN games WHERE card_on_table IS NOT NULL
       UNION SELECT game_id, NULL, 4, 'players in game', username, points::VARCHAR, next_player
       FROM players NATURAL JOIN games WHERE card_on_table IS NOT NULL""",
)
oracle(
    "union_distinct",
    "SELECT username FROM players UNION SELECT current_player FROM turns UNION SELECT login FROM requests",
)

# --- table changes ---
oracle(
    "apply_updates",
    """SELECT username, u_password, coalesce(m.ts, activity) AS activity,
              (CASE WHEN m.login IS NULL THEN p_count ELSE 2 + m.number % 5 END)::INT AS p_count
       FROM users LEFT JOIN (SELECT * FROM requests
         QUALIFY row_number() OVER (PARTITION BY login ORDER BY ts DESC, request_id DESC) = 1) m ON m.login = username""",
)
oracle(
    "apply_increment",
    """SELECT username, (points + coalesce((SELECT sum(2 * number - 1) FROM requests
                WHERE kind = 'claim' AND login = username), 0))::INT AS points, next_player, game_id FROM players""",
)
oracle("advance_turn", "SELECT next_player AS current_player FROM turns JOIN players ON username = current_player")
oracle(
    "apply_deletes",
    "SELECT card_id, username FROM hands WHERE username NOT IN (SELECT login FROM requests WHERE kind = 'leave')",
)
oracle(
    "ring_unlink",
    """SELECT username, CASE WHEN lag(username) OVER w IS NOT NULL THEN lag(username) OVER w
                             WHEN NOT waiting THEN last_value(username) OVER (PARTITION BY game_id ORDER BY seat
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_player, game_id
       FROM seats WHERE username NOT IN (
         SELECT login FROM requests JOIN users ON username = login AND u_password = pw WHERE kind = 'leave')
       WINDOW w AS (PARTITION BY game_id ORDER BY seat)""",
)
oracle(
    "teardown_games",
    """SELECT 'hands' AS table_name, count(*) AS rows_left FROM hands
         WHERE username NOT IN (SELECT username FROM players JOIN dead USING (game_id))
       UNION ALL SELECT 'turns', count(*) FROM turns
         WHERE current_player NOT IN (SELECT username FROM players JOIN dead USING (game_id))
       UNION ALL SELECT 'players', count(*) FROM players WHERE game_id NOT IN (FROM dead)
       UNION ALL SELECT 'games', count(*) FROM games WHERE game_id NOT IN (FROM dead)
       UNION ALL SELECT 'decks', count(*) FROM decks WHERE game_id NOT IN (FROM dead)
       UNION ALL SELECT 'cards', count(*) FROM cards JOIN decks USING (card_id) WHERE game_id NOT IN (FROM dead)""",
    dead="SELECT game_id FROM games WHERE game_phase = 11",
)
oracle(
    "serialise_requests",
    """SELECT request_id, game_id, row_number() OVER (PARTITION BY game_id ORDER BY ts, request_id) = 1 AS admitted
       FROM requests JOIN players ON username = login""",
)

# --- scalar functions ---
oracle(
    "byte_length_check",
    """SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, strlen(text) < 2 AS too_short FROM documents""",
)
oracle("minutes_ago", f"SELECT username, datesub('minute', activity, {AS_OF}) AS minutes_ago FROM users")
oracle(
    "recent_activity",
    f"SELECT username, activity FROM users WHERE {AS_OF} - activity <= INTERVAL 6 HOUR",
)
oracle("phase_points", "SELECT game_id, game_phase, 2 * game_phase - 1 AS points FROM games")
oracle("normalise_login", "SELECT c_custkey, lower(c_name) AS login FROM customer")
oracle(
    "card_label",
    """SELECT card_id, CASE rank WHEN 13 THEN '★' WHEN 14 THEN 'Skip' ELSE rank::VARCHAR END AS label
       FROM hands NATURAL JOIN cards NATURAL JOIN card_type
       UNION ALL SELECT -game_id, 'Deck' FROM games""",
)
oracle(
    "state_fingerprint",
    """SELECT username, md5(strlen(username) || '=' || username || '|' || strlen(points::VARCHAR) || '=' || points
                            || '|' || coalesce(strlen(next_player) || '=' || next_player, '-')
                            || '|' || strlen(game_id::VARCHAR) || '=' || game_id) AS fp FROM players""",
)

# --- composed operators ---
_REGISTER = """SELECT s.request_id, s.login,
         CASE WHEN taken THEN 'taken_login' WHEN strlen(s.login) < 2 THEN 'short_login'
              WHEN strlen(pw) < 2 THEN 'short_password' ELSE 'ok' END AS status_code,
         CASE WHEN taken THEN 'Same login already exists' WHEN strlen(s.login) < 2 THEN 'Login is too short'
              WHEN strlen(pw) < 2 THEN 'Password is too short' ELSE 'Account created!' END AS message
       FROM (SELECT s.*, u.username IS NOT NULL OR coalesce((w.ts, w.request_id) < (s.ts, s.request_id), false) AS taken
             FROM sign_ups s LEFT JOIN users u ON u.username = s.login
             LEFT JOIN (SELECT * FROM sign_ups WHERE strlen(login) > 1 AND strlen(pw) > 1
               QUALIFY row_number() OVER (PARTITION BY login ORDER BY ts, request_id) = 1) w ON w.login = s.login) s"""
_SIGN_UPS = """
        SELECT o_orderkey AS request_id, o_orderdate AS ts,
               CASE o_orderpriority WHEN '5-LOW' THEN 'x' ELSE 'u' || (o_custkey * 2) END AS login,
               CASE o_orderstatus WHEN 'P' THEN 'p' ELSE 'secret' END AS pw
        FROM orders"""
oracle("register_users", _REGISTER, sign_ups=_SIGN_UPS)
oracle(
    "initial_deal",
    "SELECT game_id, username, card_id FROM seats JOIN dealt USING (game_id) WHERE (pos - 1) // 10 + 1 = seat",
)
oracle(
    "seat_ring",
    """SELECT game_id, username, coalesce(lag(username) OVER (PARTITION BY game_id ORDER BY seat),
         arg_max(username, seat) OVER (PARTITION BY game_id)) AS next_player FROM seats""",
)
oracle(
    "game_start",
    """SELECT s.game_id, arg_min(d.card_id, d.pos) AS card_on_table,
         max(s.username) FILTER (WHERE s.seat = s.seats - 1) AS current_player,
         max(s.username) FILTER (WHERE s.seat = 1) AS host, max(s.username) FILTER (WHERE s.seat = s.seats) AS last_joiner
       FROM seats s JOIN dealt d USING (game_id)
       WHERE s.waiting AND d.card_id NOT IN (SELECT card_id FROM hands)
         AND s.seats >= (SELECT p_count FROM users u JOIN seats h USING (username) WHERE h.game_id = s.game_id AND h.seat = 1)
       GROUP BY s.game_id""",
)
oracle(
    "lobby_route",
    """SELECT request_id, login, code AS status_code,
         CASE code WHEN 'wrong_password' THEN 'Wrong password' WHEN 'seated' THEN 'You are in game already'
                   WHEN 'empty' THEN 'Create your own game' ELSE 'list' END AS message,
         CASE code WHEN 'seated' THEN game_id END AS game_id
       FROM (SELECT r.request_id, r.login, a.game_id,
               CASE WHEN a.u_password IS NULL OR a.u_password <> r.pw THEN 'wrong_password'
                    WHEN a.game_id IS NOT NULL THEN 'seated'
                    WHEN (SELECT count(*) FROM lobby) = 0 THEN 'empty' ELSE 'list' END AS code
             FROM requests r LEFT JOIN accounts a ON a.username = r.login)""",
    lobby=_LOBBY,
)
_FACES = "SELECT card_id AS face_card, rank AS face_rank FROM cards NATURAL JOIN card_type"
_DRAW = """SELECT j.request_id, j.login,
         CASE WHEN code = 'ok' AND w.request_id IS NULL THEN 'deferred' ELSE code END AS status_code,
         CASE code WHEN 'wrong_password' THEN 'Wrong password'
           WHEN 'not_in_game' THEN 'Connect to game or create new first' WHEN 'waiting' THEN 'Waiting for players'
           WHEN 'game_over' THEN 'Game is over' WHEN 'not_your_turn' THEN 'Error'
           WHEN 'hand_full' THEN 'You can''t take more cards'
           WHEN 'deck_only' THEN 'You can take card from deck(1)' ELSE 'ok' END AS message,
         CASE WHEN w.request_id IS NULL THEN NULL WHEN j.source = 'table' THEN j.card_on_table
              ELSE (SELECT arg_min(card_id, pos) FROM dealt d WHERE d.game_id = j.game_id
                    AND card_id <> j.card_on_table AND card_id NOT IN (SELECT card_id FROM hands)) END AS card_id,
         CASE WHEN w.request_id IS NOT NULL AND j.hand_size = 9 THEN
           CASE WHEN j.face_rank = 14 THEN (SELECT next_player FROM players p WHERE p.username = j.next_player)
                ELSE j.next_player END END AS next_turn
       FROM judged j LEFT JOIN (SELECT arg_min(request_id, (ts, request_id)) AS request_id FROM judged
                                WHERE code = 'ok' GROUP BY game_id) w USING (request_id)"""
_DRAW_VIEWS = dict(
    faces=_FACES,
    judged=f"""
        SELECT r.request_id, r.ts, r.login, r.source, a.*, f.face_rank,
               {_ENTRY} {_TURN} WHEN a.hand_size = 11 THEN 'hand_full'
               WHEN r.source = 'table' AND (a.hand_size = 9 OR f.face_rank = 14) THEN 'deck_only' ELSE 'ok' END AS code
        FROM requests r LEFT JOIN accounts a ON a.username = r.login
        LEFT JOIN faces f ON f.face_card = a.card_on_table""",
)
oracle("draw_cards", _DRAW, **_DRAW_VIEWS)
_TOLD = """CASE j.code WHEN 'waiting' THEN j.players_in_game END AS waiting_players,
         CASE j.code WHEN 'not_your_turn' THEN j.current_player END AS turn_holder"""
oracle(
    "draw_replies",
    f"""SELECT request_id, d.status_code, {_TOLD}, CASE j.code WHEN 'not_your_turn' THEN j.card_on_table END AS table_card,
         CASE j.code WHEN 'hand_full' THEN 'Call p_card to finish your turn' END AS hint
       FROM judged j JOIN drawn d USING (request_id)""",
    drawn=_DRAW,
    **_DRAW_VIEWS,
)
_DISCARD = """SELECT j.request_id, j.login, j.card_id,
         CASE WHEN code = 'ok' AND w.request_id IS NULL THEN 'deferred' ELSE code END AS status_code,
         CASE code WHEN 'wrong_password' THEN 'Wrong password'
           WHEN 'not_in_game' THEN 'Connect to game or create new first' WHEN 'waiting' THEN 'Waiting for players'
           WHEN 'game_over' THEN 'Game is over' WHEN 'not_your_turn' THEN 'Error'
           WHEN 'wrong_card' THEN 'Wrong card id' WHEN 'already_placed' THEN 'You already did this'
           ELSE 'ok' END AS message,
         CASE WHEN w.request_id IS NOT NULL AND j.hand_size = 11 THEN
           CASE WHEN j.face_rank = 14 THEN (SELECT next_player FROM players p WHERE p.username = j.next_player)
                ELSE j.next_player END END AS next_turn
       FROM judged j LEFT JOIN (SELECT arg_min(request_id, (ts, request_id)) AS request_id FROM judged
                                WHERE code = 'ok' GROUP BY game_id) w USING (request_id)"""
_DISCARD_VIEWS = dict(
    faces=_FACES,
    lowest="SELECT username, min(card_id) AS low FROM hands GROUP BY username",
    judged=f"""
        SELECT r.request_id, r.ts, r.login, r.card_id, a.*, f.face_rank,
               {_ENTRY} {_TURN} WHEN NOT EXISTS (SELECT 1 FROM hands h WHERE h.card_id = r.card_id AND h.username = r.login)
                 THEN 'wrong_card'
               WHEN a.hand_size = 9 THEN 'already_placed' ELSE 'ok' END AS code
        FROM (SELECT q.*, CASE source WHEN 'deck' THEN low ELSE low + 1 END AS card_id
              FROM requests q LEFT JOIN lowest ON lowest.username = q.login) r
        LEFT JOIN accounts a ON a.username = r.login LEFT JOIN faces f ON f.face_card = r.card_id""",
)
oracle("discard_cards", _DISCARD, **_DISCARD_VIEWS)
oracle(
    "discard_replies",
    f"""SELECT request_id, p.status_code, {_TOLD},
         CASE WHEN p.status_code = 'ok' AND j.hand_size = 10 THEN j.card_id WHEN j.code = 'not_your_turn' THEN j.card_on_table END AS table_card,
         CASE WHEN j.code = 'already_placed' OR (p.status_code = 'ok' AND j.hand_size = 10) THEN 'Call t_card to finish your turn' END AS hint
       FROM judged j JOIN discarded p USING (request_id)""",
    discarded=_DISCARD,
    **_DISCARD_VIEWS,
)
_LEAVE = """SELECT request_id, login, game_id, CASE WHEN late THEN 'not_seated' ELSE code END AS status_code,
         CASE WHEN late OR code = 'not_seated' THEN 'You are not in game now'
              WHEN code = 'wrong_password' THEN 'Wrong password' WHEN code = 'end_turn' THEN 'End your turn first'
              ELSE 'now you can find new game' END AS message,
         CASE WHEN code = 'ok' AND NOT late THEN
           CASE WHEN count(*) FILTER (WHERE code = 'ok' AND NOT late) OVER (PARTITION BY game_id) = players_in_game
                THEN 'teardown' ELSE 'unlink' END END AS route
       FROM (SELECT *, code = 'ok' AND row_number() OVER (PARTITION BY login, code ORDER BY ts, request_id) > 1 AS late
             FROM asked)"""
_LEAVE_VIEWS = dict(
    asked="""
        SELECT r.request_id, r.ts, r.login, a.game_id, a.players_in_game,
               CASE WHEN a.u_password IS NULL OR a.u_password <> r.pw THEN 'wrong_password'
                    WHEN a.game_id IS NULL THEN 'not_seated'
                    WHEN a.card_on_table IS NOT NULL AND a.players_in_game > 1 AND a.hand_size <> 10
                         AND a.game_phase <> 11 THEN 'end_turn' ELSE 'ok' END AS code
        FROM requests r LEFT JOIN accounts a ON a.username = r.login WHERE r.kind = 'leave'""",
)
oracle("leave_route", _LEAVE, **_LEAVE_VIEWS)
oracle(
    "attempt_cards",
    """SELECT h.username || '-' || ((pos - 1) // 5) AS attempt_id, (pos - 1) % 5 + 1 AS pos, h.card_id, CASE WHEN mine THEN id END AS id,
              CASE WHEN mine THEN rank END AS rank, CASE WHEN mine THEN color END AS color
       FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY card_id)::INT AS pos FROM hands) h
       JOIN (SELECT username, game_id % 2 = 0 OR next_player = username AS mine FROM players) p
         ON p.username = h.username
       JOIN cards c ON c.card_id = h.card_id JOIN card_type t USING (id)""",
)


def _verdict(name: str, phase: str) -> None:
    oracle(
        name,
        "SELECT attempt_id, phase, distinct_cards, fail_pos, message FROM verdicts",
        cut_cards=f"""
            SELECT attempt_id || '-' || ((pos - 1) // n) AS attempt_id, phase, (pos - 1) % n + 1 AS pos, id, rank, color
            FROM order_cards JOIN claim_sizes ON phase = {phase}""",
        claims="SELECT DISTINCT attempt_id, phase FROM cut_cards",
        claim_cards="SELECT attempt_id, pos, id, rank, color FROM cut_cards",
    )


_verdict("phase_set_rule", "1")
_verdict("phase_run_rule", "2")
_verdict("phase_color_rule", "3")
_verdict("phase_blocks", "[1, 6, 9, 10][attempt_id % 4 + 1]")
_verdict("phase_verdict", "1 + attempt_id % 10")

_GRANTED = """
    SELECT game_id, username FROM players JOIN turns ON username = current_player
    WHERE username IN (SELECT login FROM requests WHERE kind = 'claim')"""
oracle(
    "phase_advance",
    """SELECT game_id, p.username,
         (points + CASE WHEN p.username = g.username THEN 2 * game_phase - 1 ELSE 0 END)::INT AS points,
         (game_phase + CASE WHEN g.username IS NULL THEN 0 ELSE 1 END)::INT AS game_phase
       FROM players p JOIN games USING (game_id) LEFT JOIN granted g USING (game_id)""",
    granted=_GRANTED,
)
oracle(
    "redeal",
    """SELECT card_id, username FROM hands JOIN players USING (username) WHERE game_id NOT IN (SELECT game_id FROM granted)
       UNION ALL
       SELECT c.card_id, s.username
       FROM (SELECT game_id, card_id,
                    row_number() OVER (PARTITION BY game_id ORDER BY md5('again:' || card_id), card_id) AS k
             FROM decks JOIN games USING (game_id) WHERE card_id IS DISTINCT FROM card_on_table) c
       JOIN (SELECT game_id, username, row_number() OVER (PARTITION BY game_id ORDER BY username) AS s FROM players) s
         ON s.game_id = c.game_id AND (c.k - 1) // 10 + 1 = s.s
       WHERE c.game_id IN (SELECT game_id FROM granted)""",
    granted=_GRANTED,
)
oracle(
    "final_standings",
    """SELECT game_id, 'Game is over' AS info, username AS players, points,
              rank() OVER (PARTITION BY game_id ORDER BY points)::INT AS place
       FROM players JOIN games USING (game_id) WHERE game_phase = 11""",
)
_LEDGER = """
    SELECT username, ts, event_id, delta,
           (10 + total - coalesce(last_value(CASE WHEN fresh THEN total END IGNORE NULLS) OVER w, 0))::BIGINT AS hand_size
    FROM (SELECT *, sum(delta) OVER (PARTITION BY username ORDER BY ts, event_id) AS total FROM moves)
    WINDOW w AS (PARTITION BY username ORDER BY ts, event_id)"""
for _name in ("move_ledger", "stream_move_ledger", "stream_resent_events"):
    _late = ", FALSE AS late, 0::BIGINT AS late_rows" if _name.startswith("stream") else ""
    oracle(
        _name,
        f"SELECT username, ts, event_id, delta, hand_size, hand_size BETWEEN 9 AND 11 AS legal{_late} FROM ledger",
        ledger=_LEDGER,
    )
oracle(
    "phase_progress",
    """SELECT game_phase, count(DISTINCT game_id) AS games, (count(DISTINCT game_id) * (game_phase - 1) ** 2)::BIGINT AS points_given,
              sum(points)::BIGINT AS points_held
       FROM games JOIN players USING (game_id) GROUP BY game_phase""",
)
_CREATE = """SELECT request_id, login, CASE WHEN late THEN 'seated' ELSE code END AS status_code,
         CASE WHEN late OR code = 'seated' THEN 'You are in game already' WHEN code = 'wrong_password' THEN 'Wrong password'
              WHEN code = 'wrong_count' THEN 'Wrong number of players' ELSE 'ok' END AS message,
         CASE WHEN code = 'ok' AND NOT late THEN 1000000 + request_id END AS game_id
       FROM (SELECT *, code = 'ok' AND row_number() OVER (PARTITION BY login, code ORDER BY ts, request_id) > 1 AS late
             FROM asked)"""
_CREATE_VIEWS = dict(
    asked="""
        SELECT r.request_id, r.ts, r.login,
               CASE WHEN a.u_password IS NULL OR a.u_password <> r.pw THEN 'wrong_password'
                    WHEN r.number NOT BETWEEN 2 AND 6 THEN 'wrong_count'
                    WHEN a.game_id IS NOT NULL THEN 'seated' ELSE 'ok' END AS code
        FROM (SELECT request_id, ts, number, coalesce(asker, login) AS login, coalesce(md5('pw:' || asker), pw) AS pw
              FROM (SELECT *, CASE WHEN request_id % 2 = 0 THEN 's' || (1 + request_id % 61) END AS asker FROM requests)) r
        LEFT JOIN accounts a ON a.username = r.login""",
)
oracle("create_games", _CREATE, **_CREATE_VIEWS)
oracle(
    "create_hands",
    """SELECT card_id, username FROM hands
       UNION ALL SELECT card_id, login FROM (
         SELECT game_id * 1000 + id AS card_id, login,
                row_number() OVER (PARTITION BY game_id ORDER BY md5('7:' || (game_id * 1000 + id)), id) AS pos
         FROM (SELECT * FROM made WHERE game_id IS NOT NULL), card_type) WHERE pos <= 10""",
    made=_CREATE,
    **_CREATE_VIEWS,
)
oracle(
    "create_players",
    """SELECT username, points, next_player, game_id FROM players
       UNION ALL SELECT login, 0, NULL, game_id FROM made WHERE game_id IS NOT NULL""",
    made=_CREATE,
    **_CREATE_VIEWS,
)
oracle(
    "sign_up_users",
    f"""SELECT username, u_password, activity, p_count FROM users
       UNION ALL SELECT r.login, md5(pw), {AS_OF}, 2 FROM registered r JOIN sign_ups USING (request_id) WHERE status_code = 'ok'""",
    registered=_REGISTER,
    sign_ups=_SIGN_UPS,
)
oracle(
    "teardown_rows",
    """SELECT 'hands' AS table_name, card_id::VARCHAR AS a, username AS b FROM hands
         WHERE username NOT IN (SELECT username FROM players JOIN dead USING (game_id))
       UNION ALL SELECT 'turns', current_player, current_player FROM turns
         WHERE current_player NOT IN (SELECT username FROM players JOIN dead USING (game_id))
       UNION ALL SELECT 'players', username, game_id::VARCHAR FROM players WHERE game_id NOT IN (FROM dead)
       UNION ALL SELECT 'games', game_id::VARCHAR, game_phase::VARCHAR FROM games WHERE game_id NOT IN (FROM dead)
       UNION ALL SELECT 'decks', card_id::VARCHAR, game_id::VARCHAR FROM decks WHERE game_id NOT IN (FROM dead)
       UNION ALL SELECT 'cards', card_id::VARCHAR, id::VARCHAR FROM cards JOIN decks USING (card_id) WHERE game_id NOT IN (FROM dead)""",
    dead="SELECT game_id FROM games WHERE game_phase = 11",
)
_JOIN = """SELECT request_id, login, game_id,
         CASE WHEN code <> 'ok' OR sits THEN code WHEN has_seat THEN 'seated'
              WHEN again THEN 'deferred' ELSE 'full' END AS status_code,
         CASE WHEN code = 'wrong_password' THEN 'Wrong password'
              WHEN code = 'seated' OR (code = 'ok' AND has_seat AND NOT sits) THEN 'You are in game already'
              WHEN code = 'ok' AND (sits OR again) THEN 'ok'
              ELSE 'Wrong game_id, check list of games' END AS message
       FROM (SELECT *, bool_or(sits) OVER (PARTITION BY login) AS has_seat
             FROM (SELECT *, coalesce(code = 'ok' AND NOT again AND row_number() OVER (
                          PARTITION BY game_id, code, again ORDER BY ts, request_id) <= free, false) AS sits
                   FROM (SELECT *, row_number() OVER (PARTITION BY login, code ORDER BY ts, request_id) > 1 AS again
                         FROM asked)))"""
_JOIN_VIEWS = dict(
    room="""
        SELECT game_id, max(p_count) FILTER (WHERE next_player IS NULL) - count(*) AS free
        FROM players JOIN users USING (username) JOIN games USING (game_id) WHERE card_on_table IS NULL GROUP BY game_id""",
    asking="""
        SELECT o_orderkey AS request_id, o_orderdate AS ts, o_custkey // 20 * 4 AS game_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 's' || (1 + o_orderkey % 61) ELSE 'u' || o_custkey END AS login
        FROM orders""",
    asked="""
        SELECT q.*, free,
               CASE WHEN a.username IS NULL THEN 'wrong_password'
                    WHEN g.game_id IS NULL THEN 'wrong_game'
                    WHEN a.game_id IS NOT NULL THEN 'seated'
                    WHEN free IS NULL OR free <= 0 THEN 'full' ELSE 'ok' END AS code
        FROM asking q LEFT JOIN accounts a ON a.username = q.login
        LEFT JOIN games g ON g.game_id = q.game_id LEFT JOIN room ON room.game_id = g.game_id""",
)
oracle("join_games", _JOIN, **_JOIN_VIEWS)
_CLAIM = """SELECT request_id, login,
         CASE WHEN code <> 'ok' THEN code WHEN message <> 'You get points!' THEN 'refused'
              WHEN row_number() OVER (PARTITION BY login, code, message ORDER BY request_id) > 1 THEN 'deferred' ELSE 'ok' END AS status_code,
         fail_pos, CASE code WHEN 'waiting' THEN 'Waiting for players' WHEN 'not_your_turn' THEN 'Wait for your turn'
              WHEN 'wrong_phase' THEN 'Sorry' ELSE message END AS message
       FROM (SELECT substr(username, 2)::BIGINT * 10 + split_part(v.attempt_id, '-', 2)::BIGINT AS request_id, username AS login, v.fail_pos, v.message,
                    CASE WHEN card_on_table IS NULL THEN 'waiting'
                         WHEN current_player IS DISTINCT FROM username THEN 'not_your_turn'
                         WHEN game_phase = 11 THEN 'wrong_phase' ELSE 'ok' END AS code
             FROM accounts JOIN verdicts v ON split_part(v.attempt_id, '-', 1) = username)"""
_CLAIM_VIEWS = dict(
    claims="SELECT DISTINCT attempt_id, phase FROM hand_claims",
    claim_cards="SELECT attempt_id, pos, id, rank, color FROM hand_claims",
    hand_claims="""
        SELECT username || '-' || ((nth - 1) // n) AS attempt_id, (nth - 1) % n + 1 AS pos, id, rank, color, phase
        FROM (SELECT username, row_number() OVER (PARTITION BY username ORDER BY card_id) AS nth, id, rank, color
              FROM hands JOIN cards USING (card_id) JOIN card_type USING (id))
        JOIN (SELECT username, least(game_phase, 10) AS phase FROM players JOIN games USING (game_id)) USING (username)
        JOIN claim_sizes USING (phase)""",
)
oracle("claim_phase", _CLAIM, **_CLAIM_VIEWS)
oracle(
    "claim_replies",
    """SELECT request_id, status_code, CASE status_code WHEN 'waiting' THEN players_in_game END AS waiting_players,
              CASE status_code WHEN 'wrong_phase' THEN game_phase END AS current_phase
       FROM judged_claims JOIN accounts ON username = login""",
    judged_claims=_CLAIM,
    **_CLAIM_VIEWS,
)
_LAST_CLAIMS = """SELECT substr(username, 2)::BIGINT AS request_id, username AS claimant, game_id,
                         CASE WHEN card_on_table IS NULL THEN 'waiting' WHEN game_phase <> 10 THEN 'wrong_phase' ELSE 'ok' END AS status_code,
                         game_phase
                  FROM accounts WHERE current_player = username"""
oracle(
    "claim_last_phase",
    """SELECT request_id, status_code, CASE status_code WHEN 'waiting' THEN 'Waiting for players' WHEN 'wrong_phase' THEN 'Sorry'
              ELSE 'You get points!' END AS message, CASE status_code WHEN 'wrong_phase' THEN game_phase END AS current_phase
       FROM last_claims""",
    last_claims=_LAST_CLAIMS,
)
oracle(
    "claim_standings",
    """SELECT request_id, game_id, 'Game is over' AS info, username AS players, scored AS points,
              rank() OVER (PARTITION BY game_id ORDER BY scored)::INT AS place
       FROM (SELECT request_id, game_id, username, (points + CASE WHEN username = claimant THEN 19 ELSE 0 END)::INT AS scored
             FROM last_claims JOIN players USING (game_id) WHERE status_code = 'ok')""",
    last_claims=_LAST_CLAIMS,
)

# --- tables after a batch ---
_WON = """
    SELECT a.username, a.game_id, a.game_phase, a.next_player, a.hand_size
    FROM judged_claims JOIN accounts a ON a.username = login WHERE status_code = 'ok'"""
_AFTER_CLAIMS = """
    SELECT g.game_id, CASE WHEN w.hand_size = 11 AND w.game_phase < 10 THEN
             (SELECT arg_min(card_id, md5('7:' || card_id)) FROM decks d WHERE d.game_id = g.game_id AND card_id NOT IN (SELECT card_id FROM hands))
           ELSE card_on_table END AS card_on_table,
           (g.game_phase + CASE WHEN w.game_id IS NULL THEN 0 ELSE 1 END)::INT AS game_phase
    FROM games g LEFT JOIN won w ON w.game_id = g.game_id"""
for _name, _sql in {
    "claim_games": "SELECT game_id, card_on_table, game_phase FROM after_claims",
    "claim_players": """SELECT p.username, (points + CASE WHEN w.username IS NULL THEN 0 ELSE 2 * w.game_phase - 1 END)::INT AS points,
                               p.next_player, p.game_id FROM players p LEFT JOIN won w ON w.username = p.username""",
    "claim_turns": """SELECT current_player FROM turns WHERE current_player NOT IN (SELECT username FROM won)
                      UNION ALL SELECT next_player FROM won WHERE game_phase < 10""",
    "claim_hands": """SELECT card_id, username FROM hands WHERE username NOT IN (
                        SELECT username FROM players WHERE game_id IN (SELECT game_id FROM won WHERE game_phase < 10))
                      UNION ALL
                      SELECT c.card_id, s.username
                      FROM (SELECT game_id, d.card_id, row_number() OVER (PARTITION BY game_id ORDER BY md5('7:' || d.card_id), d.card_id) AS k
                            FROM decks d JOIN after_claims USING (game_id) WHERE d.card_id IS DISTINCT FROM card_on_table) c
                      JOIN (SELECT game_id, username, row_number() OVER (PARTITION BY game_id ORDER BY username) AS s FROM players) s
                        ON s.game_id = c.game_id AND (c.k - 1) // 10 + 1 = s.s
                      WHERE c.game_id IN (SELECT game_id FROM won WHERE game_phase < 10)""",
}.items():
    oracle(_name, _sql, won=_WON, after_claims=_AFTER_CLAIMS, judged_claims=_CLAIM, **_CLAIM_VIEWS)
oracle(
    "draw_hands",
    "SELECT card_id, username FROM hands UNION ALL SELECT card_id, login FROM drawn WHERE card_id IS NOT NULL",
    drawn=_DRAW,
    **_DRAW_VIEWS,
)
oracle(
    "draw_turns",
    """SELECT coalesce(next_turn, current_player) AS current_player
       FROM turns LEFT JOIN (SELECT * FROM drawn WHERE next_turn IS NOT NULL) ON login = current_player""",
    drawn=_DRAW,
    **_DRAW_VIEWS,
)
oracle(
    "discard_games",
    """SELECT game_id, coalesce(p.card_id, card_on_table) AS card_on_table, game_phase
       FROM games LEFT JOIN (SELECT * FROM placed WHERE status_code = 'ok') p ON p.card_id // 1000 = game_id""",
    placed=_DISCARD,
    **_DISCARD_VIEWS,
)
oracle(
    "discard_hands",
    "SELECT card_id, username FROM hands WHERE card_id NOT IN (SELECT card_id FROM placed WHERE status_code = 'ok')",
    placed=_DISCARD,
    **_DISCARD_VIEWS,
)
oracle(
    "discard_turns",
    """SELECT coalesce(next_turn, current_player) AS current_player
       FROM turns LEFT JOIN (SELECT * FROM placed WHERE next_turn IS NOT NULL) ON login = current_player""",
    placed=_DISCARD,
    **_DISCARD_VIEWS,
)
oracle(
    "leave_hands",
    "SELECT card_id, username FROM hands WHERE username NOT IN (SELECT login FROM gone WHERE route IS NOT NULL)",
    gone=_LEAVE,
    **_LEAVE_VIEWS,
)
oracle(
    "leave_users",
    """SELECT username, u_password, activity,
              CASE WHEN username IN (SELECT login FROM gone WHERE route IS NOT NULL) THEN 2 ELSE p_count END AS p_count FROM users""",
    gone=_LEAVE,
    **_LEAVE_VIEWS,
)
oracle(
    "leave_turns",
    """SELECT current_player FROM turns WHERE current_player NOT IN (SELECT login FROM gone WHERE route IS NOT NULL)
       UNION ALL
       SELECT arg_min(s.username, (h.seat - s.seat + h.seats) % h.seats)
       FROM seats h JOIN seats s ON s.game_id = h.game_id AND s.username NOT IN (SELECT login FROM gone WHERE route IS NOT NULL)
       WHERE h.username IN (SELECT current_player FROM turns) AND h.username IN (SELECT login FROM gone WHERE route = 'unlink')
       GROUP BY h.username""",
    gone=_LEAVE,
    **_LEAVE_VIEWS,
)
oracle(
    "leave_players",
    """SELECT username, CASE WHEN lag(username) OVER w IS NOT NULL THEN lag(username) OVER w
                             WHEN NOT waiting THEN last_value(username) OVER (PARTITION BY game_id ORDER BY seat
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_player, game_id
       FROM seats WHERE username NOT IN (SELECT login FROM gone WHERE route IS NOT NULL)
       WINDOW w AS (PARTITION BY game_id ORDER BY seat)""",
    gone=_LEAVE,
    **_LEAVE_VIEWS,
)
oracle(
    "join_players",
    """SELECT username, CASE WHEN lag(username) OVER w IS NOT NULL THEN lag(username) OVER w
                             WHEN NOT waiting OR (newcomers > 0 AND n >= wants) THEN final END AS next_player, game_id
       FROM (SELECT *, count(*) OVER g AS n, sum(newcomer) OVER g AS newcomers, max(wants_) OVER g AS wants,
                    arg_max(username, place) OVER g AS final
             FROM chain WINDOW g AS (PARTITION BY game_id))
       WINDOW w AS (PARTITION BY game_id ORDER BY place)""",
    chain="""
        SELECT username, game_id, seat AS place, 0 AS newcomer, waiting,
               CASE WHEN seat = 1 THEN (SELECT p_count FROM users u WHERE u.username = seats.username) END AS wants_
        FROM seats
        UNION ALL SELECT login, game_id, 100 + row_number() OVER (PARTITION BY game_id ORDER BY o_orderdate, request_id), 1,
               true, NULL
        FROM joined JOIN orders ON o_orderkey = request_id WHERE status_code = 'ok'""",
    joined=_JOIN,
    **_JOIN_VIEWS,
)

_NEWCOMERS = """
    SELECT login, j.game_id, row_number() OVER (PARTITION BY j.game_id ORDER BY o_orderdate, request_id) AS place
    FROM joined j JOIN orders ON o_orderkey = request_id WHERE status_code = 'ok'"""
oracle(
    "join_replies",
    """SELECT w.request_id, w.game_id, CASE WHEN w.place = w.free THEN 'Game start!' END AS info, l.username AS players_in_game
       FROM (SELECT n.*, a.request_id, a.free FROM newcomers n JOIN joined j USING (login, game_id) JOIN asked a USING (request_id)
             WHERE j.status_code = 'ok') w
       JOIN (SELECT username, game_id, 0 AS came FROM players UNION ALL SELECT login, game_id, place FROM newcomers) l
         ON l.game_id = w.game_id AND l.came <= w.place""",
    newcomers=_NEWCOMERS,
    joined=_JOIN,
    **_JOIN_VIEWS,
)
_FREE = """
    SELECT game_id, card_id, row_number() OVER (PARTITION BY game_id ORDER BY md5('7:' || card_id), card_id) AS nth
    FROM decks WHERE card_id NOT IN (SELECT card_id FROM hands)"""
oracle(
    "join_hands",
    """SELECT card_id, username FROM hands
       UNION ALL SELECT card_id, login FROM free_deck JOIN newcomers USING (game_id) WHERE (nth - 1) // 10 + 1 = place""",
    newcomers=_NEWCOMERS,
    free_deck=_FREE,
    joined=_JOIN,
    **_JOIN_VIEWS,
)
oracle(
    "join_tables",
    """SELECT game_id, CASE WHEN n.came > 0 AND s.seated + n.came >= s.wants THEN
                (SELECT arg_min(card_id, nth) FROM free_deck f WHERE f.game_id = g.game_id AND nth > 10 * n.came)
              ELSE card_on_table END AS card_on_table, game_phase
       FROM games g LEFT JOIN (SELECT game_id, count(*) AS came FROM newcomers GROUP BY 1) n USING (game_id)
       LEFT JOIN (SELECT game_id, count(*) AS seated, max(CASE WHEN seat = 1 THEN p_count END) AS wants
                  FROM seats JOIN users USING (username) GROUP BY 1) s USING (game_id)""",
    newcomers=_NEWCOMERS,
    free_deck=_FREE,
    joined=_JOIN,
    **_JOIN_VIEWS,
)

# --- streaming ---
oracle(
    "stream_last_activity",
    "SELECT 'u' || user_id AS username, max(ts) AS activity FROM events GROUP BY user_id",
)
oracle(
    "stream_state_changes",
    """SELECT username, ts, event_id, fp, FALSE AS late, 0::BIGINT AS late_rows FROM (
         SELECT 'u' || user_id AS username, ts, event_id, event_type AS fp,
                lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
       WHERE old IS DISTINCT FROM fp""",
)
