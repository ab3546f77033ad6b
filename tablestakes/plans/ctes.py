"""The role views again, as SQL text for the second engine.

Written apart from the DataFrame code so that the check compares two
formulations. `with_views(sql)` prepends only the views a query needs.
"""

from __future__ import annotations

import re

from tablestakes.sources.catalog import rule_rows

_RULES = ",\n".join(
    "({}, {}, {}, {}, {}, '{}', {}, '{}')".format(*row[:8]) for row in rule_rows()
)

VIEWS = {
    "card_type": """
        SELECT (10 * (r * 4 + c + 1) + k)::INT AS id, ['green','yellow','red','purple'][c + 1] AS color,
               (r + 1)::INT AS rank
        FROM range(12) a(r), range(4) b(c), range(2) d(k)
        UNION ALL SELECT (490 + k)::INT, 'blue', 13 FROM range(8) t(k)
        UNION ALL SELECT (530 + k)::INT, 'blue', 14 FROM range(4) t(k)""",
    "rules": f"""
        SELECT * FROM (VALUES {_RULES})
        AS t(phase, pos, n, block_no, block_start, kind, step, message)""",
    "seats": """
        SELECT *, game_id % 4 = 0 AS waiting,
               game_id % 4 <> 0 AND game_id % 11 <> 10 AND seat = game_id % seats + 1 AS on_turn
        FROM (SELECT 'u' || c_custkey AS username, c_custkey, c_custkey // 5 AS game_id,
                     abs(floor(c_acctbal)::INT) % 100 AS points,
                     row_number() OVER (PARTITION BY c_custkey // 5 ORDER BY c_custkey) AS seat,
                     count(*) OVER (PARTITION BY c_custkey // 5) AS seats
              FROM customer)""",
    "players": """
        SELECT username, points, CASE WHEN seat > 1 THEN lag(username) OVER w
                                      WHEN NOT waiting THEN last_value(username) OVER (
                                        PARTITION BY game_id ORDER BY seat
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_player,
               game_id
        FROM seats WINDOW w AS (PARTITION BY game_id ORDER BY seat)""",
    "turns": "SELECT username AS current_player FROM seats WHERE on_turn",
    "decks": """
        SELECT game_id * 1000 + id AS card_id, game_id
        FROM (SELECT DISTINCT game_id FROM seats) g, card_type""",
    "cards": """
        SELECT game_id * 1000 + id AS card_id, id
        FROM (SELECT DISTINCT game_id FROM seats) g, card_type""",
    "dealt": """
        SELECT game_id, card_id,
               row_number() OVER (PARTITION BY game_id ORDER BY md5('7:' || card_id), card_id) AS pos
        FROM decks""",
    "laid": """
        SELECT game_id, game_id * 1000 + id AS card_id, p
        FROM (SELECT DISTINCT game_id FROM seats) g, range(108) t(p)
        JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM card_type) c
          ON c.n = (29 * p + 17 * game_id) % 108""",
    "games": """
        SELECT game_id, CASE WHEN game_id % 4 <> 0 THEN card_id END AS card_on_table,
               (CASE WHEN game_id % 4 = 0 THEN 1 ELSE 1 + game_id % 11 END)::INT AS game_phase
        FROM laid WHERE p = 60""",
    "hands": """
        SELECT card_id, username FROM seats JOIN laid USING (game_id)
        WHERE (p // 10 + 1 = seat AND NOT (on_turn AND game_id % 4 = 2 AND p = seat * 10 - 1))
           OR (on_turn AND game_id % 4 = 1 AND p = 61)""",
    "users": """
        SELECT 'u' || c_custkey AS username, md5('pw:u' || c_custkey) AS u_password,
               coalesce((SELECT max(ts) FROM events WHERE user_id = c_custkey),
                        TIMESTAMP '2024-01-01 00:00:00') AS activity,
               2 + c_nationkey % 5 AS p_count
        FROM customer
        UNION ALL SELECT 's' || s_suppkey, md5('pw:s' || s_suppkey), TIMESTAMP '2024-01-01 00:00:00', 2 + s_nationkey % 5 FROM supplier""",
    "requests": """
        SELECT event_id AS request_id, ts, 'u' || user_id AS login,
               CASE WHEN value < 1 THEN 'wrong' ELSE md5('pw:u' || user_id) END AS pw,
               CASE event_type WHEN 'view' THEN 'take' WHEN 'click' THEN 'place' WHEN 'signup' THEN 'list'
                               WHEN 'purchase' THEN 'claim' WHEN 'error' THEN 'leave' END AS kind,
               CASE WHEN value < 25 THEN 'deck' ELSE 'table' END AS source,
               (event_id % 11)::INT AS number
        FROM events""",
    "moves": """
        SELECT 'u' || user_id AS username, ts, event_id,
               CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS delta,
               event_type = 'purchase' AS fresh
        FROM events""",
    "order_cards": """
        SELECT attempt_id, pos, id, rank,
               CASE WHEN rank >= 13 THEN 'blue'
                    ELSE ['green','yellow','red','purple'][l_suppkey % 4 + 1] END AS color
        FROM (SELECT l_orderkey AS attempt_id, l_partkey AS id, l_suppkey,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                        l_extendedprice, l_shipdate)::INT AS pos,
                     (CASE WHEN l_quantity::INT % 5 = 0 THEN 13 WHEN l_quantity::INT = 49 THEN 14
                           ELSE 1 + l_partkey % 3 END)::INT AS rank
              FROM lineitem)""",
    "claim_sizes": "SELECT phase, max(n) AS n FROM rules GROUP BY phase",
    # one row per user: account, seat, table and hand
    "accounts": """
        SELECT u.username, u.u_password, p.game_id, p.next_player, g.game_phase, g.card_on_table,
               t.current_player, t.players_in_game, coalesce(h.hand_size, 0) AS hand_size
        FROM users u
        LEFT JOIN players p ON p.username = u.username
        LEFT JOIN games g ON g.game_id = p.game_id
        LEFT JOIN (SELECT game_id, count(*) AS players_in_game, max(current_player) AS current_player
                   FROM players LEFT JOIN turns ON username = current_player GROUP BY game_id) t
               ON t.game_id = p.game_id
        LEFT JOIN (SELECT username, count(*) AS hand_size FROM hands GROUP BY username) h
               ON h.username = p.username""",
    # verdict per claim for a given phase column; used through a `claims(attempt_id, phase)` view
    "claim_rows": """
        SELECT c.attempt_id, c.phase, r.pos, r.n, r.kind, r.step, r.message, k.id, k.rank, k.color,
               max(CASE WHEN r.pos = r.block_start THEN k.rank END)
                 OVER (PARTITION BY c.attempt_id, r.block_no) AS base_rank,
               max(CASE WHEN r.pos = r.block_start THEN k.color END)
                 OVER (PARTITION BY c.attempt_id, r.block_no) AS base_color,
               r.pos = r.block_start AS is_base
        FROM claims c JOIN rules r ON r.phase = c.phase
        LEFT JOIN claim_cards k ON k.attempt_id = c.attempt_id AND k.pos = r.pos""",
    "verdicts": """
        SELECT attempt_id, phase::INT AS phase, count(DISTINCT id) AS distinct_cards,
               (CASE WHEN count(DISTINCT id) <> max(n) THEN 0 ELSE min(CASE WHEN bad THEN pos END) END)::INT AS fail_pos,
               CASE WHEN count(DISTINCT id) <> max(n) THEN 'Something wrong with your cards'
                    ELSE coalesce(arg_min(message, pos) FILTER (WHERE bad), 'You get points!') END AS message
        FROM (SELECT *, CASE WHEN is_base AND kind = 'color' THEN color = 'blue'
                             WHEN is_base THEN rank > 12
                             WHEN kind = 'color' THEN color <> base_color AND rank <> 13
                             ELSE rank <> base_rank + step AND rank <> 13 END AS bad
              FROM claim_rows)
        GROUP BY attempt_id, phase""",
}

_WORD = re.compile(r"[A-Za-z_]+")


def with_views(sql: str, **extra: str) -> str:
    """Prepend the views `sql` names (and those they name); `extra` adds its own."""
    views = {**VIEWS, **extra}
    ordered: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        words = set(_WORD.findall(text))
        for name in views:
            if name in words and name not in ordered and name not in seen:
                need(views[name], (*seen, name))
                ordered.append(name)

    need(sql, ())
    if not ordered:
        return sql
    body = ",\n".join(f"{name} AS ({views[name]})" for name in ordered)
    return f"WITH {body}\n{sql}"
