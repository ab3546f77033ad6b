"""Hand-made game tables for tests."""

from datetime import datetime

from tablestakes.sources.catalog import card_catalog
from tablestakes.sources.schema import GAME_TABLES

NOW = datetime(2024, 1, 31)


def literal(value):
    if value is None:
        return "NULL"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value}'"
    return f"'{value}'" if isinstance(value, str) else str(value)


def frame(spark, rows, ddl):
    """Inline table: Spark knows how small it is and joins it without shuffles."""
    fields = [f.replace(" NOT NULL", "").split() for f in ddl.split(",")]
    if not rows:
        return spark.createDataFrame([], ", ".join(" ".join(f) for f in fields))
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(n for n, _ in fields)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in fields)} FROM VALUES {values} AS t({names})")


def build(spark, games, hands, users=(), turns=None, activity=None):
    """games: {game_id: dict(ring=[(name, next)], table=card|None, phase=n, wants=n)};
    hands: {name: [card ids]}. Every seat gets an account with password 'pw-<name>'."""
    activity = activity or {}
    rows = {k: [] for k in GAME_TABLES}
    for gid, g in games.items():
        rows["games"].append((gid, g.get("table"), g.get("phase", 1)))
        for name, nxt in g["ring"]:
            rows["players"].append((name, g.get("points", {}).get(name, 0), nxt, gid))
            rows["users"].append((name, f"pw-{name}", activity.get(name, NOW), g.get("wants", 2)))
        for n in range(108):
            cid = 10 * (n // 2 + 1) + n % 2 if n < 96 else 490 + n - 96 if n < 104 else 530 + n - 104
            rows["cards"].append((gid * 1000 + cid, cid))
            rows["decks"].append((gid * 1000 + cid, gid))
    rows["users"] += [(u, f"pw-{u}", activity.get(u, NOW), 2) for u in users]
    rows["hands"] = [(c, name) for name, cs in hands.items() for c in cs]
    rows["turns"] = [(t,) for t in (turns or [])]
    state = {
        name: frame(spark, rows[name], ddl)
        for name, ddl in GAME_TABLES.items()
        if name != "card_type"
    }
    state["card_type"] = card_catalog(spark)
    return state


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()} if len(cols) != 1 else {r[0] for r in df.select(*cols).collect()}


def as_map(df, key, value):
    return {r[0]: r[1] for r in df.select(key, value).collect()}
