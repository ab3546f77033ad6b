"""Repair of broken conversations at least cost, by depth-first branch-and-bound.

Rows of a conversation are kept (K), given another role (R) or deleted (D), and empty
turns inserted (I), so that the initials of the roles read (s?(ua)+)?. A search node is a
row and a state of that grammar. The search keeps an explicit stack and takes edits in
ASCII order; suffix lower bounds (the least cost of the rows that follow, for each state,
whatever the audit) cut branches that cannot reach the incumbent (cost, audit); a table
per node holds the cheapest prefix that came by, and a later one that is not cheaper is
dominated: visits come in ASCII order, so it is the worse on equal cost. The search ends
when the stack is empty, which proves the incumbent.

Inserts belong to the row they precede. A long conversation is therefore cut into pieces:
each piece's least costs from state to state are a small matrix, the matrices of all
pieces give every piece the bounds of what follows, and pieces are searched by themselves,
once per state they may begin in. Only those results are chained.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .reply_trees import sequence

# Rows of one piece.
PIECE = 1024
# Costs of edits (fixed values); a truncated row that stays costs 1 more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# Grammar: nothing yet, after s, after u, after a. The first three but one and the last take a user turn next.
STATES = (0, 1, 2, 3)
FOLLOWS = (2, 2, 3, 2)  # state after a user turn, or an assistant turn from state 2
ACCEPTS = (True, False, False, True)
NEVER = 1 << 40
# Row codes: A + 4 * (0 sound, 1 truncated, 2 to be deleted) + place in INITIALS (3 is any other).
INITIALS = "sua"
WHITE = r"[\x20\x09-\x0D]"


def kept(state: int, initial: int) -> int | None:
    """State after a row that stays as it is; None if it cannot stand there."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def moves(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows taken, next state, cost) in ASCII order."""
    fault, initial = divmod(code, 4)
    out = [("D", 1, state, DELETE), ("I", 0, FOLLOWS[state], INSERT)]
    if fault < 2:
        after = kept(state, initial)
        if after is not None:
            out.append(("K", 1, after, fault * TRUNCATED))
        out.append(("R", 1, FOLLOWS[state], REROLE + fault * TRUNCATED))
    return out


MOVES = [[moves(code, state) for state in STATES] for code in range(12)]
# After the last row only inserts are left.
AT_END = [[("I", 0, FOLLOWS[state], INSERT)] for state in STATES]


def relaxed(values: list[int]) -> list[int]:
    """Costs of states, an insert allowed at any of them."""
    for _ in range(2):
        values = [min(v, INSERT + values[FOLLOWS[q]]) for q, v in enumerate(values)]
    return values


def closing() -> list[int]:
    """Least costs behind the last row."""
    return relaxed([0 if a else NEVER for a in ACCEPTS])


def suffix_bounds(codes: bytes, after: list[int]) -> list[list[int]]:
    """Least cost from before each row, for each state; `after` holds those behind the last row."""
    bounds = [after]
    for code in reversed(codes):
        behind = bounds[-1]
        bounds.append(relaxed([min(cost + behind[to] for _, rows, to, cost in MOVES[code][q] if rows) for q in STATES]))
    return bounds[::-1]


def matrix(codes: bytes) -> list[int]:
    """Least cost through a piece, from state to state, row by row."""
    ends = [suffix_bounds(codes, [0 if q == end else NEVER for q in STATES])[0] for end in STATES]
    return [ends[end][q] for q in STATES for end in STATES]


def search(codes: bytes, start: int, after: list[int], last: bool) -> tuple[int, str, int]:
    """(cost, audit, final state) of the cheapest edits of a piece, `after` counted in; on ties the ASCII-least audit.

    cost is what the edits of this piece cost. The last piece may end with inserts.
    """
    bounds, n = suffix_bounds(codes, after), len(codes)

    def options(i: int, q: int) -> list[tuple[str, int, int, int]]:
        return MOVES[codes[i]][q] if i < n else AT_END[q] if last else []

    def done(i: int, q: int) -> bool:
        return i == n and (ACCEPTS[q] or not last)

    # The first incumbent: one dive along the best bounds.
    i, q, cost, letters = 0, start, 0, []
    while not done(i, q):
        letter, rows, to, price = min(options(i, q), key=lambda m: m[3] + bounds[i + m[1]][m[2]])
        letters.append(letter)
        i, q, cost = i + rows, to, cost + price
    best = (cost + (0 if last else after[q]), "".join(letters), q, cost)

    audit: list[str] = []
    cheapest: dict[tuple[int, int], int] = {}
    stack = [(0, "", 0, start, 0)]
    while stack:
        depth, letter, i, q, cost = stack.pop()
        del audit[max(depth - 1, 0) :]
        if letter:
            audit.append(letter)
        least = cost + bounds[i][q]
        if least > best[0] or cheapest.get((i, q), NEVER) <= cost:
            continue
        cheapest[i, q] = cost
        if least == best[0] and audit and audit[-1] > best[1][depth - 1 : depth] and "".join(audit) > best[1][:depth]:
            continue
        if done(i, q) and (found := (cost + (0 if last else after[q]), "".join(audit))) < best[:2]:
            best = (*found, q, cost)
        for letter, rows, to, price in reversed(options(i, q)):
            stack.append((depth + 1, letter, i + rows, to, cost + price))
    return best[3], best[1], best[2]


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """Rows (role, text) of a piece after its edits."""
    out, rest = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter == "K":
            state = kept(state, (INITIALS + role[:1]).index(role[:1]) if role else 3)
        else:
            role = "assistant" if state == 2 else "user"
            state = FOLLOWS[state]
        out.append((role, text))
    return out


def illegal(codes: bytes) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = [c % 4 for c in codes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:]))


def _per_batch(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows made of rows, in Arrow batches."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for values in zip(*(batch.column(n).to_pylist() for n in names), strict=True) for row in make(*values)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def _letters(column: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", column))), lambda r: r[column]), "")


def _bytes(codes: str) -> bytes:
    return bytes(ord(c) - 65 for c in codes)


def marked(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows in order with piece, fault (blank, duplicate, truncated or null) and code.

    Takes key, turn, role, text without null roles and texts. A duplicate is
    found by the least seq of its (role, digest of the text), a small sum map-side.
    """
    numbered = cut(
        sequence(rows.select("key", "turn", "role", "text"), conv_id="key")
        .withColumnRenamed("conv_id", "key")
        .withColumn("digest", F.sha2("text", 256))
    )
    first = numbered.groupBy("key", "role", "digest").agg(F.min("seq").alias("first"))
    stripped = F.regexp_replace("text", f"{WHITE}+$", "")
    fault = (
        F.when(stripped == "", "blank").when(F.col("first") < F.col("seq"), "duplicate")
        .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    weight = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    place = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.length("role") > 0) & (place > 0), place - 1).otherwise(3)
    return (
        numbered.join(first, ["key", "role", "digest"])
        .withColumn("fault", fault)
        .withColumn("piece", F.expr(f"(seq - 1) div {piece}"))
        .withColumn("code", F.char(65 + 4 * weight + initial))
        .select("key", "seq", "piece", "turn", "role", "text", "fault", "code")
    )


def _searched(rows: DataFrame) -> DataFrame:
    """key, piece, audit, state, cost, illegal: every piece's part of its conversation's best edits."""
    pieces = rows.groupBy("key", "piece").agg(_letters("code").alias("codes"))
    costs = cut(
        _per_batch(
            pieces.select("key", "piece", "codes"), "key string, piece long, codes string, costs array<long>",
            lambda key, piece, codes: [dict(key=key, piece=piece, codes=codes, costs=matrix(_bytes(codes)))],
        )
    )

    def outlook(key: str, parts: list[dict]) -> Iterator[dict]:
        after, last = closing(), True
        for part in reversed(parts):
            yield dict(key=key, piece=part["piece"], after=after, last=last)
            m = part["costs"]
            after, last = relaxed([min(m[4 * q + e] + after[e] for e in STATES) for q in STATES]), False

    lists = costs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "costs"))).alias("parts"))
    bounds = _per_batch(lists, "key string, piece long, after array<long>, last boolean", outlook)

    def explore(key: str, piece: int, codes: str, after: list[int], last: bool) -> list[dict]:
        found = [search(_bytes(codes), q, after, last) for q in (STATES if piece else STATES[:1])]
        return [dict(
            key=key, piece=piece, costs=[f[0] for f in found], audits=[f[1] for f in found], ends=[f[2] for f in found],
            edge=codes[0] + codes[-1], illegal=illegal(_bytes(codes)),
        )]

    searched = cut(
        _per_batch(
            costs.join(bounds, ["key", "piece"]).select("key", "piece", "codes", "after", "last"),
            "key string, piece long, costs array<long>, audits array<string>, ends array<int>, edge string, illegal long",
            explore,
        )
    )

    def chained(key: str, parts: list[dict]) -> Iterator[dict]:
        state, edge = 0, ""
        for part in parts:
            yield dict(
                key=key, piece=part["piece"], state=state, cost=part["costs"][state],
                illegal=part["illegal"] + illegal(_bytes(edge + part["edge"][0])),
            )
            state, edge = part["ends"][state], part["edge"][1]

    chain = searched.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "costs", "ends", "edge", "illegal"))).alias("parts"))
    chosen = _per_batch(chain, "key string, piece long, state int, cost long, illegal long", chained)
    return searched.select("key", "piece", "audits").join(chosen, ["key", "piece"]).select(
        "key", "piece", F.col("audits")[F.col("state")].alias("audit"), "state", "cost", "illegal"
    )


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged conversations; `conversations` names those that lost all rows.

    By crc32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its
    . ! ? (2), stands twice (3) or gets the role user (4). Nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text, role = space("text"), space("role")
    return (
        rows.withColumn("kind", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20)
        .where("kind <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def repair(rows: DataFrame, conversations: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of every conversation.

    `rows` has conv_id, turn, role, text; other columns are not read. Rows stand by turn
    (nulls first), then role, then text; null roles and texts are one space, and a null
    conv_id is one conversation. Each row's first fault counts: blank, duplicate of an
    earlier row, truncated. gaps: maxTurn - minTurn + 1 - distinct turns, nulls ignored.
    repaired lists the (role, text) that are left. `conversations` (conv_id) are those to
    report, by default those of `rows`; those without rows have zeros, an empty audit and
    an empty list. Empty tables give no rows. Repeated rows are duplicates.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    asked = rows.select(
        key.alias("key"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    wanted = (rows if conversations is None else conversations).select("conv_id").distinct().withColumn("key", key)
    ordered = cut(marked(asked, piece))
    figures = ordered.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    texts = ordered.groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("rows"))

    def apply(key: str, piece: int, rows: list[dict], audit: str, state: int, cost: int, illegal: int) -> list[dict]:
        turns = edited([(r["role"], r["text"]) for r in rows], audit, state)
        return [dict(key=key, piece=piece, audit=audit, cost=cost, illegal=illegal, turns=[dict(role=r, text=t) for r, t in turns])]

    pieces = _per_batch(
        texts.join(_searched(ordered), ["key", "piece"]).select("key", "piece", "rows", "audit", "state", "cost", "illegal"),
        "key string, piece long, audit string, cost long, illegal long, turns array<struct<role:string,text:string>>",
        apply,
    )
    joined = pieces.groupBy("key").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.sort_array(F.collect_list(F.struct("piece", "audit", "turns"))).alias("p"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        wanted.join(figures, "key", "left").join(joined, "key", "left")
        .select(
            "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce(F.array_join(F.transform("p", lambda r: r["audit"]), ""), F.lit("")).alias("audit"),
            F.coalesce(F.flatten(F.transform("p", lambda r: r["turns"])), F.array().cast("array<struct<role:string,text:string>>")).alias("repaired"),
        )
    )


def report(rows: DataFrame) -> DataFrame:
    """The figures of `repair` for damaged conversations, with the digest of the repaired `role:text` lines."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair(damaged(rows), rows).withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
