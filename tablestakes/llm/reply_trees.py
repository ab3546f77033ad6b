"""Chat formatting of reply trees, by DataFrame functions alone.

Messages that answer one another form trees. Paths from roots to leaves are found by
iterative self-joins that double their reach: after k rounds a message knows the ancestor
2^k above it and the score of the way there, so a thread of n messages takes log2(n)
rounds and no task ever walks one. Leaves climb these jumps, longest first, and learn the
length and score of their branch; the best branches of each tree are chosen; and only
these are spelt out again, each jump splitting a stretch of the path in two.

Every chosen path becomes one conversation in a template of control strings. Texts are
joined in pieces of a path first and pieces after that, so the rows of a very long thread
meet in many tasks and only its finished text in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablestakes.operators.numbering import numbered

from .common import cut, drop

# The template (fixed values): <|im_start|>role\ntext<|im_end|>\n
START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
# Turns of one piece of a path.
PIECE = 64
# A control string opens with "<|"; in a text every "<", backslashes, "|" gets one backslash more.
OPENING, ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, OPENING, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "<$1|")


def sequence(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seq, turn, role, text: rows of each conversation numbered by turn.

    Turns that are null come first; rows of one turn stand by role, then text (nulls
    first), so equal rows may change places unseen. Long conversations are numbered in
    slices of turns.
    """
    picked = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    # Null turns take the lowest slice.
    block = F.coalesce(F.expr("turn div 1024"), F.lit(-(1 << 62)))
    return numbered(picked, ["conv_id"], ["turn", "role", "text"], "seq", block).select("conv_id", F.col("seq").cast("long").alias("seq"), "turn", "role", "text")


def as_messages(rows: DataFrame) -> DataFrame:
    """Messages of conversations that have turns: each answers the one before it.

    Takes what `sequence` gives. Keys are texts, so a null conv_id is a tree like others.
    """
    key = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n)
    return rows.select(
        F.col("conv_id").alias("tree_id"),
        key(F.col("seq")).alias("message_id"),
        F.when(F.col("seq") > 1, key(F.col("seq") - 1)).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (node, up, gain) of the ancestor 1, 2, 4, ... above, and the nodes below or on a circle.

    gain is the score from the node up to, not including, that ancestor. A round joins a
    table with itself on the ancestor; many messages below one ancestor are one hot key,
    which Spark splits as a skewed join. Each table is written once.
    """
    known = nodes.select(F.col("node").alias("up"))
    level = cut(nodes.where("up IS NOT NULL").join(known, "up", "left_semi").select("node", "up", F.col("score").alias("gain")))
    levels, most = [], nodes.count()
    while not level.isEmpty():
        if 1 << len(levels) > most:
            return levels, level.select("node")
        levels.append(level)
        above = level.select(F.col("node").alias("up"), F.col("up").alias("over"), F.col("gain").alias("more"))
        level = cut(level.join(above, "up").select("node", F.col("over").alias("up"), (F.col("gain") + F.col("more")).alias("gain")))
    drop(level)
    return levels, None


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, path_id, rank, message_id, depth: the messages of each tree's best branches.

    `messages` has tree_id, message_id, parent_id and score. A message whose parent is
    null or unknown is a root; one that nobody answers is a leaf; path_id is the leaf's
    id. A branch's score is the sum over its messages (null counts 0); ties go to the
    longer branch, then to the smaller leaf id. Rows that share a message_id are one
    message, with the least tree_id, parent_id and score among them; rows without
    message_id are left out, and so is all that hangs below a circle of answers.
    """
    nodes = cut(
        messages.where("message_id IS NOT NULL")
        .groupBy(F.col("message_id").alias("node"))
        .agg(F.min("tree_id").alias("tree_id"), F.min("parent_id").alias("up"), F.min(F.coalesce("score", F.lit(0.0))).alias("score"))
    )
    levels, circling = _jumps(nodes)
    answered = nodes.select(F.col("up").alias("node")).where("node IS NOT NULL").distinct()
    leaves = nodes.join(answered, "node", "left_anti")
    if circling is not None:
        leaves = leaves.join(circling, "node", "left_anti")
    climbed = leaves.select("tree_id", F.col("node").alias("path_id"), F.col("node").alias("at"), F.lit(0.0).alias("gained"), F.lit(0).cast("long").alias("edges"))
    for k, level in reversed(list(enumerate(levels))):
        climbed = climbed.join(level.withColumnRenamed("node", "at"), "at", "left").select(
            "tree_id", "path_id", F.coalesce("up", "at").alias("at"),
            (F.col("gained") + F.coalesce("gain", F.lit(0.0))).alias("gained"),
            (F.col("edges") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("edges"),
        )
    roots = nodes.select(F.col("node").alias("at"), F.col("score").alias("own"))
    scored = climbed.join(roots, "at").select("tree_id", "path_id", "edges", (F.col("gained") + F.col("own")).alias("branch"))
    order = W.partitionBy("tree_id").orderBy(F.desc("branch"), F.desc("edges"), "path_id")
    # The limit on the rank is applied before rows are shuffled too, so a tree sends few leaves.
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).drop("branch")
    spelt = chosen.select("tree_id", "path_id", "rank", F.col("path_id").alias("message_id"), F.col("edges").alias("depth"))
    for k, level in reversed(list(enumerate(levels))):
        here, there = F.struct("message_id", "depth"), F.struct(F.col("up").alias("message_id"), (F.col("depth") - (1 << k)).alias("depth"))
        spelt = (
            spelt.join(level.select(F.col("node").alias("message_id"), "up"), "message_id", "left")
            .select("tree_id", "path_id", "rank", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("m"))
            .select("tree_id", "path_id", "rank", "m.message_id", "m.depth")
        )
    return spelt


def format_paths(paths: DataFrame, messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """tree_id, path_id, rank, formatted, loss of every path.

    formatted holds all turns in the template; loss the byte ranges (start, length) of it
    that a model is trained on: the texts of role `assistant`, one range per turn, in
    order. Roles are percent-encoded, texts escaped, so `read_back` gives both again
    whatever control strings they hold. Null roles and texts are empty. Rows that share a
    message_id follow each other by role, then text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(START), F.url_encode(role), F.lit("\n")), escape(text)
    turns = (
        paths.join(messages.select("message_id", role.alias("role"), text.alias("text")), "message_id")
        .select(
            "tree_id", "path_id", "rank", F.expr(f"depth div {piece}").alias("piece"),
            F.struct(
                "depth", "role", "text", head.alias("head"), body.alias("body"),
                (F.octet_length(head) + F.octet_length(body) + len(END) + 1).alias("bytes"),
            ).alias("t"),
        )
    )
    key = ["tree_id", "path_id", "rank"]
    before = lambda rows, i: F.aggregate(F.slice(rows, F.lit(1), i), F.lit(0), lambda n, r: n + r["bytes"])
    pieces = turns.groupBy(*key, "piece").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        *key,
        F.struct(
            "piece",
            F.array_join(F.transform("t", lambda r: F.concat(r["head"], r["body"], F.lit(END + "\n"))), "").alias("formatted"),
            F.aggregate("t", F.lit(0), lambda n, r: n + r["bytes"]).alias("bytes"),
            F.transform(
                F.filter(
                    F.transform("t", lambda r, i: F.struct((r["role"] == LEARNT).alias("learnt"), (before(F.col("t"), i) + F.octet_length(r["head"])).alias("start"), F.octet_length(r["body"]).alias("length"))),
                    lambda s: s["learnt"],
                ),
                lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")),
            ).alias("loss"),
        ).alias("p"),
    )
    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["length"].alias("length")))
    return pieces.groupBy(*key).agg(F.sort_array(F.collect_list("p")).alias("p")).select(
        *key,
        F.array_join(F.transform("p", lambda r: r["formatted"]), "").alias("formatted"),
        F.flatten(F.flatten(F.transform("p", lambda r, i: F.transform(F.array(before(F.col("p"), i)), lambda by: moved(r["loss"], by))))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, r"<\|im_end\|>\n")  # the last one is what follows the last turn: nothing
    inner = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s)))
    return F.transform(
        inner,
        lambda s: F.struct(
            F.url_decode(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substring(s, F.instr(s, F.lit("\n")) + 1, F.length(s))).alias("text"),
        ),
    )


def learnt_text(formatted: Column, loss: Column) -> Column:
    """All text in the byte ranges of `loss`, unescaped, one after the other."""
    cut_out = lambda raw: F.array_join(F.transform(loss, lambda s: unescape(F.decode(F.substring(raw, s["start"] + 1, s["length"]), "UTF-8"))), "")
    return F.element_at(F.transform(F.array(F.encode(formatted, "UTF-8")), cut_out), 1)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of conversations given as rows conv_id, turn, role, text.

    A conversation is a tree of one branch. Order, nulls and ties as in `sequence`; a
    null conv_id is one conversation. No rows give no conversations. Other columns are
    not read.
    """
    messages = cut(as_messages(sequence(rows)))
    return format_paths(best_paths(messages), messages).select(F.col("tree_id").alias("conv_id"), "formatted", "loss")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    digest = lambda c: F.sha2(c, 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        format_conversations(rows)
        .select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), learnt_text(F.col("formatted"), F.col("loss")).alias("learnt"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            digest(told).alias("turns_sha256"),
            F.char_length("learnt").cast("long").alias("loss_chars"),
            digest(F.col("learnt")).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
