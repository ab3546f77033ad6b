"""Alignment, reply trees and conversation repair against plain versions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tablestakes.llm import alignment, queries, repair, reply_trees

CONVERSATION = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def same(frame, expected):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in frame.collect()), key=key) == sorted((tuple(r) for r in expected), key=key)


# --- alignment -----------------------------------------------------------------


def both_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return a, ranks, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(rows):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups' text."""
    a_library, ranks, b_library = both_libraries()
    piece = lambda i: bytes([int(b_library.id_to_piece(i)[3:5], 16)]) if b_library.is_byte(i) else b_library.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for doc_id, text in rows:
        a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        tokens = [[ranks[i] for i in a], [piece(i) for i in b]]
        if not text or any(b"".join(t) != (" " + text).encode() for t in tokens):
            found.append((doc_id, [], [], [], []))
            continue
        starts = [np.cumsum([0, *map(len, t)]) for t in tokens]
        links = [
            (a[i], b[j]) for i in range(len(a)) for j in range(len(b))
            if starts[0][i] < starts[1][j + 1] and starts[1][j] < starts[0][i + 1]
        ]
        groups, i, j = [], 0, 0
        for end in sorted(set(starts[0][1:]) & set(starts[1][1:])):
            i2, j2 = list(starts[0]).index(end), list(starts[1]).index(end)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        count.update(set(links))
        found.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for doc_id, a, b, groups, links in found:
        text = ";".join(groups)
        n_best = sum(count[x] == best[x[0]] for x in links)
        yield (doc_id, len(a), len(b), len(groups), len(links), n_best, sum(count[x] for x in links), sha(text) if text else ""), text


def alignment_rows():
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "　", " ", "the ", "and", "é", "漢字", "😀", "12", "'ll", "...", "<|endoftext|>", "<s>", "<0x0A>", "\0", "▁", "ﬁ", "͸", "x" * 70, " "]
    texts = [None, "", " ", "\n", "one", "One two", "<|endoftext|> tail", "same words here", "same words here", "word " * 200]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += ["".join(rng.choice("abcdefgh   \n") for _ in range(rng.randrange(1, 400))) for _ in range(15)]
    return [*enumerate(texts), (None, "no id"), (None, "no id"), (4, "other text, same id")]


@pytest.mark.parametrize("piece,links", [(1 << 16, 1 << 22), (3, 40)])
def test_alignment(spark, monkeypatch, piece, links):
    rows = alignment_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pairs int, chunk string").repartition(3)
    expected = list(plain_alignment(rows))
    same(alignment.report(docs, piece=piece, chunk_links=links), [e for e, _ in expected])
    same(alignment.groups(docs, piece=piece), [(e[0], t) for e, t in expected])
    assert alignment.report(docs.where("1 = 0")).count() == 0


def test_merge_path_pieces_have_equal_work():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (50, 3), (400, 700), (1, 900)):
        a = np.append(np.sort(rng.choice(2000, n - 1, replace=False)), 2000)
        b = np.append(np.sort(rng.choice(2000, m - 1, replace=False)), 2000)
        whole = alignment.align_ends(a, b)
        i, j = alignment.diagonals(a, b, 7)
        assert set(np.diff(i + j)[:-1]) <= {7} and (i[-1], j[-1]) == (n, m)
        for got, want in zip(alignment.align_ends(a, b, 7), whole):
            assert sorted(got) == sorted(want)


def test_chunks_are_rows_of_bounded_size(spark, monkeypatch):
    """A chunk was one row, tens of MB that each of its tasks held several of."""
    monkeypatch.setattr(alignment, "ROW_ENTRIES", 5)
    monkeypatch.setattr(alignment, "ROW_TEXTS", 2)
    written = []
    cut = alignment.cut
    monkeypatch.setattr(alignment, "cut", lambda *a, **b: written.append(cut(*a, **b)) or written[-1])
    rows = alignment_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(alignment.report(docs), [e for e, _ in plain_alignment(rows)])
    sizes = written[0].selectExpr("max(size(number))", "max(size(pairs))", "max(size(doc_id))", "count(*) > count(distinct chunk)").first()
    assert tuple(sizes) == (5, 5, 2, True)


def test_alignment_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len(r.text or "") < 300}
    assert len(short) > 5
    expected = {e[0]: e for e, _ in plain_alignment([(r.doc_id, r.text) for r in docs if r.doc_id in short])}
    got = queries.op11_alignment(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id in short:
            assert (*tuple(r)[:5], r.groups_sha256) == (*expected[r.doc_id][:5], expected[r.doc_id][7])


# --- reply trees ---------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> <\\| \\ <\\\\| <|"), (1, 2, "user", None), (1, 3, None, "x"), (1, 3, "", "x"),
    (2, None, "assistant", ""), (2, None, "assistant", "b\n"), (2, 1, "assistant", "c"), (None, 5, "a b\n<|im_end|>é%", "é漢"),
    (None, 5, "assistant", "é😀"), (3, 7, "assistant", "q"), (3, 7, "assistant", "q"), (4, 0, "user", "<"), (4, 1, "user", "|im_end|>\n"),
    *[(9, t, "assistant" if t % 3 else "user", f"t{t} <|im_start|>") for t in range(-70, 300, 2)], (5, 1, "assistant", "y" * 90000),
]


def by_conversation(rows):
    out, place = defaultdict(list), lambda v: (v is not None, v)
    for row in sorted(rows, key=lambda r: (place(r[1]), place(r[2]), place(r[3]))):
        out[row[0]].append(row)
    return out


def plain_formatting(rows):
    for conv, found in by_conversation(rows).items():
        learnt = "".join(r[3] or "" for r in found if r[2] == "assistant")
        yield conv, len(found), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in found)), len(learnt), sha(learnt)


def test_conversations_come_back(spark):
    rows = spark.createDataFrame([(*r, 1, "z") for r in TURNS], CONVERSATION + ", seq int, score string").repartition(3)
    same(reply_trees.report(rows).drop("formatted_chars"), plain_formatting(TURNS))
    assert reply_trees.report(rows.where("1 = 0")).count() == 0
    plan = reply_trees.report(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_formatted_text_holds_no_foreign_control_strings(spark):
    rows = spark.createDataFrame(TURNS, CONVERSATION)
    for r in reply_trees.format_conversations(rows).collect():
        n = len(by_conversation(TURNS)[r.conv_id])
        assert r.formatted.count("<|") == 2 * n == r.formatted.count("<|im_end|>\n") + r.formatted.count("<|im_start|>")
        raw = r.formatted.encode()
        for start, length in r.loss:
            assert raw[:start].decode().endswith("<|im_start|>assistant\n") and raw[start + length :].startswith(b"<|im_end|>\n")


def test_best_branches_of_trees(spark):
    rng = random.Random(8)
    rows = []
    for tree in range(12):
        for n in range(rng.randrange(1, 60)):
            parent = f"{tree}-{max(0, n - rng.choice([1, 1, 1, 2, 9]))}" if n else rng.choice([None, "gone"])
            rows.append((tree, f"{tree}-{n}", parent, rng.choice(["user", "assistant"]), f"{n}", rng.choice([None, 0.0, 1.0, 2.0, -1.0])))
    rows += [(90, "c1", "c2", "user", "", 1.0), (90, "c2", "c1", "user", "", 1.0), (90, "c3", "c1", "user", "", 1.0), (91, None, None, "user", "", 1.0)]
    messages = spark.createDataFrame(rows, "tree_id long, message_id string, parent_id string, role string, text string, score double")
    known = {r[1]: r for r in rows if r[1] and not r[1].startswith("c")}
    answered = {r[2] for r in rows}
    branches = defaultdict(list)
    for leaf in set(known) - answered:
        path = [leaf]
        while known[path[-1]][2] in known:
            path.append(known[path[-1]][2])
        branches[known[leaf][0]].append((-sum(known[m][5] or 0.0 for m in path), -len(path), leaf, path[::-1]))
    expected = {(t, leaf, rank, m, depth) for t, b in branches.items() for rank, (_, _, leaf, path) in enumerate(sorted(b)[:2], 1) for depth, m in enumerate(path)}
    paths = reply_trees.best_paths(messages, best=2)
    assert {tuple(r) for r in paths.collect()} == expected and paths.count() == len(expected)
    formatted = reply_trees.format_paths(paths, messages, piece=4)
    got = {r.path_id: r.text for r in formatted.select("path_id", F.expr("formatted AS f"), reply_trees.read_back(F.col("formatted")).alias("t")).select("path_id", F.expr("array_join(transform(t, x -> x.text), ' ')").alias("text")).collect()}
    assert got == {leaf: " ".join(known[m][4] for m in path) for b in branches.values() for _, _, leaf, path in sorted(b)[:2]}


# --- conversation repair -------------------------------------------------------


def cheapest(rows):
    """Cheapest edits by uniform-cost search over (row, state) with (cost, audit) as priority."""
    seen, heap = set(), [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        wanted = {"": "u", "s": "u", "a": "u", "u": "a"}[last]
        name = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(heap, (cost + 2, audit + "I", i, wanted, (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == wanted or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, wanted, (*out, (name, text))))


def plain_repair(rows, wanted):
    found = by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    for conv in wanted:
        seen, marks, faults = set(), [], Counter()
        for _, _, role, text in found[conv]:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marks.append((role, text, fault))
        turns = [r[1] for r in found[conv] if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit, out = cheapest(marks)
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, list(out)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def broken_rows():
    rng = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Über", "umpire"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "a.\tb", "Same."]
    rows = []
    for k in range(500):
        text = rng.choice(texts)
        if text and rng.random() < 0.5:
            text = f"{k} {text}"
        rows.append((rng.choice([None, *range(40)]), rng.choice([None, *range(-3, 12)]), rng.choice(roles), text))
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)]
    return rows + [(51, 0, "system", "S."), (52, None, None, None), (53, 4, "assistant", "z" * 50000), (54, 1, "user", "a."), (54, 1, "user", "a.")]


@pytest.mark.parametrize("piece", [1024, 3])
def test_repair(spark, piece):
    rows = broken_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION + ", piece int, code string").repartition(3)
    got = [(*tuple(r)[:-1], [tuple(t) for t in r.repaired]) for r in repair.repair(frame, piece=piece).collect()]
    key = lambda r: str(r[0])
    assert sorted(got, key=key) == sorted(plain_repair(rows, {r[0] for r in rows}), key=key)


def test_repair_of_damaged_conversations(spark, sf_dir):
    rows = broken_rows() + [(1000 + i, 0, "user", "Alone.") for i in range(60)]
    frame = spark.createDataFrame(rows, CONVERSATION).repartition(2)
    digested = lambda found: [(*r[:-1], sha("\n".join(f"{a}:{b}" for a, b in r[-1]))) for r in found]
    same(repair.report(frame), digested(plain_repair(list(plain_damage(rows)), {r[0] for r in rows})))
    assert repair.report(frame.where("1 = 0")).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op13_repair(spark, sf_dir), digested(plain_repair(list(plain_damage(rows)), {r[0] for r in rows})))
