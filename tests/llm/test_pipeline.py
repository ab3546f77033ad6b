"""The pipeline's stages on the small tables, against plain versions of what each decides."""

from __future__ import annotations

import corpus_pipeline
from tablestakes.llm.common import cut, table

from . import brute


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        seen[name] = (before, docs)
        assert name == "byte_bpe" or docs.columns == columns
    before, after = seen["language_id"]
    assert {i for i, t in pairs(before) if (t or "").strip()} >= {i for i, _ in pairs(after)} and after.count() >= 0.97 * before.count()
    before, after = seen["line_dedup"]
    words = {i for i, t in pairs(after) if (t or "").split()}
    gone = {i: t for i, t in pairs(before) if i not in words and (t or "").split()}
    assert not gone.keys() & {i for i, _ in pairs(after)}
    kept = {line for i, t in pairs(before) if i not in gone for line in t.split("\n")}
    assert gone and all(line in kept for t in gone.values() for line in t.split("\n") if len(line) >= 50)
    before, after = seen["ngram_jaccard"]
    assert {i for i, _ in pairs(after)} == {c for *_, c in brute.components(pairs(before))}
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {i for i, _ in pairs(after)} == {r[0] for r in brute.decontaminate(pairs(before), items) if not r[-1]}
    before, after = seen["byte_bpe"]
    assert sorted(tuple(r) for r in after.collect()) == sorted(brute.bpe(pairs(before)))
