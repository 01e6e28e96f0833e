from __future__ import annotations

import random
import re

import numpy as np

from textloom.llm.mixing import mix, mixed_documents, splitting_tree, water_fill

from .helpers import documents, words


def test_water_fill():
    assert water_fill([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    out = water_fill([100, 1, 1], [1, 2, 3])
    assert out[1:] == [3.0, 3.0] and abs(sum(out) - 102) < 1e-9
    assert water_fill([], []) == [] and water_fill([0, 0], [1, 2]) == [0.0, 0.0]


def test_splitting_tree_keeps_quotas():
    out = splitting_tree(np.array([17, 0, 230]), 7, np.random.default_rng(0))
    assert out.sum(0).tolist() == [17, 0, 230] and (out >= 0).all()
    assert abs(out.sum(1) - 247 / 7).max() < 4


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 80)), f"s{i % 4}" if i % 9 else "s0") for i in range(400)]
    rows += [(900, None, "s1"), (901, "", None), (902, "a b c", None), (903, "z " * 20000, "s2"), (3, "again again", "s3")]
    docs = documents(spark, rows)
    got = mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(3)).collect()))
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(s for s in size if s) + [None]
    target = dict(zip(order, water_fill([size[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == sum(d["words"] for d in r["draws"])
    for s in order:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 1


def test_mixed_documents_hold_the_words_taken(spark):
    rng = random.Random(3)
    docs = documents(spark, [(i, "  " + words(rng, 30) + "\n x", f"s{i % 3}") for i in range(50)])
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    want: dict = {}
    for r in mix(docs).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert got == want


def test_rows_without_or_with_repeated_doc_ids_hold_the_words_taken(spark):
    rng = random.Random(5)
    rows = [(None if i % 2 else i // 8, words(rng, rng.randrange(1, 60)), f"s{i % 3}" if i % 7 else None) for i in range(90)]
    docs = documents(spark, rows + rows[:5])
    got, want = {}, {}
    for r in mixed_documents(docs).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    for r in mix(docs).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert got == want


def test_empty(spark):
    assert mix(documents(spark, [])).count() == 0 and mixed_documents(documents(spark, [])).count() == 0
