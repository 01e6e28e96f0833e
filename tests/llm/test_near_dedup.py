from __future__ import annotations

import math
import random

import pytest

import textloom.llm.near_dedup as near_dedup_module
from textloom.llm.near_dedup import IDF_RANGE, near_dedup

from .helpers import documents, words


def brute(rows, low=0.8):
    """Classes by weighted Jaccard of all pairs."""
    grams, df = {}, {}
    for i, t, _ in rows:
        w = (t or "").split()
        own: dict = {}
        for k in range(max(1, len(w) - 4) if w else 0):
            g = tuple(w[k : k + 5])
            own[g] = own.get(g, 0) + 1
        grams[i] = own
        for g in own:
            df[g] = df.get(g, 0) + 1
    n = len(rows)
    weight = {g: 1 + IDF_RANGE * math.log1p(n / d) / math.log1p(n) for g, d in df.items()}
    parent = {i: i for i in grams}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    text = {i: t or "" for i, t, _ in rows}
    for a in grams:
        for b in grams:
            if a < b:
                x, y = grams[a], grams[b]
                both = sum(min(x[g], y[g]) * weight[g] for g in x.keys() & y.keys())
                every = sum(c * weight[g] for g, c in x.items()) + sum(c * weight[g] for g, c in y.items()) - both
                if text[a] == text[b] or (every and both / every >= low):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: root(i) for i in grams}


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([3, 8, 40, 120]), 5000).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy), "s"))
            i += 1
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, words(rng, 30000, 10**6), None), (904, "one two", "s"), (905, "one\ttwo", "s")]
    got = {r["doc_id"]: r for r in near_dedup(documents(spark, rows)).collect()}
    want, low, high = brute(rows), brute(rows, 0.81), brute(rows, 0.79)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["class_id"] == want[i] or low[i] != high[i]
        assert r["kept"] == (r["class_id"] == i)


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    base = words(rng, 150, 5000).split()
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 300):
        copy = list(base)
        copy[rng.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(copy), "s"))
    assert {r["class_id"] for r in near_dedup(documents(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("block", [400, 40])
def test_group_held_together_by_a_document_in_its_middle(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup_module, "BLOCK", block, raising=False)
    rng = random.Random(9)
    base = words(rng, 200, 5000).split()
    rows = [(150, " ".join(base), "s")]
    for i in [*range(150), *range(151, 301)]:
        copy = list(base)
        for k in rng.sample(range(5, 195, 6), 3):
            copy[k] = f"new{i}x{k}"
        rows.append((i, " ".join(copy), "s"))
    assert set(brute(rows).values()) == {0}
    assert len(set(brute([r for r in rows if r[0] != 150]).values())) > 100
    assert {r["class_id"] for r in near_dedup(documents(spark, rows)).collect()} == {0}


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s")]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in near_dedup(documents(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True)]
    assert near_dedup(documents(spark, [])).count() == 0
