from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from textloom.llm.toxicity import marginals, toxicity

from .helpers import documents, words


def test_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    emission, trans = rng.standard_normal(7), np.exp(rng.standard_normal((2, 2)))
    ends = np.array([0, 0, 1, 1, 0, 0, 1], bool)
    p, pair = marginals(emission, ends, trans)
    total, one, two = 0.0, np.zeros(7), np.zeros(7)
    for path in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(e for e, s in zip(emission, path, strict=True) if s))
        for k in range(6):
            if not ends[k]:
                w *= trans[path[k], path[k + 1]]
        total += w
        for k in range(7):
            one[k] += w * path[k]
            two[k] += w * (k < 6 and not ends[k] and path[k] * path[k + 1])
    assert np.allclose(p, one / total) and np.allclose(pair, two / total)


def corpus():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text = words(rng, rng.randrange(20, 120)).split()
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Vile,", "rotten", f"scumm{rng.randrange(999)}"]))
        rows.append((i, ". ".join(" ".join(text[k : k + 12]) for k in range(0, len(text), 12)) + ".", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(5000, None, "s"), (5001, "", None), (None, "rotten vile", "s"), (5002, "fine words " * 20000, "s"), (3, "again", "s")]
    kinds = "doc_id long, quality int, toxic int"
    table = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (8, 1, None)], kinds)
    docs = documents(spark, rows + odd)
    out = toxicity(docs, table).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {i: t for i, _, t in labels}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    text = {i: t for i, t, _ in rows}
    for r in out:
        if r["doc_id"] in text and r["predicted"] and r["doc_id"] != 3:
            assert any(w in text[r["doc_id"]][a:b].lower() for a, b in zip(r["span_starts"], r["span_ends"], strict=True) for w in ("vile", "rotten", "scumm"))


def test_no_labels_and_empty(spark):
    kinds = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], kinds)
    assert [r["score"] for r in toxicity(documents(spark, [(1, "a", "s")]), none).collect()] == [0.0]
    assert toxicity(documents(spark, []), none).count() == 0
