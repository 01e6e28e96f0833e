from __future__ import annotations

import hashlib
import random

import numpy as np

from textloom.llm.suffix_dedup import LENGTH, sort_suffixes, suffix_dedup

from .helpers import documents, words


def test_two_stage_sorting():
    rng = random.Random(1)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 70))) for _ in range(rng.randint(1, 10))]
        text = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int64) + 1, 0) for x in parts])
        order = sort_suffixes(text, LENGTH)
        assert sorted(order.tolist()) == list(range(len(text)))
        keys = []
        for i in order.tolist():
            key = text[i : i + LENGTH].tolist()
            keys.append(key[: key.index(0) + 1] if 0 in key else key)
        assert keys == sorted(keys)


def brute(rows):
    least: dict[bytes, float] = {}
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t, _ in rows]
    for i, b in data:
        for s in range(len(b) - LENGTH + 1):
            k = b[s : s + LENGTH]
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, _, _), (n, b) in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - LENGTH + 1):
            if least[b[s : s + LENGTH]] < n:
                gone[s : s + LENGTH] = True
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = []
    for i in range(80):
        text = words(rng, rng.randrange(40))
        if i % 3 == 0:
            k = rng.randrange(100)
            text += passage[k : k + rng.randrange(30, 120)] + words(rng, 5)
        rows.append((i * 3 % 83, text, "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, "é" * 200, "s"), (203, "xé" + "é" * 120, "s"), (204, "a" * 300, None), (205, "a" * 49, "s"), (206, "b" + "a" * 51, "s")]
    rows += [(207, rows[0][1], "s"), (None, passage, "s"), (3, passage + "!", "s"), (300, "x" * 99 + passage * 40, "s"), (301, "\x00" * 60, "s"), (302, "\x00" * 55, "s")]
    got = sorted((tuple(r) for r in suffix_dedup(documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert suffix_dedup(documents(spark, [])).count() == 0
