from __future__ import annotations

import hashlib
import re

import numpy as np

from textloom.llm.exact_dedup import PerfectHash, exact_dedup

from .helpers import documents


def test_perfect_hash_gives_every_digest_its_slot_and_strangers_are_told_apart():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, (5000, 4)).astype(np.uint64)
    mph = PerfectHash.build(words)
    assert sorted(mph.slots(words).tolist()) == list(range(5000))
    table = np.empty_like(words)
    table[mph.slots(words)] = words
    other = rng.integers(0, 1 << 62, (5000, 4)).astype(np.uint64)
    at = mph.slots(other)
    assert not (table[at[at >= 0]] == other[at >= 0]).all(axis=1).any()


def test_against_brute_force(spark):
    rows = [(i, f"text {i % 7}\n  x", "s") for i in range(60)] + [(100, None, "s"), (101, "", None), (102, " ", "s"), (103, "\t\n", "s"), (5, "text 5\n  x", "s"), (104, "long " * 30000, "s"), (None, "text 1 x", "s"), (None, "alone", "s")]
    got = exact_dedup(documents(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
    for sha in by_sha:
        assert sum(r["kept"] for r in got if r["text_sha256"] == sha) == 1


def test_empty(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
