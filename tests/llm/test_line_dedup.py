from __future__ import annotations

import random
import re

from textloom.llm import common
from textloom.llm.line_dedup import line_dedup

from .helpers import documents


def brute(rows, w=3):
    seen, out = set(), {}
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        real = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for n in range(1, w + 1):
            for p in range(len(real) - n + 1):
                run = tuple(lines[k] for k in real[p : p + n])
                if n < w and sum(len(re.findall(r"[^ \t\n\x0b\x0c\r]+", x)) for x in run) <= 50:
                    continue
                if run in seen:
                    gone.update(real[p : p + n])
                seen.add(run)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        lines = [f"line {rng.randrange(9)}" if rng.random() < 0.9 else rng.choice(["", "  "]) for _ in range(rng.randrange(0, 25))]
        rows.append((i, "\n".join(lines), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "\n\n\n", "s"), (503, "\n".join(f"u {k % 700}" for k in range(5000)), "s"), (504, "same\n" * 40, None)]
    docs = documents(spark, rows)
    want = brute(rows)
    out = line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert got == want
    left = {r["doc_id"] for r in line_dedup(docs, emptied=False).collect()}
    assert left == {i for i, (t, _, n) in want.items() if not n or (t or "").strip()}


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a\nb\nc", "s")] * 2 + [(None, "a\nb\nc\nd", "s")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup(documents(spark, rows)).collect())
    assert got == [(0, "a\nb\nc\nd"), (1, ""), (1, "")]
    assert line_dedup(documents(spark, [])).count() == 0


def test_long_passages_on_one_or_two_lines(spark):
    rng = random.Random(14)
    long = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 30, 50, 51, 300]))) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice(long) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(lines), "s"))
    docs = documents(spark, rows)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(docs).collect()}
    want = brute(rows)
    assert got == want
    for n, gone in ((50, 0), (51, 1)):
        text = " ".join(f"v{k}" for k in range(n))
        twice = {r["doc_id"]: r["n_removed"] for r in line_dedup(documents(spark, [(1, text, "s"), (2, text, "s")])).collect()}
        assert twice == {1: 0, 2: gone}


def test_hot_lines_are_joined_as_others(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(i, "\n".join([*(f"l{rng.randrange(30)}" for _ in range(5)), "same a", "same b", "same c"]), "s") for i in range(200)]
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(documents(spark, rows)).collect()}
    assert got == brute(rows)
