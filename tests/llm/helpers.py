"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = DOCS + ", pack string, bucket string, _id string, n string, shard string, h string, a string"


def documents(spark, rows):
    """Documents of (doc_id, text, source), with further columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), "p", "b", "x", "n", "s", "h", "a") for i, t, s in rows]
    return spark.createDataFrame(full, CLASHING)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))
