"""Line dedup (4): winnowing over line hashes, with DataFrame functions only.

A document is its sequence of nonblank lines. A run is MIN_LINES consecutive ones, or fewer that hold more than MOST_WORDS
words together. Of every run the smallest line hash (the leftmost of equals) is a fingerprint, so any run that two places
share has a fingerprint in common. Only fingerprints that occur more than once go on: with the lines around them they are
joined by position, each match is extended both ways over the runs that hold the fingerprint, and runs that touch chain
into longer ones. A run that occurred before, in an earlier document or earlier in the same one, is deleted; its first
occurrence stays.

So a line goes if and only if it lies in a run of consecutive nonblank lines that all occur in the same order at an
earlier place. Places are ordered by (doc_id, hash of the text, position).

Defined cases: a null text is null and has no lines; blank lines (only white space) are never fingerprints and never
deleted; documents without a run stay whole; rows with the same doc_id and text are one document and get the same result;
null doc_ids come first; further columns are carried along (but for n_lines and n_removed, which are made anew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_counted

#: Lines that a run must have, or else more words than this.
MIN_LINES, MOST_WORDS = 3, 50
_BLANK = r"^[\x20\x09-\x0D]*\z"
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: str) -> Column:
    """Of each nonblank line, in order: x, its xxhash64; p, which nonblank line it is; i, which line (both from 0); n, its
    words."""
    every = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.xxhash64(line).alias("x"), i.alias("i"), F.regexp_count(line, F.lit(_WORD)).alias("n"), line.rlike(_BLANK).alias("blank")))
    return F.transform(F.filter(every, lambda s: ~s["blank"]), lambda s, p: F.struct(s["x"].alias("x"), p.alias("p"), s["i"].alias("i"), s["n"].alias("n")))


def _runs(lines: Column, w: int) -> Column:
    """The runs of an array of lines: those of w lines, and shorter ones with more than MOST_WORDS words."""

    def of(k: int) -> Column:
        starts = F.when(F.size(lines) >= k, F.sequence(F.lit(1), F.size(lines) - F.lit(k - 1)))
        if k < w:
            starts = F.filter(starts, lambda s: sum((F.get(lines, s + (j - 1))["n"] for j in range(k)), F.lit(0)) > MOST_WORDS)
        return F.coalesce(F.transform(starts, lambda s: F.slice(lines, s, F.lit(k))), F.slice(F.array(lines), 1, 0))

    return F.concat(*[of(k) for k in range(1, w + 1)])


def repeated_lines(docs: DataFrame, work: Workspace, w: int = MIN_LINES) -> DataFrame:
    """_tl_doc, _tl_key (a document) and _tl_gone: the numbers (from 0) of its lines in runs that occurred before."""
    hashed = docs.select(F.col("doc_id").alias("_tl_doc"), F.xxhash64("text").alias("_tl_key"), _lines("text").alias("h"))
    chosen = F.array_distinct(F.transform(_runs(F.col("h"), w), lambda x: F.array_min(x)))
    at = hashed.select("_tl_doc", "_tl_key", "h", F.explode(chosen).alias("print"))
    # Each fingerprint carries the lines that a run over it can have: w - 1 on either side.
    first = F.greatest(F.lit(1), F.col("print.p") - F.lit(w - 2))
    around = F.slice("h", first, F.least(F.size("h"), F.col("print.p") + F.lit(w)) - first + 1)
    prints = work.save(at.select("_tl_doc", "_tl_key", F.col("print.x").alias("fp"), F.col("print.p").alias("p"), around.alias("around")), "prints")

    known = work.save(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "known")
    matched = join_counted(prints, known, "fp", prints.count())
    # Extension both ways: each run over the fingerprint that chose it.
    own = F.filter(_runs(F.col("around"), w), lambda x: F.array_min(x)["p"] == F.col("p"))
    each = matched.select("_tl_doc", "_tl_key", F.explode(own).alias("run"))
    each = each.select("_tl_doc", "_tl_key", F.transform("run", lambda x: x["x"]).alias("lines"), F.col("run")[0]["p"].alias("start"), F.transform("run", lambda x: x["i"]).alias("at"))
    each = work.save(each, "runs")
    work.drop("prints", "known")
    place = F.struct("_tl_doc", "_tl_key", "start")
    origin = work.save(each.groupBy("lines").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1"), "origins")
    later = join_counted(each, origin, "lines", each.count()).where(place > F.col("origin"))
    return later.groupBy("_tl_doc", "_tl_key").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("_tl_gone"))


def line_dedup(docs: DataFrame, w: int = MIN_LINES, emptied: bool = True) -> DataFrame:
    """The documents with the repeated runs deleted from `text`, and n_lines (blank ones included) and n_removed.

    emptied: whether a document stays of which lines were deleted and no nonblank line is left.
    """
    work = Workspace(docs.sparkSession, "lines")
    gone = work.save(repeated_lines(docs, work, w), "gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.col("doc_id").alias("_tl_d"), F.xxhash64("text").alias("_tl_k"))
    # Documents always move by key: what goes from the corpus grows with it, so a broadcast would not last.
    joined = keyed.join(gone.hint("merge"), F.col("_tl_d").eqNullSafe(F.col("_tl_doc")) & (F.col("_tl_k") == F.col("_tl_key")), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_tl_gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get(F.col("_tl_lines"), i)), "\n")
    found = joined.withColumn("_tl_lines", F.when(F.col("_tl_gone").isNotNull(), lines))
    text = F.when(F.col("_tl_gone").isNotNull(), cut).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    out = found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], n_lines.alias("n_lines"), F.coalesce(F.size("_tl_gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out if emptied else out.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
