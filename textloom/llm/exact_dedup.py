"""Exact dedup (10): minimal perfect hashes over the digests of the documents seen before.

The historical distinct digests are dealt to buckets by their own hash. Each bucket becomes one row: a levelled
bitmap hash that gives every digest its own slot, and slots with the whole digest, the winner's locator (doc_id) and
the group's size. New digests, aggregated first so that a hot text is one row, are looked up in their bucket; the
slot's digest is compared byte by byte, because a perfect hash also answers for strangers. Members are repeats of the
slot's winner; nonmembers form groups of their own.

Defined cases: null texts count as empty; empty texts are equal to each other; rows with the same doc_id and the same
text are repeats, of which one is kept; null doc_ids are in the new part and never win against a number; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, join_counted, ship, text_or_empty

#: Digests a bucket should hold; a bucket is one task's memory. At least so many buckets, so that small inputs spread.
BUCKET_KEYS, LEAST_BUCKETS = 50_000, 256
#: Bits a level of the perfect hash has for each digest that has no slot yet.
GAMMA = 1.5
GROUPS = "digest binary, keep_id long, group_size long"
INDEX = "bucket long, keys long, level_sizes binary, bitmap binary, slots binary, winners binary, has_winner binary, sizes binary"


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of digests (rows of four words) for one level."""
    with np.errstate(over="ignore"):
        x = words[:, 0] + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
        for k in range(1, 4):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + words[:, k]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Maps n distinct 32-byte digests to 0..n-1. Each level keeps the bits that exactly one digest sets."""

    def __init__(self, level_sizes: np.ndarray, bits: np.ndarray) -> None:
        self.level_sizes, self.bits = level_sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, parts, left, level = [], [], words, 0
        while len(left):
            m = max(1, int(np.ceil(GAMMA * len(left))))
            at = (_mix(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(alone)
            left = left[~alone[at]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for one that no level answers for."""
        out, open_, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, m in enumerate(self.level_sizes):
            if not len(open_):
                break
            at = base + (_mix(words[open_], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_, base = open_[~hit], base + m
        return out


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), "<u8").reshape(-1, 4)


def build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row that holds a bucket's perfect hash and slots."""
    words = _words(pdf["digest"])
    mph = PerfectHash.build(words)
    order = np.empty(len(words), np.int64)
    order[mph.slots(words)] = np.arange(len(words))
    winners = pdf["keep_id"].astype("Int64")
    return pd.DataFrame(
        {
            "bucket": [int(pdf["bucket"].iloc[0])],
            "keys": [len(words)],
            "level_sizes": [mph.level_sizes.tobytes()],
            "bitmap": [np.packbits(mph.bits).tobytes()],
            "slots": [words[order].tobytes()],
            "winners": [winners.fillna(0).to_numpy(np.int64)[order].tobytes()],
            "has_winner": [winners.notna().to_numpy(bool)[order].tobytes()],
            "sizes": [pdf["group_size"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """All groups of a bucket: the slots, with their new repeats counted in, and the nonmembers."""
    digests, keeps, sizes = [], [], []
    fresh = np.ones(len(new), bool)
    if len(index):
        row = index.iloc[0]
        level_sizes = np.frombuffer(row["level_sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[: level_sizes.sum()].astype(bool)
        slots = np.frombuffer(row["slots"], "<u8").reshape(-1, 4)
        held = np.frombuffer(row["sizes"], np.int64).copy()
        winner = np.frombuffer(row["winners"], np.int64).copy()
        known = np.frombuffer(row["has_winner"], bool).copy()
        if len(new):
            words = _words(new["digest"])
            at = PerfectHash(level_sizes, bits).slots(words)
            member = at >= 0
            member[member] = (slots[at[member]] == words[member]).all(axis=1)
            fresh, at = ~member, at[member]
            held[at] += new["group_size"].to_numpy(np.int64)[member]
            ids = new["keep_id"].astype("Int64")[member]
            there, value = ids.notna().to_numpy(bool), ids.fillna(0).to_numpy(np.int64)
            better = there & (~known[at] | (value < winner[at]))
            winner[at[better]] = value[better]
            known[at[better]] = True
        digests += [slots[i].tobytes() for i in range(len(slots))]
        keeps.append(pd.Series(winner, dtype="Int64").mask(~known))
        sizes.append(held)
    if fresh.any():
        digests += [bytes(x) for x in new["digest"][fresh]]
        keeps.append(new["keep_id"].astype("Int64")[fresh])
        sizes.append(new["group_size"].to_numpy(np.int64)[fresh])
    keep = pd.concat(keeps, ignore_index=True) if keeps else pd.Series([], dtype="Int64")
    return pd.DataFrame({"digest": digests, "keep_id": keep, "group_size": np.concatenate(sizes) if sizes else np.zeros(0, np.int64)})


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with each run of white space replaced by one space."""
    norm = F.regexp_replace(text_or_empty(), f"{SPACE}+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"))


def _distinct(rows: DataFrame, buckets: int) -> DataFrame:
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The perfect hashes over the distinct digests of `history` (doc_id, digest), a row for each bucket."""
    return _distinct(history, buckets).groupBy("bucket").applyInPandas(build_bucket, INDEX)


def merge_groups(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """digest, keep_id and group_size of all texts in the index or in `new` (doc_id, digest)."""
    return _distinct(new, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(look_up, GROUPS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row.

    Documents up to the middle of the doc_ids are the history that is indexed; the others arrive later.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "exact")
    rows = work.save(with_digest(docs), "digests")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    middle = low + (high - low) // 2 if low is not None else 0
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_KEYS))
    index = work.save(build_index(rows.where(F.col("doc_id") <= middle), buckets), "index")
    groups = work.save(merge_groups(rows.where((F.col("doc_id") > middle) | F.col("doc_id").isNull()), index, buckets), "groups")
    repeats = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    # A group has at least as many rows as doc_ids.
    joined = join_counted(repeats, groups.withColumn("n", F.col("group_size")), "digest", n)
    one_each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth")
    return joined.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"), one_each).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )
