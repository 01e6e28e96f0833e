"""Exchange of keys between packs: every pack sends its sorted keys with a value each, and learns what all packs sent.

Keys fall into buckets, ranges of equal width, so a bucket is one task's memory. A row for each pack and bucket would grow
with the square of the corpus. So where a pack's keys would be spread too thin, the exchange has two steps: in the first,
the keys of GROUP packs in one coarse range are put together, with their values combined; in the second these go to the
buckets of the range. Rows hold about LEAST_KEYS keys or more in both, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, returns_memory
from .packs import batch_of, squeeze, unsqueeze

#: Keys of a pack that a row should hold; packs that are put together in the first of two steps, and coarse ranges.
LEAST_KEYS, GROUP, RANGES = 64, 1024, 1024
SENT = "bucket long, sender long, keys binary, vals binary"
ANSWER = "sender long, bucket long, codes binary"

#: Combines values: where each key begins in the values ordered by key, and these, to a value for each key.
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers as their differences, in byte planes: the three low ones as they are, the others squeezed.

    The differences of hashes are spread evenly, so what they take is about their entropy, whatever the numbers' width.
    """
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return np.array([len(keys)], "<u8").tobytes() + np.ascontiguousarray(planes[:3]).tobytes() + squeeze(np.ascontiguousarray(planes[3:]))


def unpack_keys(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    planes = np.empty((8, n), np.uint8)
    planes[:3] = np.frombuffer(data, np.uint8, 3 * n, 8).reshape(3, n)
    planes[3:] = np.frombuffer(unsqueeze(data[8 + 3 * n :]), np.uint8).reshape(5, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    """Values in byte planes, so that small ones take next to nothing."""
    return squeeze(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def unpack_values(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def add(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each key's values."""
    return np.add.reduceat(values, first)


def cut(sender: int, keys: np.ndarray, values: np.ndarray, edges: list[int], base: int = 0) -> list[tuple]:
    """Rows of SENT: sorted keys by the buckets that begin at `edges`; buckets are numbered from `base`."""
    at = [*np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
    return [(base + b, sender, pack_keys(keys[x:y]), pack_values(values[x:y])) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]


def range_edges(bits: int, n: int, a: int = 0, b: int | None = None) -> list[int]:
    """Where each of n ranges of equal width of numbers of so many bits begins; those from the a-th to before the b-th."""
    return [(k << bits) // n for k in range(a, n if b is None else b)]


def _combined(pdf: pd.DataFrame, combine: Combine) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row; all distinct keys in order and their values."""
    keys = [unpack_keys(x) for x in pdf["keys"]]
    values = [unpack_values(x, len(k)) for x, k in zip(pdf["vals"], keys, strict=True)]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return keys, flat[first], combine(first, np.concatenate(values)[order])


def ask(sent: DataFrame, combine: Combine, answer: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """ANSWER for each row of SENT: a byte for each of its keys, of what `answer` makes of the combined values."""

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, distinct, values = _combined(pdf, combine)
        codes = answer(values).astype(np.uint8)
        found = [squeeze(codes[np.searchsorted(distinct, k)]) for k in keys]
        return pd.DataFrame({"sender": pdf["sender"], "bucket": pdf["bucket"], "codes": found})

    return sent.groupBy("bucket").applyInPandas(reply, ANSWER)


def exchange(packs: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray]]], bits: int, buckets: int, mean_keys: float, combine: Combine, answer: Callable[[np.ndarray], np.ndarray], work: Workspace) -> DataFrame:
    """sender (a pack) and codes: an array of structs of bucket and codes, in the order of the pack's keys by bucket.

    send: of batches of packs the packs' numbers, distinct sorted keys of `bits` bits, and values. mean_keys: about how many
    keys a pack has.
    """
    fine = mean_keys < LEAST_KEYS * buckets and buckets > RANGES
    # In two steps, ranges hold the same number of buckets each.
    per = -(-buckets // RANGES) if fine else 1
    count = RANGES * per if fine else buckets
    edges = range_edges(bits, RANGES if fine else count)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sender, keys, values in send(batches):
            if rows := cut(sender, keys, values, edges):
                yield batch_of(SENT, *map(list, zip(*rows, strict=True)))

    sent = packs.mapInArrow(returns_memory(first), SENT)
    if not fine:
        answers = work.save(ask(sent, combine, answer), "answers")
        return answers.groupBy("sender").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))

    ranked = work.save(packs.select("pack").withColumn("team", F.pmod(F.xxhash64("pack"), F.lit(max(1, -(-packs.count() // GROUP))))), "teams")
    named = work.save(sent, "sent").join(ranked.withColumnRenamed("pack", "sender").hint("merge"), "sender")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """The keys of a team in one range, for its buckets. A team in a range is a sender of its own."""
        part = int(pdf["bucket"].iloc[0])
        _, keys, values = _combined(pdf, combine)
        rows = cut(int(pdf["team"].iloc[0]) * RANGES + part, keys, values, range_edges(bits, count, part * per, (part + 1) * per), part * per)
        return pd.DataFrame(rows, columns=["bucket", "sender", "keys", "vals"])

    teams = work.save(named.groupBy("team", "bucket").applyInPandas(gather, SENT), "gathered")
    heard = work.save(ask(teams, combine, answer), "heard")
    held = teams.select("sender", "bucket", "keys").join(heard, ["sender", "bucket"])
    held = held.select((F.col("sender") / RANGES).cast("long").alias("team"), (F.col("sender") % RANGES).alias("part"), F.col("bucket").alias("at"), "keys", "codes")
    asked = named.select("team", F.col("bucket").alias("part"), "sender", "keys")

    def spread(asking: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """What each pack of a team asked about in one range."""
        known = known.sort_values("at")
        keys = np.concatenate([unpack_keys(x) for x in known["keys"]])
        codes = np.frombuffer(b"".join(unsqueeze(x) for x in known["codes"]), np.uint8)
        found = [squeeze(codes[np.searchsorted(keys, unpack_keys(x))]) for x in asking["keys"]]
        return pd.DataFrame({"sender": asking["sender"], "bucket": asking["part"], "codes": found})

    answers = work.save(asked.groupBy("team", "part").cogroup(held.groupBy("team", "part")).applyInPandas(spread, ANSWER), "answers")
    work.drop("sent", "gathered", "heard")
    return answers.groupBy("sender").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))


def codes_of(found: list[dict]) -> np.ndarray:
    """A pack's codes, in the order of its keys."""
    return np.frombuffer(b"".join(unsqueeze(x["codes"]) for x in sorted(found, key=lambda x: x["bucket"])), np.uint8)
