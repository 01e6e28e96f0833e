"""Packs: documents gathered into compressed binary rows, on which numpy works at once.

Operators that compare the insides of all documents would need a row for each shingle or position. Instead a pack's
task sorts its own keys, sends each bucket of keys one binary row, and gets one back: key exchanges cost a few bytes a
key. A pack is a few megabytes of text, so a task's memory does not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import Workspace, join_counted, returns_memory, text_or_empty

#: Bytes of text in a pack; a longer document is a pack by itself.
PACK_BYTES = 3_000_000
#: Packs in an Arrow batch are read one by one; a null doc_id is stored as this and comes after all others.
NO_ID = np.iinfo(np.int64).max
PACK = "pack long, n int, bytes long, ids binary, sizes binary, digests binary, texts binary"
_DIGEST = 16


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else data.tobytes())


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Pack:
    """One pack: ids, sizes (bytes) and digests of its documents, and `data`, their bytes one after the other."""

    def __init__(self, pack: int, ids: bytes, sizes: bytes, digests: bytes, texts: bytes) -> None:
        self.pack = pack
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.digests = np.frombuffer(digests, np.uint64).reshape(-1, _DIGEST // 8)
        self.raw = unsqueeze(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def texts(self) -> pa.Array:
        offsets = np.append(0, self.ends).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.ids), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.raw))


def packs_in(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Packs, and with them the values of further columns."""
    for batch in batches:
        columns = [batch.column(c) for c in ("ids", "sizes", "digests", "texts", *more)]
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            values = [c[i].as_py() for c in columns]
            yield (Pack(pack, *values[:4]), *values[4:])


def make_packs(docs: DataFrame, work: Workspace, table: str = "packs") -> DataFrame:
    """Writes the packs (PACK) of doc_id and text, and reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            digests = b"".join(hashlib.blake2b(t, digest_size=_DIGEST).digest() for t in texts)
            row = [base + k, len(ids), held, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), digests, squeeze(b"".join(texts))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            names = ["pack", "n", "bytes", "ids", "sizes", "digests", "texts"]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in slices(batches, "text", PACK_BYTES):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes() if len(text.as_buffer() or b"") else b""
                if ids and held + len(data) > PACK_BYTES:
                    yield out()
                    ids, texts, held, k = [], [], 0, k + 1
                ids.append(NO_ID if i is None else i)
                texts.append(data)
                held += len(data)
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return work.save(rows.mapInArrow(returns_memory(run), PACK), table)


def batch_of(schema: str, *columns: list) -> pa.RecordBatch:
    """A record batch of lists by a schema of long, int, binary and double."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(columns, types, strict=True)], list(names))


def digest_table(packs: DataFrame, work: Workspace) -> DataFrame:
    """digest, doc_id, pack and nth (its number in the pack) of each document."""
    schema = "digest binary, doc_id long, pack long, nth int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, ids, digests in zip(*(batch.column(c) for c in ("pack", "ids", "digests")), strict=True):
                raw = digests.as_buffer().to_pybytes()
                n = len(raw) // _DIGEST
                yield batch_of(schema, [raw[_DIGEST * i : _DIGEST * (i + 1)] for i in range(n)], np.frombuffer(ids.as_buffer(), np.int64), [pack.as_py()] * n, list(range(n)))

    return work.save(packs.select("pack", "ids", "digests").mapInArrow(run, schema), "digests")


def later_copies(digests: DataFrame, firsts: DataFrame, later: Column) -> DataFrame:
    """pack and copies: the numbers of its documents that are `later` than the first of their text.

    firsts: digest, n (how many documents have it) and what `later` compares with.
    """
    met = join_counted(digests, firsts, "digest", digests.count())
    return met.where(later).groupBy("pack").agg(F.collect_list("nth").alias("copies"))
