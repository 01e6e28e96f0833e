"""Approximate nearest neighbours (7): a hash-prefix forest (LSH forest) by cosine.

Each vector has a long hash string in each tree: the signs of its projections on random directions. Vectors are dealt
to blocks; a block's forest is, for each tree, the sorted array of the hash strings. A query descends in every tree to
its longest prefix match by binary search, then ascends all trees together, one symbol at a time: a level takes all
vectors that share that many symbols in any tree, until there are enough candidates. Their cosines are exact.

Queries meet every block in chunks, so no task holds more than one block and one chunk. A block gives its best K for a
query, and the best of all blocks are the answer. A level is taken whole, so equal vectors are candidates together and
ties fall to the smaller vec_id as they should.

Measured recall against brute force: see the README. Defined cases: vectors that are null, zero, of another length than
most, or hold null or non-finite components take no part, nor do rows without a vec_id; rows with the same vec_id count
once, with the smallest vector; fewer candidates than K give them all; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, ship

#: Vectors of a block, least number of blocks, and queries of a chunk.
BLOCK_VECTORS, LEAST_BLOCKS, CHUNK_QUERIES = 4096, 48, 2048
TREES, BITS = 24, 24
#: Candidates, counted once for each tree, that end the ascent: this share of a block for each tree, and a least number.
SHARE, LEAST_CANDIDATES = 0.04, 64
FOREST = "block int, dim int, ids binary, vectors binary, codes binary, orders binary"
CHUNK = "chunk int, query_ids binary, queries binary"
FOUND = "query_id long, vec_id long, score double"


def hash_codes(vectors: np.ndarray, seed: int = 3) -> np.ndarray:
    """Of each tree the hash strings as numbers, the first symbol in the highest bit."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], TREES * BITS))
    signs = (vectors @ planes > 0).reshape(len(vectors), TREES, BITS)
    return (signs.astype(np.uint32) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)).sum(2, dtype=np.uint32).T


def build_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    vectors = np.array(pdf["vector"].tolist(), float)
    codes = hash_codes(vectors)
    orders = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
    ordered = np.take_along_axis(codes, orders, 1)
    return pd.DataFrame(
        {"block": [int(pdf["block"].iloc[0])], "dim": [vectors.shape[1]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "codes": [ordered.tobytes()], "orders": [orders.tobytes()]}
    )


def pack_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "query_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "queries": [np.array(pdf["vector"].tolist(), float).tobytes()]})


def candidates(codes: np.ndarray, wanted: np.ndarray, enough: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Of each query its number and the (tree, from, to) of the level where its ascent ends.

    codes: sorted hash strings [tree][vector]; wanted: the queries' [tree][query]."""
    n = wanted.shape[1]
    low, high = np.zeros((TREES, n), np.int64), np.zeros((TREES, n), np.int64)
    open_ = np.arange(n)
    for level in range(BITS, -1, -1):
        rest = np.uint32((1 << (BITS - level)) - 1)
        for tree in range(TREES):
            first = wanted[tree, open_] & ~rest
            low[tree, open_] = np.searchsorted(codes[tree], first, "left")
            high[tree, open_] = np.searchsorted(codes[tree], first | rest, "right")
        open_ = open_[(high - low)[:, open_].sum(0) < enough]
        if not len(open_):
            break
    for q in range(n):
        yield q, [(t, int(low[t, q]), int(high[t, q])) for t in range(TREES) if high[t, q] > low[t, q]]


def search_block(row, k: int) -> pd.DataFrame:
    """The k best of one block for each query of one chunk."""
    ids = np.frombuffer(row.ids, np.int64)
    vectors = np.frombuffer(row.vectors, float).reshape(len(ids), row.dim)
    codes = np.frombuffer(row.codes, np.uint32).reshape(TREES, len(ids))
    orders = np.frombuffer(row.orders, np.int32).reshape(TREES, len(ids))
    query_ids = np.frombuffer(row.query_ids, np.int64)
    queries = np.frombuffer(row.queries, float).reshape(len(query_ids), row.dim)
    norms = np.sqrt((vectors * vectors).sum(1))
    enough = max(LEAST_CANDIDATES, int(SHARE * len(ids) * TREES))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen = np.zeros(len(ids), bool)
    for q, ranges in candidates(codes, hash_codes(queries), enough):
        seen[:] = False
        for tree, a, b in ranges:
            seen[orders[tree, a:b]] = True
        seen[ids == query_ids[q]] = False
        at = np.flatnonzero(seen)
        # Row by row, so that equal vectors get equal scores wherever they stand.
        score = (vectors[at] * queries[q]).sum(1) / (norms[at] * np.sqrt((queries[q] * queries[q]).sum()))
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[at[best]], score[best]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def build_forest(rows: DataFrame, blocks: int) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build_block, FOREST)


def search(forest: DataFrame, queries: DataFrame, blocks: int, chunks: int, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query (vec_id, vector)."""
    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(chunks)).cast("int"))
    packed = dealt.groupBy("chunk").applyInPandas(pack_chunk, CHUNK)
    to_blocks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = forest.join(to_blocks.hint("shuffle_hash"), "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield search_block(row, k)

    found = met.drop("chunk").mapInPandas(run, FOUND)
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of each vector whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    ship(spark)
    work = Workspace(spark, "ann")
    rows = work.save(usable(vectors), "vectors")
    sizes = sorted((-r["n"], r["dim"]) for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim = -sizes[0][0], sizes[0][1]
    rows = rows.where(F.size("vector") == dim)
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_VECTORS))
    queries = rows.where(F.col("vec_id") % every == 0)
    chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    forest = work.save(build_forest(rows, blocks), "forest")
    return search(forest, queries, blocks, chunks, k)
