"""Mixing sources to target weights (6): a multivariate-hypergeometric splitting tree over source blocks.

Every source's documents fall into blocks by a hash of the document. A source's target is met by drawing its blocks:
all of them as often as the target allows in whole, then permuted blocks once more, the last of them cut to the exact
number of words. The drawn blocks of all sources are then dealt to the output shards by a splitting tree: each node
splits its exact block counts between its two halves with one multivariate-hypergeometric draw, so that every shard is
a uniform sample of the mix and no block is dealt twice. Within a shard rows are ordered by a hash.

What the driver sees is bounded: a row for each source and MOST_BLOCKS more. Everything else stays in DataFrames; no
step gathers a source.

Defined cases: null and empty texts have size 0 and are never taken; a source of size 0 has target 0; a null source is
a source of its own, last in order; repeated rows are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, text_or_empty

#: Words a block should hold, and the most blocks of all sources together (besides one for each): beyond that they grow.
BLOCK_WORDS, MOST_BLOCKS = 20_000, 100_000
#: Words a shard should hold, and the most shards.
SHARD_WORDS, MOST_SHARDS = 5_000_000, 4096
#: The most times that a document may be repeated.
MOST_COPIES = 3
#: The plan (a few rows a source) is broadcast up to so many rows, else joined by shuffling.
BROADCAST_ROWS = 50_000
PLAN = "source string, block int, target double, source_size long, shards array<int>, cut_words long, cut_shard int"


def water_fill(sizes: list[int], weights: list[int], cap: float = MOST_COPIES) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its own size; the excess goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source (column) each shard (row) gets; the columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        n = int(counts.sum())
        left = rng.multivariate_hypergeometric(counts, n * (middle - low) // (high - low), method="marginals")
        split(low, middle, left)
        split(middle, high, counts - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")


def plan_blocks(sources: list[tuple[str | None, int, int]], blocks: dict[str | None, dict[int, int]], seed: int) -> list[tuple]:
    """Rows of PLAN. sources: name, words, number of blocks, in order; blocks: words of each block of a source."""
    targets = water_fill([s for _, s, _ in sources], [i % 3 + 1 for i in range(len(sources))])
    draws: list[list[tuple[int, int]]] = []  # of each source: (block, words of it)
    for (name, size, _), target in zip(sources, targets, strict=True):
        want, held = min(round(target), MOST_COPIES * size), blocks.get(name, {})
        own: list[tuple[int, int]] = []
        if size:
            order = np.random.default_rng(_seed(seed, name)).permutation(sorted(held))
            left = want
            while left > 0:
                for b in map(int, order):
                    if left <= 0:
                        break
                    if held[b]:
                        own.append((b, min(held[b], left)))
                        left -= own[-1][1]
        draws.append(own)
    words = sum(w for own in draws for _, w in own)
    shards = int(min(MOST_SHARDS, max(1, -(-words // SHARD_WORDS))))
    dealt = splitting_tree(np.array([len(x) for x in draws]), shards, np.random.default_rng(_seed(seed, "tree"))) if draws else np.zeros((1, 0), int)
    rows = []
    for i, ((name, size, _), target) in enumerate(zip(sources, targets, strict=True)):
        shuffled = np.random.default_rng(_seed(seed, name, "deal")).permutation(len(draws[i]))
        shard_of = np.empty(len(draws[i]), int)
        shard_of[shuffled] = np.repeat(np.arange(shards), dealt[:, i])
        whole: dict[int, list[int]] = {b: [] for b in blocks.get(name, {})}
        cut: dict[int, tuple[int, int]] = {}
        for (b, n), shard in zip(draws[i], map(int, shard_of), strict=True):
            if n == blocks[name][b]:
                whole[b].append(shard)
            else:
                cut[b] = (n, shard)
        rows += [(name, b, target, size, whole[b], *cut.get(b, (0, None))) for b in whole]
    return rows


def mix(docs: DataFrame, seed: int = 11, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, draws and taken.

    carry: further columns, which tell rows of one doc_id apart. draws: an array of (shard, words), one entry each time that the document is taken; words is its size, but in the one
    document of a source where the target is met. taken: their sum.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"))
    size = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), *carry), "sized")

    found = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    order = sorted((s for s in found if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in found if s is None]
    block_words = max(BLOCK_WORDS, -(-int(sum(found.values())) // MOST_BLOCKS))
    sources = [(s, int(found[s]), int(max(1, -(-found[s] // block_words)))) for s in order]
    counts = _small(spark, [(s, n) for s, _, n in sources], "name string, blocks int")
    placed = sized.join(counts, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = placed.withColumn("block", F.pmod(F.col("key"), F.col("blocks")).cast("int")).drop("blocks")
    held: dict[str | None, dict[int, int]] = {}
    for r in placed.groupBy("source", "block").agg(F.sum("size").alias("words")).collect():
        held.setdefault(r["source"], {})[r["block"]] = int(r["words"])
    plan = _small(spark, plan_blocks(sources, held, seed), PLAN).withColumnsRenamed({"source": "name", "block": "part"})
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("part"))).drop("name", "part")

    # Only the block in which a source's target is met needs its documents in order; it holds about block_words words.
    plain = joined.where(F.col("cut_words") == 0).withColumn("before", F.lit(0).cast("long"))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    met = joined.where(F.col("cut_words") > 0).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_words") - F.col("before"))).cast("long")
    both = plain.unionByName(met).withColumn("part", F.when(F.col("cut_words") > 0, part).otherwise(F.lit(0)))
    whole = F.transform("shards", lambda s: F.struct(s.alias("shard"), F.col("size").alias("words")))
    last = F.array(F.struct(F.col("cut_shard").alias("shard"), F.col("part").alias("words")))
    draws = F.filter(F.concat(whole, F.when(F.col("part") > 0, last).otherwise(F.filter(last, lambda x: F.lit(False)))), lambda x: x["words"] > 0)
    out = both.withColumn("draws", draws)
    return out.select("doc_id", "source", "size", "source_size", "target", "draws", (F.col("size") * F.size("shards") + F.col("part")).alias("taken"), *carry)


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: each as often as it is drawn, in shards shuffled locally.

    A document in which its source's target is met is cut behind its last word taken. Rows are told apart by doc_id,
    source and text; rows that are equal in all three share out their draws one by one.
    """
    names = docs.columns
    # Two hashes: one of 64 bits could be the same for different rows of a large corpus.
    parts = [F.col("doc_id"), F.col("source"), F.col("text"), *[F.col(c).isNull() for c in ("doc_id", "source", "text")]]
    row = ["_tl_one", "_tl_two"]
    docs = docs.withColumns({c: F.xxhash64(F.lit(k), *parts) for k, c in enumerate(row)})
    drawn = mix(docs, seed, row).groupBy(*row).agg(F.max("size").alias("_tl_size"), F.array_sort(F.collect_list("draws")).alias("_tl_draws"))
    drawn = drawn.where(F.exists("_tl_draws", lambda x: F.size(x) > 0))
    joined = docs.join(drawn.hint("merge"), row).withColumn("_tl_nth", F.row_number().over(Window.partitionBy(*row).orderBy(row[0])))
    joined = joined.withColumn("draws", F.element_at("_tl_draws", F.col("_tl_nth")))
    each = joined.select(*[F.col(f"`{c}`") for c in names], "_tl_size", F.posexplode("draws").alias("_tl_copy", "_tl_draw"))
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(ends, F.lit(1), F.col("_tl_draw.words").cast("int")), "")
    text = F.when(F.col("_tl_draw.words") < F.col("_tl_size"), head).otherwise(F.col("text"))
    out = each.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_tl_draw.words") < F.col("_tl_size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    shards = out.repartition(F.col("_tl_draw.shard"), F.pmod(F.xxhash64("doc_id", "_tl_copy"), F.lit(16)))
    return shards.sortWithinPartitions(F.col("_tl_draw.shard"), F.xxhash64(F.lit(seed + 2), "doc_id", "_tl_copy")).select(*[F.col(f"`{c}`") for c in names])
