"""MinHash near-dedup (1): improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document's shingles are its runs of five words; a shingle weighs its count in the document times its inverse document
frequency over all documents. Two documents are linked if the weighted Jaccard similarity of their shingles is at
least THRESHOLD; classes are the connected components of the links, named by their smallest doc_id.

1. Packs count their shingles, buckets add the counts and answer with document frequencies.
2. A document can only be similar to another if shingles that occur in more than one document make up THRESHOLD of its
   weight; all others are done. The rest get SAMPLES consistent weighted samples in BANDS bands.
3. Documents that share a band are compared with a centre of it, its smallest doc_id, exactly, on the shingles' weights.
   In bands that hold several classes after that, documents of other classes meet the document with the most links.
4. Where a band still holds several classes, all its documents that were no centre are compared with each other, in
   pairs of blocks. So every pair that shares a band is either compared or already of one class.

Equal texts are one document in 2 to 4 and come back at the end, so copies cost nothing.

The inverse document frequency is damped to between 1 and 1.5: a large group of near copies raises the frequency of its
own shingles, and undamped weights would then hang on the few words by which its members differ. Between documents whose
shingles are about equally frequent the similarity is the plain one.

Defined cases: words are runs of anything but white space; a text of one to four words is one shingle of all its words;
texts without words are similar to nothing, but equal texts are always of one class; null texts count as empty; a null
doc_id stands alone, with a null class; rows with the same doc_id are of one class; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks_of, ragged
from .common import Workspace, join_counted, returns_memory, ship
from .components import components
from .exchange import add, codes_of, exchange
from .packs import NO_ID, PACK_BYTES, Pack, batch_of, digest_table, later_copies, make_packs, packs_in, squeeze, unsqueeze

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
#: Documents of a centre that are compared in one place, and places over which the search for large centres is spread.
PART, SALTS = 1000, 64
#: Documents and shingles of a block, when all pairs of a band are compared.
BLOCK, BLOCK_SHINGLES = 1000, 500_000
#: Bytes of text that a bucket of shingles stands for, and least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 18_000_000, 48
#: The inverse document frequency lies between 1 and 1 + IDF_RANGE.
IDF_RANGE = 0.5
#: Document frequencies are kept as powers of two in steps of an eighth; 0 is a single document.
STEPS = 8
#: A shingle's number has so many bits more than the number of shingles has.
SPARE_BITS = 20
LINK = "a long, b long"
CANDIDATE = "doc_id long, keys binary, weight double, size long, vector binary"
_RNG = np.random.default_rng(17)
_R, _LOG_C, _BETA = -np.log(_RNG.random((2, 1 << 16))).sum(0), np.log(-np.log(_RNG.random((2, 1 << 16))).sum(0)), _RNG.random(1 << 16)
_MULTS = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def id_bits(total_bytes: int) -> int:
    return max(40, min(56, math.ceil(math.log2(max(2, total_bytes / 6))) + SPARE_BITS))


def shingles(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted: owner (number of the text), id and count."""
    plain = pc.replace_substring_regex(texts, r"[\x09\x0B-\x0D]", " ")
    offsets, coded, distinct = chunks_of(plain)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in distinct), np.uint64, len(distinct))
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[coded] if len(coded) else np.zeros(0, bool)
    word = hashes[coded[real]] if len(coded) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[real]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    # A running sum of five terms; a short text gives one term for each word that it has.
    n = len(word)
    padded = np.append(word, np.zeros(WORDS, np.uint64))
    left = (starts + sizes)[owner] - np.arange(n)
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h = h * np.uint64(_A) + np.where(left > k, padded[k : k + n], np.uint64(k + 1))
    begins = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    at = ragged(starts, begins)
    ids, owner = _mix(h[at]) >> np.uint64(64 - bits), owner[at]
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])))
    return owner[first], ids[first], np.diff(np.append(first, len(ids)))


def frequency_codes(total: np.ndarray) -> np.ndarray:
    """Document frequencies as codes."""
    return np.minimum(255, np.round(STEPS * np.log2(total.astype(float))))


def idf(code: np.ndarray, documents: int) -> np.ndarray:
    """The damped inverse document frequency of codes."""
    return 1 + IDF_RANGE * np.log1p(documents / np.exp2(code / STEPS)) / math.log1p(max(1, documents))


def sample(ids: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples: band keys [document][band] of documents that begin at `starts`.

    For each of SAMPLES functions a document's sample is the shingle with the least a = c / (y * e^r), where
    ln y = r * (t - beta) and t = floor(ln w / r + beta), together with t. The variates r and c (gamma) and beta
    (uniform) of a shingle come from tables, by its hash.
    """
    sizes = np.diff(np.append(starts, len(ids)))
    log_w = np.log(weights)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for j in range(SAMPLES):
        h = _mix(ids * _MULTS[j])
        one, two, three = (h & np.uint64(0xFFFF)).astype(np.int64), (h >> np.uint64(48)).astype(np.int64), (h >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int64)
        r, beta = _R[one], _BETA[three]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[two] - r * (t - beta + 1)
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        best = hit[np.searchsorted(hit, starts)]
        band = keys[:, j // ROWS]
        band[:] = _mix(band * np.uint64(_A) + _mix(ids[best] + np.uint64(j)) + t[best].astype(np.int64).view(np.uint64))
    return keys


def candidates_of(pack: Pack, codes: np.ndarray, copies: np.ndarray, bits: int, documents: int) -> list[tuple]:
    """Rows of CANDIDATE of the pack's documents that may have a similar one. codes: of its distinct shingles."""
    owner, ids, counts = shingles(pack.texts(), bits)
    if not len(ids):
        return []
    code = codes[np.searchsorted(np.unique(ids), ids)]
    weight = counts * idf(code.astype(float), documents)
    n = len(pack.ids)
    total = np.bincount(owner, weight, n)
    common = np.bincount(owner[code > 0], weight[code > 0], n)
    chosen = (common >= (THRESHOLD - 1e-9) * total) & (total > 0) & (pack.ids != NO_ID)
    chosen[copies] = False
    keep = chosen[owner]
    owner, ids, weight = owner[keep], ids[keep], weight[keep]
    if not len(ids):
        return []
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    keys = sample(ids, weight, starts)
    ends = np.append(starts[1:], len(ids)).tolist()
    # Weights as four-byte floats, for the samples' sums as for the verification.
    light = weight.astype("<f4")
    return [(int(pack.ids[owner[a]]), keys[i].tobytes(), float(total[owner[a]]), b - a, squeeze(ids[a:b].tobytes() + light[a:b].tobytes())) for i, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True))]


def _jaccard(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two vectors."""
    (i, w), (j, v) = one, two
    at = np.searchsorted(j, i)
    at[at == len(j)] = 0
    same = j[at] == i
    both = float(np.minimum(w[same], v[at[same]]).sum())
    return both / (float(w.sum()) + float(v.sum()) - both)


def _vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of a vector of CANDIDATE."""
    raw = unsqueeze(data)
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, "<f4", n, 8 * n).astype(float)


def _binary(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def compare_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINK of documents and their centres. Rows come by centre and part, the centre's own vectors first."""
    last, centres = None, []
    for batch in batches:
        found = []
        for a, part, doc, data in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("vector"), strict=True):
            vector = _vector(data.as_buffer().to_pybytes())
            if (a, part) != last:
                last, centres = (a, part), []
            if doc == a:
                centres.append(vector)
            elif any(_jaccard(c, vector) >= THRESHOLD - 1e-6 for c in centres):
                found.append((a, doc))
        yield batch_of(LINK, [min(x) for x in found], [max(x) for x in found])


def verified(stars: DataFrame, vectors: DataFrame) -> DataFrame:
    """LINK of the pairs of `stars` (a: a centre, doc_id) whose similarity is THRESHOLD or more.

    A centre of many documents is dealt to several parts of about PART documents.
    """
    sizes = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    hot = sizes.where(F.col("n") > PART).select("a", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    salted = hot.select("a", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = stars.withColumn("salt", spread).join(salted.hint("merge"), ["a", "salt"], "left")
    dealt = dealt.select("a", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "doc_id")
    parts = sizes.select("a", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1)).alias("part"), F.col("a").alias("doc_id"))
    met = dealt.unionByName(parts).join(vectors.hint("merge"), "doc_id")
    ordered = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("doc_id") != F.col("a"))
    return ordered.select("a", "part", "doc_id", "vector").mapInArrow(returns_memory(compare_stars), LINK)


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, of batches in the order of the columns `names`."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                key = tuple(c[a] for c in columns)
                if key != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def links_of_blocks(rows: pa.Table) -> list[tuple[int, int]]:
    """Links among the documents of two blocks of a band, or of one block with itself.

    Pairs that share an earlier band are left to that one, and pairs that known links join are not compared. A document
    is compared with all others at once: their shingles' numbers in the group look up its weights.
    """
    column = {c: rows.column(c).to_numpy() for c in ("band", "one", "two", "block", "doc_id", "weight", "root")}
    band, one, two = (int(column[c][0]) for c in ("band", "one", "two"))
    ids, weight, block = column["doc_id"], column["weight"], column["block"]
    root = np.unique(column["root"], return_inverse=True)[1]
    left = np.flatnonzero(block == one)
    right = left if one == two else np.flatnonzero(block == two)
    if len(np.unique(root)) < 2 or not len(left) or not len(right):
        return []
    keys = np.frombuffer(b"".join(_binary(rows.column("keys"))), np.uint64).reshape(-1, BANDS)
    vectors = [_vector(x) for x in _binary(rows.column("vector"))]
    size = np.fromiter((len(i) for i, _ in vectors), np.int64, len(vectors))
    start = np.cumsum(size) - size
    flat = np.unique(np.concatenate([i for i, _ in vectors]), return_inverse=True)[1]
    light = np.concatenate([w for _, w in vectors])
    total = np.add.reduceat(light, start)
    own = np.zeros(int(flat.max()) + 1)
    links = []
    for n, i in enumerate(left.tolist()):
        others = right[n + 1 :] if one == two else right
        near = np.minimum(weight[i], weight[others]) >= (THRESHOLD - 1e-4) * np.maximum(weight[i], weight[others])
        others = others[near & (root[others] != root[i]) & ~(keys[i, :band] == keys[others, :band]).any(1)]
        if not len(others):
            continue
        mine = slice(start[i], start[i] + size[i])
        own[flat[mine]] = light[mine]
        at = ragged(start[others], size[others])
        both = np.add.reduceat(np.minimum(own[flat[at]], light[at]), np.cumsum(size[others]) - size[others])
        own[flat[mine]] = 0
        for j in others[both >= (THRESHOLD - 1e-6) * (total[i] + total[others] - both)].tolist():
            if root[i] != root[j]:
                links.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
                root[root == root[j]] = root[i]
    return links


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINK of rows that come by band, key and pair of blocks."""
    for rows in groups_of(batches, ["band", "key", "one", "two"]):
        if links := links_of_blocks(rows):
            yield batch_of(LINK, *map(list, zip(*links, strict=True)))


def remaining(known: DataFrame, tried: DataFrame, candidates: DataFrame, work: Workspace, total: int) -> DataFrame:
    """The links that centres left out, by comparing all pairs of the bands that still hold several classes.

    known: doc_id, band, key, size, root; tried: band, key, doc_id of the centres, which have met all others of their band.
    """
    rest = work.save(known.join(tried.hint("merge"), ["band", "key", "doc_id"], "left_anti"), "rest")
    several = rest.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    several = work.save(several.where("low <> high").select("band", "key", blocks.alias("blocks"), "n"), "several")
    rows = join_counted(rest, several, ["band", "key"], total).withColumn("block", F.pmod(F.xxhash64("doc_id", "band"), F.col("blocks")).cast("int"))
    rows = rows.drop("size").join(candidates.select("doc_id", "keys", "weight", "vector").hint("merge"), "doc_id")
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    group = ["band", "key", "one", "two"]
    met = met.select(*group, "block", "doc_id", "root", "weight", "keys", "vector")
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(returns_memory(compare_blocks), LINK)


def classes(candidates: DataFrame, same: DataFrame, work: Workspace) -> DataFrame:
    """node and root of the candidates that verified pairs, or the links `same`, join."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(_binary(batch.column("keys"))), np.int64)
            doc, size = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("doc_id", "size"))
            yield batch_of("doc_id long, band int, key long, size long", doc, np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows), keys, size)

    bands = candidates.select("doc_id", "keys", "size").mapInArrow(explode, "doc_id long, band int, key long, size long")
    bands = work.save(bands.groupBy("band", "key", "doc_id").agg(F.max("size").alias("size")), "each")
    band, number = ["band", "key"], F.count(F.lit(1)).alias("n")
    total = bands.count()
    # The smallest doc_id of a band, which most bands of a group share. Bands of very many documents are joined by broadcast.
    first = work.save(bands.groupBy(*band).agg(F.min("doc_id").alias("centre"), number).where("n > 1"), "centres0")
    bands = work.save(join_counted(bands, first, band, total), "bands")
    work.drop("each")
    vectors = candidates.select("doc_id", "vector")

    def rooted(roots: DataFrame, table: str) -> DataFrame:
        """The bands that hold several classes, with each document's class."""
        named = bands.drop("centre").join(roots.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        several = named.groupBy(*band).agg(F.min("root").alias("low"), F.max("root").alias("high"), number).where("low <> high").select(*band, "n")
        return work.save(join_counted(named, several, band, total), table)

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("centre").alias("a"), "doc_id").distinct()

    stars = work.save(pairs(bands.where("doc_id <> centre")), "stars0")
    links = work.save(verified(stars, vectors).unionByName(same), "links0")
    roots = components(links, work, "classes0")
    work.drop("stars0")
    # The document with the most links: where a group hangs together by one document, that one.
    degree = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    known = rooted(roots, "known1").join(degree.hint("merge"), "doc_id", "left")
    drawn = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("doc_id").alias("draw"), "doc_id", "root")
    most = known.groupBy(*band).agg(F.max(drawn).alias("c"), number)
    second = work.save(most.select(*band, F.col("c.doc_id").alias("centre"), F.col("c.root").alias("centre_root"), "n"), "centres1")
    stars = work.save(pairs(join_counted(known, second, band, total).where("root <> centre_root")), "stars1")
    links = links.unionByName(work.save(verified(stars, vectors), "links1"))
    roots = components(links, work, "classes1")
    work.drop("stars1", "known1", "classes0")
    # What is left: each pair of a band, between documents that were no centre of it.
    tried = first.select("band", "key", "centre").unionByName(second.select("band", "key", "centre")).select("band", "key", F.col("centre").alias("doc_id")).distinct()
    more = work.save(remaining(rooted(roots, "known2"), tried, candidates, work, total), "links2")
    if more.isEmpty():
        return roots
    return components(links.unionByName(more), work, "classes2")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (it is that one) of each document."""
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "near")
    packs = make_packs(docs, work)
    total, documents = packs.agg(F.sum("bytes"), F.sum("n")).first()
    total, documents = total or 0, documents or 0
    bits, buckets = id_bits(total), max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    digests = digest_table(packs, work)
    place = F.struct("doc_id", "pack", "nth")
    firsts = work.save(digests.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    copies = later_copies(digests, firsts, place > F.col("first"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for (pack,) in packs_in(batches):
            ids, counts = np.unique(shingles(pack.texts(), bits)[1], return_counts=True)
            if len(ids):
                yield pack.pack, ids, counts.astype(np.uint64)

    # A shingle takes about six bytes of text.
    told = exchange(packs, count, bits, buckets, PACK_BYTES / 6, add, frequency_codes, work).withColumnRenamed("sender", "pack")
    full = packs.join(told.hint("merge"), "pack").join(copies.hint("merge"), "pack", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, found, gone in packs_in(batches, "codes", "copies"):
            rows = candidates_of(pack, codes_of(found), np.array(gone or [], np.int64), bits, documents)
            if rows:
                yield batch_of(CANDIDATE, *map(list, zip(*rows, strict=True)))

    chosen = work.save(full.mapInArrow(returns_memory(choose), CANDIDATE), "candidates")
    work.drop("answers", "packs")
    first = firsts.select("digest", F.col("first.doc_id").alias("least"), "n")
    least = join_counted(digests.select("digest", "doc_id"), first, "digest", documents, "left")
    # Rows with one doc_id are of one class, whatever their texts.
    least = work.save(least.select("doc_id", F.coalesce("least", "doc_id").alias("least")), "least")
    several = least.where(F.col("doc_id") != NO_ID).groupBy("doc_id").agg(F.min("least").alias("a"), F.max("least").alias("high")).where("a <> high").select("doc_id", "a")
    same = least.join(several.hint("merge"), "doc_id").select("a", F.col("least").alias("b")).where("a <> b").distinct()
    roots = classes(chosen, same, work)
    classed = least.join(roots.hint("merge"), F.col("least") == F.col("node"), "left").select("doc_id", F.coalesce("root", "least").alias("class_id"))
    null = F.col("doc_id") == NO_ID
    return classed.select(F.when(~null, F.col("doc_id")).alias("doc_id"), F.when(~null, F.col("class_id")).alias("class_id"), (null | (F.col("doc_id") == F.col("class_id"))).alias("kept"))
