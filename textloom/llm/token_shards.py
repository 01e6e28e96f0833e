"""Token-ID / binary output (8): shards of token ids, compressed by a Re-Pair grammar.

Documents are dealt by ranges of doc_id, sorted, encoded by the tokenizers library, and gathered into shards of about SHARD_TOKENS ids. A shard is
one binary value in a Parquet table in the shared folder (so any store that Spark writes to will do, with Spark's own
commit protocol): in rounds, its most frequent id pairs are replaced by nonterminals until no pair is frequent. The
rules and each rule's expansion length are stored, so any range of ids can be decoded by itself.

Layout of a shard, little-endian: HEADER (magic, version, bytes of a symbol, first nonterminal, rules, symbols, docs,
ids); rules, two uint32 each; expansion lengths, uint32; symbols; of each document its doc_id (int64), whether it has
one (uint8) and its number of ids (int64). No rule spans the end of a document.

Defined cases: null texts count as empty and give the end id alone; null doc_ids come first; rows with the same doc_id
follow each other in the order of their texts; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, ChunkCoder, ragged, slices, vocabulary_path
from .common import Workspace, ship, text_or_empty

#: Ids a shard should hold; one task holds a shard in memory.
SHARD_TOKENS = 1_000_000
#: Pieces of text that a worker remembers, texts or pieces encoded in one call of the library, and bytes worked on together.
CACHE_CHUNKS, CALL_TEXTS, SLICE_BYTES = 1_000_000, 1000, 8_000_000
#: The word behind each piece where several are one text of the library, and how many are.
MARK, JOINED = "\x01", 32
#: Fixed value: a pattern of words that matches no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The id appended to each document.
END_ID = 2
#: How often a pair must occur to be frequent: a rule takes 12 bytes, a symbol two, so rarer pairs would gain little or lose.
LEAST_COUNT = 16
#: Rows of the parts' offsets that are broadcast; more are joined by shuffling.
MOST_BROADCAST = 50_000
MAGIC, VERSION = b"TLRP", 1
HEADER = struct.Struct("<4sIIIIQQQ")
SHARD = "part int, shard int, n_docs long, n_tokens long, inside long, payload binary"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def compress(ids: np.ndarray, first: int, barrier: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (rows of two symbols; rule k is the symbol first + k) and the symbols that are left of ids.

    Each round replaces all pairs that are frequent by what they counted before it; where two of them overlap the more
    frequent one goes first. Pairs with the symbol barrier stay. A pair only becomes more frequent
    by a new symbol in it, so after the first round only places beside new symbols, and those of frequent pairs that are
    left, are looked at.
    """
    seq, rules, made = ids.astype(np.uint32), [], first
    at = np.arange(max(0, len(seq) - 1), dtype=np.uint64)
    while len(at):
        one, two = seq[at], seq[at + np.uint64(1)]
        inside = (one != barrier) & (two != barrier)
        at, one, two = at[inside], one[inside], two[inside]
        # A pair and its place in one number, so that one sort brings the places of a pair together.
        wide, low = int(made - 1).bit_length(), int(len(seq)).bit_length()
        if 2 * wide + low > 64:
            raise ValueError("too many ids for one shard")
        key = (one.astype(np.uint64) << np.uint64(wide) | two) << np.uint64(low) | at
        key.sort()
        pair = key >> np.uint64(low)
        edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, int)
        counts = np.diff(np.append(edge, len(pair)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(often):
            break
        pairs, counts, edge = pair[edge[often]], counts[often], edge[often]
        rank_of = np.empty(len(pairs), np.uint64)
        rank_of[np.argsort(-counts, kind="stable")] = np.arange(len(pairs), dtype=np.uint64)
        # Their places in order, each with the rank of its pair.
        by_place = (key[ragged(edge, counts)] & np.uint64((1 << low) - 1)) << np.uint64(32) | np.repeat(rank_of, counts)
        by_place.sort()
        at, rank = (by_place >> np.uint64(32)).astype(np.int64), (by_place & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # A pair is replaced where no neighbour has a better rank; equal ranks overlap in runs (aaa), from the left.
        none = len(pairs)
        close = np.diff(at) == 1
        before = np.append(none, np.where(close, rank[:-1], none))
        after = np.append(np.where(close, rank[1:], none), none)
        pick = (rank <= before) & (rank <= after)
        twin = pick & np.append(False, pick[:-1]) & (rank == before)
        if twin.any():
            where = np.flatnonzero(pick)
            head = ~twin[where]
            start = where[head][np.cumsum(head) - 1]
            pick[where[(where - start) % 2 == 1]] = False
        where = at[pick]
        used = np.zeros(none, bool)
        used[rank[pick]] = True
        number = np.cumsum(used) - 1
        chosen = pairs[np.argsort(rank_of)][used]
        rules.append(np.stack([chosen >> np.uint64(wide), chosen & np.uint64((1 << wide) - 1)], 1).astype(np.uint32))
        seq[where] = (made + number[rank[pick]]).astype(np.uint32)
        made += len(rules[-1])
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        # Frequent pairs that are left: neither symbol went into a new one.
        new = np.zeros(len(seq) + 1, bool)
        new[where] = True
        rest = at[~pick]
        rest = rest[~new[rest] & ~new[rest + 1] & keep[rest]]
        seq = seq[keep]
        beside = np.zeros(len(seq) + 1, bool)
        place = where - np.arange(len(where))
        beside[place] = beside[place - 1] = beside[rest - np.searchsorted(where, rest)] = True
        at = np.flatnonzero(beside[: len(seq) - 1]).astype(np.uint64)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only names earlier ones."""
    out = np.ones(len(rules), np.int64)
    open_ = np.arange(len(rules))
    known = np.zeros(len(rules), bool)
    while len(open_):
        a, b = rules[open_, 0].astype(np.int64) - first, rules[open_, 1].astype(np.int64) - first
        ready = ((a < 0) | known[np.maximum(a, 0)]) & ((b < 0) | known[np.maximum(b, 0)])
        now = open_[ready]
        out[now] = np.where(a < 0, 1, out[np.maximum(a, 0)])[ready] + np.where(b < 0, 1, out[np.maximum(b, 0)])[ready]
        known[now] = True
        open_ = open_[~ready]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; lengths: of the rules' expansions, if they are at hand."""
    lengths = (expansion_lengths(rules, first) if lengths is None else lengths).astype(np.int64)
    # All rules once, a level at a time; then every symbol takes its run.
    table = np.arange(first, first + len(rules), dtype=np.uint32)
    while (deep := table >= first).any():
        width = 1 + deep.astype(np.int64)
        at = np.cumsum(width) - width
        new = np.empty(int(width.sum()), np.uint32)
        new[at[~deep]] = table[~deep]
        pair = rules[table[deep] - np.uint32(first)]
        new[at[deep]], new[at[deep] + 1] = pair[:, 0], pair[:, 1]
        table = new
    deep = np.flatnonzero(symbols >= first)
    rule = symbols[deep].astype(np.int64) - first
    width = np.ones(len(symbols), np.int64)
    width[deep] = lengths[rule]
    out = np.repeat(symbols.astype(np.uint32), width)
    begin = np.cumsum(lengths) - lengths
    out[ragged((np.cumsum(width) - width)[deep], width[deep])] = table[ragged(begin[rule], width[deep])]
    return out


class Shard:
    """One shard, read from its bytes."""

    def __init__(self, payload: bytes) -> None:
        magic, version, width, self.first, n_rules, n_symbols, n_docs, self.n_tokens = HEADER.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.symbols = take(f"<u{width}", n_symbols)
        self.doc_ids, self.has_id, self.sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<i8", n_docs)
        self._ends: np.ndarray | None = None

    @staticmethod
    def write(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, first: int) -> bytes:
        rules, symbols = compress(ids, first, END_ID)
        width = 2 if first + len(rules) <= 1 << 16 else 4
        lengths = expansion_lengths(rules, first).astype("<u4")
        head = HEADER.pack(MAGIC, VERSION, width, first, len(rules), len(symbols), len(doc_ids), len(ids))
        known = np.array([i is not None for i in doc_ids], "u1")
        numbers = np.array([i or 0 for i in doc_ids], "<i8")
        return b"".join([head, rules.astype("<u4").tobytes(), lengths.tobytes(), symbols.astype(f"<u{width}").tobytes(), numbers.tobytes(), known.tobytes(), np.asarray(sizes, "<i8").tobytes()])

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first, self.lengths)

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from start on, decoding only the symbols that cover them."""
        if self._ends is None:
            symbols = self.symbols.astype(np.int64)
            deep = symbols >= self.first
            size = np.ones(len(symbols), np.int64)
            size[deep] = self.lengths[symbols[deep] - self.first]
            self._ends = np.cumsum(size)
        a = int(np.searchsorted(self._ends, start, "right"))
        b = int(np.searchsorted(self._ends, start + n, "left")) + 1
        skip = start - (int(self._ends[a - 1]) if a else 0)
        return expand(self.symbols[a:b], self.rules, self.first, self.lengths)[skip : skip + n]


class LibraryCoder:
    """Texts encoded by the tokenizers library, which normalises, splits and merges.

    Where the tokenizer drops white space between words and neither it nor the normaliser looks across it, a text's ids
    are those of its pieces between spaces and line feeds, one after the other: each distinct piece is encoded once and
    remembered. For other tokenizers the library gets the whole texts.

    Many short pieces are one text for the library, each with MARK behind it, a word that is one id of its own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.pieces = ChunkCoder(self._encode_pieces, CACHE_CHUNKS) if parts_at_spaces(json.load(f)) else None
        mark = self._encode([f" {MARK} "])[1]
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        for a in range(0, len(texts), CALL_TEXTS):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[a : a + CALL_TEXTS], add_special_tokens=False)]
            lengths[a : a + len(found)] = [len(x) for x in found]
            parts.append(np.fromiter(chain.from_iterable(found), np.int32, int(lengths[a : a + len(found)].sum())))
        return lengths, np.concatenate(parts)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = [i for i, x in enumerate(pieces) if MARK in x]
        if held or self.mark is None:  # texts that hold the mark themselves, one by one
            if self.mark is None or len(held) == len(pieces):
                return self._encode(pieces)
            rest = np.setdiff1d(np.arange(len(pieces)), held)
            parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
            for at, (lengths, ids) in ((rest, self._encode_pieces([pieces[i] for i in rest.tolist()])), (held, self._encode([pieces[i] for i in held]))):
                for i, x in zip(at, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                    parts[i] = x
            return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
        ids = self._encode([f" {MARK} ".join([*pieces[a : a + JOINED], ""]) for a in range(0, len(pieces), JOINED)])[1]
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(pieces):
            return self._encode(pieces)
        return np.diff(np.append(-1, ends)) - 1, ids[ids != self.mark]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        return self._encode(texts.to_pylist()) if self.pieces is None else self.pieces.encode_texts(texts)


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's words never hold or touch white space that matters: by its normalisers, by its split, which
    keeps what a pattern without white space matches, and by its added tokens."""
    normal = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    local = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in steps)
    cut = spec["pre_tokenizer"] or {"type": ""}
    cuts = cut["pretokenizers"] if cut["type"] == "Sequence" else [cut]
    split = cuts[0].get("type") == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[0]["pattern"] == {"Regex": WORD_PATTERN}
    rest = all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in cuts[1:])
    added = all(not t["content"].split()[1:] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    return local and split and rest and added


@lru_cache(2)
def _coder(name: str) -> tuple[LibraryCoder, int]:
    """The library's encoder, and its number of ids."""
    # A task has one core: its texts are encoded one after the other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = LibraryCoder(vocabulary_path(name))
    return coder, coder.tokenizer.get_vocab_size(with_added_tokens=True)


def write_shards(docs: DataFrame, work: Workspace, name: str = VOCABULARY, table: str = "shards") -> DataFrame:
    """Writes the shards (SHARD) and reads them.

    part and shard number them in the order of doc_id; inside counts the ids of the part's shards before.
    """
    ship(docs.sparkSession)
    key = F.col("doc_id").cast("long").alias("doc_id")
    ordered = docs.select(key, text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, inside = TaskContext.get().partitionId(), 0, 0
        coder, first = _coder(name)
        doc_ids: list[int | None] = []
        sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def out(docs: int) -> pa.RecordBatch:
            """The shard of the first documents that are held."""
            nonlocal doc_ids, sizes, ids, shard, inside
            n = int(sizes[:docs].sum())
            row = [part, shard, docs, n, inside, Shard.write(ids[:n], doc_ids[:docs], sizes[:docs], first)]
            doc_ids, sizes, ids, shard, inside = doc_ids[docs:], sizes[docs:], ids[n:], shard + 1, inside + n
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "shard", "n_docs", "n_tokens", "inside", "payload"])

        for batch in slices(batches, "text", SLICE_BYTES):
            lengths, found = coder.encode_texts(batch.column("text"))
            ended = np.full(len(found) + len(lengths), END_ID, np.uint32)
            ended[ragged(np.cumsum(lengths) - lengths + np.arange(len(lengths)), lengths)] = found
            doc_ids += batch.column("doc_id").to_pylist()
            sizes, ids = np.append(sizes, lengths + 1), np.append(ids, ended)
            while len(ids) >= SHARD_TOKENS:
                yield out(1 + int(np.searchsorted(np.cumsum(sizes), SHARD_TOKENS)))
        if len(sizes):
            yield out(len(sizes))

    return work.save(ordered.mapInArrow(run, SHARD), table)


def read_shards(shards: DataFrame) -> DataFrame:
    """DOCUMENT of each document, from the shards' bytes."""
    spark = shards.sparkSession
    ship(spark)
    # A row for each task that wrote: as few as the partitions of one shuffle.
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.append(0, np.cumsum([n for _, n in totals])).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    bases = F.broadcast(bases) if len(totals) <= MOST_BROADCAST else bases
    placed = shards.join(bases, "part").select((F.col("base") + F.col("inside")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.sizes)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - shard.sizes).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, mask=~shard.has_id), pa.array(start + ends - shard.sizes), pa.array(shard.sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, DOCUMENT)


def token_shards(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """DOCUMENT of each document, written to shards and read back."""
    return read_shards(write_shards(docs, Workspace(docs.sparkSession, "tokens"), name))
