"""BPE encoding and decoding (9): merge rounds in numpy over the symbols of many words at once.

A text is cut at spaces and line feeds into chunks. No token spans them, so a text's ids are its chunks' ids in a row,
and each distinct chunk is encoded once. Encoding a batch of chunks: canonical composition and lower case, the split
into words, then one flat array with the byte symbols of all distinct words. In each round the rank of every adjacent
pair is found by binary search over the sorted pair keys, and every word merges its lowest-rank pair, leftmost first,
until no pair is left. Decoding maps ids to their tokens, joined by one space as the vocabulary has no decoder.

Memory is bounded by SLICE_BYTES of text and CACHE_CHUNKS remembered chunks and words. Defined cases: null texts count as empty;
an empty text has no ids; an empty table gives an empty result; further columns are ignored; rows stand for themselves,
repeated or not.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returns_memory, ship, text_or_empty

#: The tokenizer's file among the public ones; a path with a slash is taken as it is.
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are worked on together, and chunks that a worker remembers.
SLICE_BYTES, CACHE_CHUNKS = 2_000_000, 250_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most `most` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The chunks of texts: offsets of each text, chunk numbers, and the distinct chunks."""
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class WordBpe:
    """A vocabulary of BPE with word ends over bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # Printable bytes stand for themselves, the others for the characters from 256 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        char = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + self.end] for b in range(256)], np.int64)
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        import regex

        # The vocabulary's own pattern of words; a line feed here parts the chunks.
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.words = ChunkCoder(self.merge_words)
        self.find = regex.compile(words + r"|\n").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each position; _NONE if it has none or ends its word."""
        if not len(at):
            return np.zeros(0, np.int64)
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] << 32 | sym[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (word[at] == word[after]) & (after > at), self.ranks[found], _NONE)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and the flat ids of words."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(raw)), lengths)
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[data[ends]]
        rank = self._ranks(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(sym))))
            over = best == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
            pick = rank == best
            # Pairs of one symbol overlap in a run (aaa): every other one from the left.
            twin = np.append(False, pick[1:] & pick[:-1])
            if twin.any():
                where = np.flatnonzero(pick)
                head = ~twin[where]
                start = where[head][np.cumsum(head) - 1]
                pick[where[(where - start) % 2 == 1]] = False
            where = np.flatnonzero(pick)
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # Only the pairs beside a new symbol have changed.
            new = where - np.arange(len(where))
            beside = np.unique(np.concatenate([new, np.maximum(new - 1, 0)]))
            rank[beside] = self._ranks(sym, word, beside)
        if not done_sym:
            return np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        flat, owner = np.concatenate(done_sym), np.concatenate(done_word)
        return np.bincount(owner, minlength=len(words)), flat[np.argsort(owner, kind="stable")]

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Each character by itself: a final sigma is not treated apart.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and the flat ids of chunks, which hold no line feed."""
        held = [i for i, c in enumerate(chunks) if self.cut and "<" in c and any(s in c for s in self.special)]
        plain = list(chunks)
        for i in held:
            plain[i] = ""
        found = self.find(self._normal("\n".join(plain)))
        words = self.words
        distinct = list(dict.fromkeys(found))
        words.numbers(distinct)
        coded = np.fromiter(map(words.number.__getitem__, found), np.int64, len(found))
        lengths, starts, flat = words.lengths, words.starts, words.ids
        feed = words.number.get("\n", -1)
        owner, coded = np.cumsum(coded == feed)[coded != feed], coded[coded != feed]
        sizes = np.zeros(len(chunks), np.int64)
        np.add.at(sizes, owner, lengths[coded])
        ids = flat[ragged(starts[coded], lengths[coded])] if len(coded) else np.zeros(0, np.int64)
        if held:  # texts with special tokens, piece by piece
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in held:
                pieces = [np.array([self.special[p]]) if p in self.special else self.encode_chunks([p])[1] for p in self.cut(chunks[i]) if p]
                parts[i] = np.concatenate(pieces)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return sizes, ids


class ChunkCoder:
    """Ids of chunks, remembered: `starts`, `lengths` and `ids` over chunk numbers."""

    def __init__(self, encode, most: int = CACHE_CHUNKS) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of distinct chunks; those not seen are encoded."""
        if len(self.number) > self.most:
            self.clear()
        found = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        at = np.flatnonzero(found < 0)
        if len(at):
            base = len(self.number)
            new = [chunks[i] for i in at.tolist()]
            self.number.update(zip(new, range(base, base + len(new)), strict=True))
            lengths, ids = self.encode(new)
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
            self.starts = np.cumsum(self.lengths) - self.lengths
            found[at] = np.arange(base, base + len(new))
        return found

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        offsets, coded, distinct = chunks_of(texts)
        at = self.numbers(distinct)[coded] if len(distinct) else coded.astype(np.int64)
        lengths = self.lengths[at] if len(at) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(lengths))
        ids = self.ids[ragged(self.starts[at], lengths)] if len(at) else np.zeros(0, np.int64)
        return ends[offsets[1:]] - ends[offsets[:-1]], ids


@lru_cache(2)
def load(name: str) -> WordBpe:
    return WordBpe(vocabulary_path(name))


@lru_cache(2)
def coder(name: str) -> ChunkCoder:
    return ChunkCoder(load(name).encode_chunks)


def forget(name: str) -> None:
    """Forgets chunks and words at the end of a task, so that other stages have the worker's memory."""
    coder(name).clear()
    load(name).words.clear()


@lru_cache(2)
def _written(name: str) -> tuple[pa.Array, pa.Array]:
    """Of each id: its decimal digits and its token."""
    tokens = load(name).tokens
    return pa.array([str(i) for i in range(len(tokens))]), pa.array(tokens)


def decode(ids: np.ndarray, lengths: np.ndarray, name: str = VOCABULARY) -> pa.Array:
    """The decoded texts of runs of ids: their tokens joined by one space."""
    return _joined(_written(name)[1], ids, lengths)


def _joined(words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(ids))), " ")


def _sha256(texts: pa.Array) -> list[str]:
    data = memoryview(texts.buffers()[2] or b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def encode_column(docs: DataFrame, out: str = "ids", keep: list[str] | None = None, name: str = VOCABULARY) -> DataFrame:
    """The columns `keep` of docs (else all) and the array column `out`: the ids of its text."""
    ship(docs.sparkSession)
    kept = [c for c in keep or docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_tl_text"):
            lengths, ids = coder(name).encode_texts(batch.column("_tl_text"))
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], [*kept, out])
        forget(name)

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty().alias("_tl_text")).mapInArrow(returns_memory(run), schema)


def round_trip(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """RESULT: the number of ids and the digests of the ids and of the text decoded from them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = _written(name)[0]
        for batch in slices(batches):
            lengths, ids = coder(name).encode_texts(batch.column("text"))
            found = [batch.column("doc_id"), pa.array(lengths), pa.array(_sha256(_joined(digits, ids, lengths))), pa.array(_sha256(decode(ids, lengths, name)))]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        forget(name)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(returns_memory(run), RESULT)
