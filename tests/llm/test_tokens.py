from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import bpe, token_shards

from .helpers import documents

tokenizers = pytest.importorskip("tokenizers")
POOL = "aaaabcdefgh  \n\t'’.,!?0123ÀéèßΣσςİıﬁ½²①漢字ひらा́\x1c\x85 <|startoftext|>😀👍🏽'll's't're"


def texts():
    rng = random.Random(7)
    out = ["", " ", "aaa aaaa aaaaaaaa", "<|startoftext|>hi<|endoftext|> x", "a<|startoftext|>b", "ΟΔΟΣ Σ", "é ́e", "it's I'LL don't 'Sa", "long word " * 4000]
    extra = ["hello", "World", "<|endoftext|>", " "]
    return out + ["".join(rng.choice(POOL) if rng.random() < 0.8 else rng.choice(extra) for _ in range(rng.randrange(60))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))


def test_own_merges_and_the_library_agree(library):
    want = [x.ids for x in library.encode_batch(texts(), add_special_tokens=False)]
    for coder in (bpe.coder(bpe.VOCABULARY), token_shards._coder(bpe.VOCABULARY)[0]):
        lengths, ids = coder.encode_texts(pa.array(texts()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    lengths, ids = bpe.coder(bpe.VOCABULARY).encode_texts(pa.array(texts()))
    assert bpe.decode(ids, lengths).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]


def test_round_trip(spark, library):
    rows = [(i, t, "s") for i, t in enumerate(texts())] + [(9999, None, None), (3, "twice", "s"), (None, "no id", "s")]
    got = sorted(map(tuple, bpe.round_trip(documents(spark, rows)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(documents(spark, [])).count() == 0
    assert bpe.encode_column(documents(spark, rows)).columns[-1] == "ids"


def test_shards(spark, library):
    rows = [(i, t, "s") for i, t in enumerate(texts())] + [(9999, None, None), (3, "twice", "s"), (None, "no id", "s")]
    got = [tuple(r) for r in token_shards.token_shards(documents(spark, rows)).collect()]
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_shards.token_shards(documents(spark, [])).count() == 0


@pytest.mark.parametrize("first", [50, 70_000])
def test_grammar_round_trip_and_ranges(first):
    rng = np.random.default_rng(first)
    ids = np.concatenate([rng.integers(0, 5, 5000), np.ones(300, int), np.tile([3, 4, 3, 3, 4], 500)])
    ids[::40] = token_shards.END_ID
    shard = token_shards.Shard(token_shards.Shard.write(ids, [1, None], np.array([4000, len(ids) - 4000]), first))
    assert shard.ids().tolist() == ids.tolist() and len(shard.symbols) < len(ids) / 2
    for a in range(0, len(ids) - 30, 97):
        assert shard.range(a, 30).tolist() == ids[a : a + 30].tolist()


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = random.Random(12)
    ids = np.array([rng.randrange(3, 30000) for _ in range(512)] * 200, np.uint32)
    rules, left = token_shards.compress(ids, 40000, 2)
    assert (token_shards.expand(left, rules, 40000) == ids).all()
    counts = np.unique(np.stack([left[:-1], left[1:]], 1), axis=0, return_counts=True)[1]
    assert counts.max(initial=0) < token_shards.LEAST_COUNT and len(left) < 1000


def test_pieces_that_hold_the_mark_and_whole_texts_without_pieces(library):
    mark = token_shards.MARK
    every = [f"a{mark}b", mark, f"{mark} {mark}", "", "plain words", f"x {mark}", *(f"w{k}, W{k}!" for k in range(200))]
    want = [library.encode(x, add_special_tokens=False).ids for x in every]
    coder = token_shards.LibraryCoder(bpe.vocabulary_path(bpe.VOCABULARY))
    assert coder.pieces is not None and coder.mark is not None
    for pieces in (coder.pieces, None):
        coder.pieces = pieces
        lengths, ids = coder.encode_texts(pa.array(every))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_texts_are_only_cut_for_tokenizers_that_part_at_spaces():
    assert token_shards.parts_at_spaces({"normalizer": None, "pre_tokenizer": {"type": "Metaspace"}, "added_tokens": []}) is False
