"""Suffix-array dedup (5): bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

A suffix array of the whole corpus is not kept anywhere. Of the 20-byte grams of every 50-byte string the one with the
smallest hash is its anchor; equal strings have equal anchors. So

1. every pack finds its anchors and sends their hashes, a bucket at a time; a bucket answers which of them occur in
   more than one text;
2. packs send the strings around those anchors (the runs of strings that one anchor serves, as one piece of text),
   equal pieces once, to the anchor's bucket;
3. a bucket sorts the suffixes of its pieces in two stages: only suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets of first bytes; neighbours with a common prefix of 50 bytes
   are equal strings, and the smallest doc_id among them says who loses which;
4. packs mark what is lost and drop it.

Whole copies of a text are recognised by their digest and need no sorting.

Defined cases: null texts count as empty; a null doc_id counts as larger than all numbers; rows with the same doc_id
never delete from each other; texts below 50 bytes stay whole; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import Workspace, ship
from .packs import NO_ID, Pack, batch_of, digest_table, later_copies, make_packs, packs_in, squeeze, unsqueeze

#: Bytes of a repeated string, of a gram, and so the grams in a string.
LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of text that a bucket of the exchanges stands for, and least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8_000_000, 48
#: Bytes hashed at once, to stay in the processor's cache.
BLOCK = 1 << 18
#: Low bits of a window's key that hold the position.
_AT = np.uint64((1 << 31) - 1)
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15
SENT = "bucket int, pack long, hashes binary, docs binary, contents binary"
ANSWER = "pack long, bucket int, hashes binary"
PIECES = "bucket int, pack long, owners binary, lengths binary, texts binary"
LOST = "pack long, bucket int, owners binary, masks binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    power = lambda n: np.uint64(pow(_MULT, n, 1 << 64))
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    h1 = _TABLE[data]
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    h = h16[:-4] * power(4) + h4[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _block_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that end at `ends`: the runs of windows with one anchor: first window, number, hash and document."""
    n = len(data)
    h = gram_hashes(data)
    if len(h) < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    m = h & ~_AT
    m |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < SPAN:
        m = np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :])
    anchor = (m & _AT).astype(np.int64)  # of the window at each position
    # Windows that begin less than LENGTH before a document's end do not count.
    valid = np.ones(len(anchor), bool)
    sizes = np.diff(np.append(0, ends))
    tail = np.minimum(sizes, LENGTH - 1)
    dead = ragged(ends - tail, tail)
    valid[dead[dead < len(valid)]] = False
    doc = np.repeat(np.arange(len(ends)), sizes)[:n]
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    a = anchor[at]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (doc[at[1:]] != doc[at[:-1]])))
    count = np.diff(np.append(first, len(at)))
    return at[first], count, h[a[first]], doc[at[first]]


def runs(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a pack: first window (a position in its data), number of windows, anchor's hash and document."""
    out: list[tuple] = []
    edges = np.flatnonzero(np.diff(np.append(-1, pack.ends // BLOCK)))
    a = 0
    for b in [*edges.tolist(), len(pack.ids)]:
        if b > a:
            start = int(pack.starts[a])
            spot, count, h, doc = _block_runs(pack.data[start : int(pack.ends[b - 1])], pack.ends[a:b] - start)
            out.append((spot + start, count, h, doc + a))
            a = b
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def send_anchors(pack: Pack, buckets: int) -> list[tuple]:
    """Rows of SENT: each anchor of the pack once, with its text, or with none if the pack has it in several texts."""
    _, _, h, doc = runs(pack)
    if not len(h):
        return []
    content = pack.digests[:, 0]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    low, high = np.minimum.reduceat(content[doc], first), np.maximum.reduceat(content[doc], first)
    h, doc, many = h[first], doc[first], low != high
    where = bucket_of(h, buckets)
    order = np.argsort(where, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        own, back = np.unique(doc[part], return_inverse=True)
        marks = np.where(many[part], 0, back + 1)
        kind = np.uint16 if len(own) < 1 << 16 else np.uint32
        # 48 of the 64 bits: the bucket holds others, and a chance meeting only means one more candidate.
        six = (h[part] & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
        rows.append((int(where[part[0]]), pack.pack, six.tobytes(), marks.astype(kind).tobytes(), content[own].tobytes()))
    return rows


def _six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def repeated_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: for each pack those of its anchors that more than one text has."""
    hashes, texts, owner = [], [], []
    for i, row in enumerate(pdf.itertuples(index=False)):
        h = _six(row.hashes)
        contents = np.append(np.uint64(0), np.frombuffer(row.contents, np.uint64))
        marks = np.frombuffer(row.docs, np.uint16 if len(row.docs) == 2 * len(h) else np.uint32)
        hashes.append(h)
        texts.append(np.where(marks > 0, contents[marks], np.uint64(i + 1)))
        owner.append(np.where(marks > 0, i, -i - 1))  # below 0: several texts already
    h, t, o = np.concatenate(hashes), np.concatenate(texts), np.concatenate(owner)
    order = np.argsort(h, kind="stable")
    h, t, o = h[order], t[order], o[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    several = (np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)) | (np.minimum.reduceat(o, first) < 0)
    keep = np.repeat(several, size)
    h, o = h[keep], np.where(o[keep] < 0, -o[keep] - 1, o[keep])
    order = np.argsort(o, kind="stable")
    h, o = h[order], o[order]
    at = np.searchsorted(o, np.arange(len(pdf) + 1))
    packs, bucket = pdf["pack"].to_numpy(), int(pdf["bucket"].iloc[0])
    rows = [(int(packs[i]), bucket, np.ascontiguousarray(h[at[i] : at[i + 1]].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()) for i in range(len(pdf)) if at[i + 1] > at[i]]
    return pd.DataFrame(rows, columns=["pack", "bucket", "hashes"])


def pieces_of(pack: Pack, known: dict[int, bytes], copies: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Of each bucket: the runs around repeated anchors (first windows, numbers of windows, doc_ids), the distinct pieces
    of text that they are, and which each is."""
    spot, count, h, doc = runs(pack)
    if not len(h):
        return
    where = bucket_of(h, buckets)
    low = h & np.uint64((1 << 48) - 1)
    is_copy = np.zeros(len(pack.ids), bool)
    is_copy[copies] = True
    live = np.flatnonzero(~is_copy[doc])
    live = live[np.argsort(where[live], kind="stable")]
    for part in np.split(live, np.flatnonzero(np.diff(where[live])) + 1):
        bucket = int(where[part[0]]) if len(part) else -1
        if bucket not in known:
            continue
        wanted = np.sort(_six(known[bucket]))
        at = np.minimum(np.searchsorted(wanted, low[part]), len(wanted) - 1)
        part = part[wanted[at] == low[part]]
        if not len(part):
            continue
        number: dict[bytes, int] = {}
        size = count[part] + LENGTH - 1
        which = np.fromiter((number.setdefault(pack.raw[a:b], len(number)) for a, b in zip(spot[part].tolist(), (spot[part] + size).tolist(), strict=True)), np.int64, len(part))
        yield bucket, spot[part], count[part], pack.ids[doc[part]], list(number), which


def send_pieces(pack: Pack, known: dict[int, bytes], copies: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of PIECES: the distinct pieces of text around repeated anchors, and the smallest doc_id of each.

    Where they stand stays with the pack, so a passage that very many documents hold is one row of each pack.
    """
    rows = []
    for bucket, _, _, ids, texts, which in pieces_of(pack, known, copies, buckets):
        owners = np.full(len(texts), NO_ID)
        np.minimum.at(owners, which, ids)
        rows.append((bucket, pack.pack, owners.tobytes(), np.array([len(t) for t in texts], np.int32).tobytes(), squeeze(b"".join(texts))))
    return rows


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `text` (numbers below 512, its last one 0 and smallest) in the order of their first `depth` symbols.

    Two stages: the suffixes smaller than their successors are sorted directly, a word of seven symbols at a time within
    the groups that are still equal; the others follow from them, as a suffix larger than its successor stands in its
    bucket (of the first symbol) in the order of the successors. Buckets are scanned from the smallest; a bucket's own
    suffixes that induce others in it (runs of one symbol) go in rounds.
    """
    n = len(text)
    # small[i]: the suffix at i is smaller than the one at i + 1; in a run of one symbol as after the run.
    change = np.append(text[1:] != text[:-1], True)
    ends = np.flatnonzero(change)
    run = np.cumsum(change) - change
    small = (text[ends] < text[np.minimum(ends + 1, n - 1)])[run]
    small[n - 1] = True
    del change, ends, run

    words = -(-depth // 7)
    padded = np.append(text, np.zeros(7 * words + 7, text.dtype)).astype(np.uint16)
    packed = np.zeros(n + 7 * words, np.uint64)
    for k in range(7):
        packed <<= np.uint64(9)
        packed |= padded[k : k + len(packed)]
    direct = np.flatnonzero(small)
    key = packed[direct]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    for word in range(1, words):
        twin = np.append(False, group[1:] == group[:-1])
        open_ = np.flatnonzero(twin | np.append(twin[1:], False))
        if not len(open_):
            break
        key = packed[direct[open_] + 7 * word]
        order = np.lexsort((key, group[open_]))
        direct[open_] = direct[open_][order]
        key, own = key[order], group[open_]
        step = np.append(0, (key[1:] != key[:-1]) & (own[1:] == own[:-1]))
        # Groups keep their order; what is now told apart gets numbers between them.
        new = group * 1
        new[open_] = 0
        fresh = np.zeros(len(group), np.int64)
        fresh[open_] = step
        group = np.cumsum(np.append(0, (group[1:] != group[:-1]) | (fresh[1:] > 0)))

    del packed, padded, key, group
    symbols = int(text.max()) + 1
    total, smalls = np.bincount(text, minlength=symbols), np.bincount(text[direct], minlength=symbols)
    ends = np.cumsum(total)
    head = ends - total
    out = np.empty(n, np.int64)
    # Within a bucket the larger-than-successor suffixes come before the smaller ones.
    place = np.repeat(ends - smalls, smalls) + ragged(np.zeros(symbols, np.int64), smalls)
    out[place] = direct
    fill = head.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        to = text[before]
        order = np.argsort(to, kind="stable")
        to, before = to[order], before[order]
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        size = np.diff(np.append(first, len(to)))
        out[np.repeat(fill[to[first]], size) + ragged(np.zeros(len(first), np.int64), size)] = before
        fill[to[first]] += size

    for symbol in np.flatnonzero(total):
        done = head[symbol]
        while done < fill[symbol]:
            now, done = done, fill[symbol]
            induce(out[now:done])
        induce(out[ends[symbol] - smalls[symbol] : ends[symbol]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix in order, how many symbols it shares with the one before; at most depth."""
    out = np.zeros(len(order), np.int64)
    padded = np.append(text, np.zeros(depth, text.dtype))
    open_ = np.arange(1, len(order))
    for k in range(depth):
        a, b = padded[order[open_] + k], padded[order[open_ - 1] + k]
        open_ = open_[(a == b) & (a > 0)]
        if not len(open_):
            break
        out[open_] = k + 1
    return out


def lost_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: for each of a pack's pieces the smallest doc_id that has it and, as bits, its windows that a smaller
    doc_id still has in another piece."""
    number: dict[bytes, int] = {}
    rows = []
    for row in pdf.itertuples(index=False):
        ends = np.cumsum(np.frombuffer(row.lengths, np.int32)).tolist()
        raw = unsqueeze(row.texts)
        of = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends))
        rows.append((row.pack, np.frombuffer(row.owners, np.int64), of))
    owner = np.full(len(number), NO_ID)
    for _, own, of in rows:
        np.minimum.at(owner, of, own)
    raw = [*number]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    # Pieces end with 0, which stands for no byte.
    text = np.zeros(len(data) + len(raw), np.uint16)
    begin = np.cumsum(size + 1) - size - 1
    text[ragged(begin, size)] = data.astype(np.uint16) + np.uint16(1)
    order = sort_suffixes(text, LENGTH)
    piece = np.repeat(np.arange(len(raw)), size + 1)
    room = (begin + size)[piece] - np.arange(len(text)) >= LENGTH
    order = order[room[order]]
    shared = common_prefixes(text, order, LENGTH) >= LENGTH
    first = np.flatnonzero(~shared)
    least = np.repeat(np.minimum.reduceat(owner[piece[order]], first), np.diff(np.append(first, len(order))))
    gone = least < owner[piece[order]]
    mask = np.zeros(len(raw), np.int64)
    np.bitwise_or.at(mask, piece[order[gone]], np.int64(1) << (order[gone] - begin[piece[order[gone]]]))
    bucket = int(pdf["bucket"].iloc[0])
    out = [(pack, bucket, owner[of].tobytes(), squeeze(mask[of].tobytes())) for pack, _, of in rows]
    return pd.DataFrame(out, columns=["pack", "bucket", "owners", "masks"])


def removed_bytes(pack: Pack, known: dict[int, bytes], copies: np.ndarray, answers: dict[int, tuple[bytes, bytes]], buckets: int) -> np.ndarray:
    """Which bytes of a pack's data go. known and answers: by bucket."""
    edge = np.zeros(len(pack.data) + 1, np.int32)
    for bucket, spot, count, ids, _, which in pieces_of(pack, known, copies, buckets):
        owners, masks = np.frombuffer(answers[bucket][0], np.int64), np.frombuffer(unsqueeze(answers[bucket][1]), np.int64)
        lost = np.where(ids > owners[which], (np.int64(1) << count) - 1, masks[which])
        spot, lost = spot[lost != 0], lost[lost != 0]
        for k in range(SPAN):
            at = spot[(lost >> k) & 1 == 1] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
    for i in copies.tolist():
        if pack.sizes[i] >= LENGTH:
            edge[pack.starts[i]] += 1
            edge[pack.ends[i]] -= 1
    return np.cumsum(edge[:-1]) > 0


def whole_copies(packs: DataFrame, work: Workspace) -> DataFrame:
    """pack and copies: the numbers of its documents whose whole text a smaller doc_id has."""
    digests = digest_table(packs, work)
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return later_copies(digests, work.save(first, "firsts"), F.col("doc_id") > F.col("least"))


def buckets_for(packs: DataFrame) -> int:
    total = packs.agg(F.sum("bytes")).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """RESULT of each document."""
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "suffix")
    packs = make_packs(docs, work)
    buckets = buckets_for(packs)
    copies = work.save(whole_copies(packs, work), "copies")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pack,) in packs_in(batches):
            if rows := send_anchors(pack, buckets):
                yield batch_of(SENT, *map(list, zip(*rows, strict=True)))

    known = work.save(packs.mapInArrow(anchors, SENT).groupBy("bucket").applyInPandas(repeated_anchors, ANSWER), "known")
    told = known.groupBy("pack").agg(F.collect_list(F.struct("bucket", "hashes")).alias("known"))
    with_known = packs.join(told.hint("merge"), "pack").join(copies.hint("merge"), "pack", "left")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, found, gone in packs_in(batches, "known", "copies"):
            if rows := send_pieces(pack, {x["bucket"]: x["hashes"] for x in found}, np.array(gone or [], np.int64), buckets):
                yield batch_of(PIECES, *map(list, zip(*rows, strict=True)))

    lost = work.save(with_known.mapInArrow(pieces, PIECES).groupBy("bucket").applyInPandas(lost_windows, LOST), "lost")
    # Packs without a repeated anchor have neither.
    masks = lost.groupBy("pack").agg(F.collect_list(F.struct("bucket", "owners", "masks")).alias("lost"))
    marked = packs.join(told.hint("merge"), "pack", "left").join(masks.hint("merge"), "pack", "left").join(copies.hint("merge"), "pack", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, told, found, gone in packs_in(batches, "known", "lost", "copies"):
            known = {x["bucket"]: x["hashes"] for x in told or []}
            away = removed_bytes(pack, known, np.array(gone or [], np.int64), {x["bucket"]: (x["owners"], x["masks"]) for x in found or []}, buckets)
            total = np.append(0, np.cumsum(away))
            begins = away & ~np.append(False, away[:-1])
            begins[pack.starts[pack.sizes > 0]] = away[pack.starts[pack.sizes > 0]]
            spans = np.append(0, np.cumsum(begins))
            kept = pack.data[~away].tobytes()
            left = np.append(0, np.cumsum(~away))
            digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[pack.starts].tolist(), left[pack.ends].tolist(), strict=True)]
            ids = [None if i == NO_ID else i for i in pack.ids.tolist()]
            yield batch_of(RESULT, ids, pack.sizes, total[pack.ends] - total[pack.starts], spans[pack.ends] - spans[pack.starts], digests)

    return marked.mapInArrow(cut, RESULT)
