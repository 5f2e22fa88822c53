"""Where do windows of L symbols occur earlier? An exact exchange by anchors.

A document is a sequence of symbols (bytes, or hashed words). Each window of L
symbols is represented by its anchor, the k-gram of the least hash in it
(leftmost on ties): equal windows have equal anchors at equal offsets, wherever
they stand. The windows that share an anchor occurrence form one segment,
so a document has about 2 / (L - k + 2) segments a symbol.

Documents are dealt into small blocks by a hash of id and text. Each block
sends, per bucket of anchor values, its distinct (anchor, segment) pairs with
the earliest place of each: what repeats within a block is combined before
the shuffle, so no anchor has more entries than there are blocks times contexts.
A bucket answers for each entry whether the same segment stands earlier (all
its windows repeat), whether the anchor has other segments (they may share
some windows, which only a check of the windows can tell), or neither. Only
the latter segments, those at the ends of repeats, are checked window by
window or byte by byte.

"Earlier" compares (doc_id, start); a null id is larger than any other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BATCH_SYMBOLS = 1 << 20
BUCKET_ENTRIES = 400_000
PIECE = 1 << 20
LOW = np.uint64((1 << 24) - 1)
NO_ID = np.iinfo(np.int64).max
MULTIPLIER = 0x9E3779B97F4A7C15
NOTHING, REPEAT, CHECK, HOT = 0, 1, 2, 3


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Spans:
    """Hashes of any span of a symbol sequence from one running sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.inverse = _powers(pow(MULTIPLIER, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _powers(MULTIPLIER, n)[:n], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n - k + 1])


def least_positions(grams: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive grams, leftmost on ties of its upper 40 bits."""
    n = len(grams) - w + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)
        part = grams[at:at + m + w - 1]
        rows = -(-len(part) // w)
        key = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        key[:len(part)] = (part & ~LOW) | np.arange(len(part), dtype=np.uint64)
        key = key.reshape(rows, w)
        ahead = np.minimum.accumulate(key, axis=1).ravel()
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        out[at:at + m] = (np.minimum(back[:m], ahead[w - 1:w - 1 + m]) & LOW).astype(np.int64) + at
    return out


class Batch:
    """Some documents of a block: symbols, segments and how to read them."""

    def __init__(self, rows: np.ndarray, raw: bytes, symbols: np.ndarray, starts: np.ndarray, length: int, k: int,
                 word_at: np.ndarray | None = None, word_end: np.ndarray | None = None):
        self.rows, self.raw, self.starts, self.length = rows, raw, starts, length
        self.word_at, self.word_end = word_at, word_end
        n = len(symbols)
        self.n = n
        spans = Spans(symbols)
        grams = spans.grams(k)
        least = least_positions(grams, length - k + 1)
        sizes = np.diff(starts)
        doc_of = np.repeat(np.arange(len(rows)), np.maximum(sizes - length + 1, 0))
        within = np.arange(len(doc_of)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0),
                                                    np.maximum(sizes - length + 1, 0))
        valid = starts[:-1][doc_of] + within
        anchor = least[valid]
        cut = np.flatnonzero(np.diff(anchor, prepend=-1)) if len(anchor) else np.empty(0, dtype=np.int64)
        self.lo = valid[cut]
        self.hi = valid[np.append(cut[1:], len(valid)) - 1] if len(cut) else cut
        self.doc = doc_of[cut]
        at = anchor[cut]
        self.a = grams[at]
        shape = ((at - self.lo).astype(np.uint64) << np.uint64(32)) + (self.hi - self.lo).astype(np.uint64)
        self.s = mix(spans.hash(self.lo, self.hi + length) ^ mix(shape + np.uint64(1)))
        self.spans = spans

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, start) of every window of the chosen segments."""
        count = self.hi[which] - self.lo[which] + 1
        seg = np.repeat(which, count)
        first = np.repeat(np.cumsum(count) - count, count)
        return seg, self.lo[seg] + np.arange(len(seg)) - first


def byte_batches(texts: list, length: int, k: int):
    """Batches over the UTF-8 bytes of the texts."""
    table = mix(np.arange(1, 257, dtype=np.uint64))
    for rows, raw, starts in _grouped(texts):
        yield Batch(rows, raw, table[np.frombuffer(raw, dtype=np.uint8)], starts, length, k)


def word_symbols(raw: bytes, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A symbol for each word: its bytes, mixed reversibly, up to eight bytes
    without a zero byte; a cryptographic digest of 64 bits beyond. (A running
    polynomial modulo 2^64 gives equal values to long words of a known form.)"""
    size = end - at
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    keep = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)
    out = mix((eight[at] & keep[np.minimum(size, 8)]) + np.uint64(MULTIPLIER))
    zeros = np.cumsum(np.r_[False, data == 0])
    for_digest = np.flatnonzero((size > 8) | (zeros[end] > zeros[at]))
    if len(for_digest):
        digests = [hashlib.blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(at[for_digest].tolist(), end[for_digest].tolist())]
        out[for_digest] = np.frombuffer(b"".join(digests), np.uint64)
    return out


def word_batches(texts: list, length: int, k: int):
    """Batches over the words (runs of anything but ASCII white space)."""
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    for rows, raw, starts in _grouped(texts, sep=b" "):
        data = np.frombuffer(raw, dtype=np.uint8)
        inside = np.concatenate([[False], ~space[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        at, end = edge[::2], edge[1::2]
        yield Batch(rows, raw, word_symbols(raw, data, at, end), np.searchsorted(at, starts), length, k, at, end)


def _grouped(texts: list, sep: bytes = b""):
    """(row numbers, joined bytes, starts and end) for runs of texts of about BATCH_SYMBOLS bytes."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if parts and size + len(data) > BATCH_SYMBOLS:
            yield _joined(rows, parts, sep)
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(data)
        size += len(data) + len(sep)
    if parts:
        yield _joined(rows, parts, sep)


def _joined(rows: list, parts: list, sep: bytes):
    starts = np.cumsum([0, *(len(p) + len(sep) for p in parts)])
    return np.array(rows), b"".join(p + sep for p in parts) if sep else b"".join(parts), starts


class Block:
    """The batches of a block with their segments in the order of the exchange."""

    def __init__(self, table, batches, buckets: int, length: int, k: int):
        ids = table.column("doc_id").to_pylist()
        self.buckets = buckets
        self.ids = ids
        self.order_id = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.batches = list(batches(table.column("text").to_pylist(), length, k))
        join = lambda xs, t: np.concatenate([*xs, np.empty(0, dtype=t)])
        a = join([b.a for b in self.batches], np.uint64)
        s = join([b.s for b in self.batches], np.uint64)
        doc = join([self.order_id[b.rows[b.doc]] for b in self.batches], np.int64)
        pos = join([b.lo - b.starts[:-1][b.doc] for b in self.batches], np.int64)
        bucket = (a % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((pos, doc, s, a, bucket))
        a, s, doc, pos, bucket = (x[order] for x in (a, s, doc, pos, bucket))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        self.first = np.flatnonzero(new)
        self.a, self.s, self.doc, self.pos, self.bucket = (x[self.first] for x in (a, s, doc, pos, bucket))
        group = np.cumsum(new) - 1
        # per segment, in batch order: its entry, and whether it stands later than the entry's place
        self.entry = np.empty(len(a), dtype=np.int64)
        self.entry[order] = group
        self.later_doc = np.empty(len(a), dtype=bool)
        self.later_doc[order] = doc > self.doc[group]
        self.later = np.empty(len(a), dtype=bool)
        self.later[order] = (doc > self.doc[group]) | (pos > self.pos[group])
        # the segment that is the entry: (batch, number)
        base = np.cumsum([0, *(len(b.a) for b in self.batches)])
        self.base = base
        self.source = order[self.first]

    def by_bucket(self):
        """(bucket, slice of entries)"""
        edges = np.append(np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(self.bucket))
        for lo, hi in zip(edges, edges[1:]):
            yield int(self.bucket[lo]), slice(int(lo), int(hi))

    def states(self, replies: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.a), dtype=np.uint8)
        for bucket, part in self.by_bucket():
            out[part] = np.frombuffer(replies[bucket], dtype=np.uint8)
        return out

    def windows_of(self, per_segment: np.ndarray):
        """(batch, segment, start, hash, doc, pos) of the windows of the chosen segments, batch by batch."""
        for batch, wanted in self.split(per_segment):
            seg, start = batch.windows(np.flatnonzero(wanted))
            h = mix(batch.spans.hash(start, start + batch.length) + np.uint64(7))
            doc = batch.doc[seg]
            yield batch, seg, start, h, self.order_id[batch.rows[doc]], start - batch.starts[:-1][doc]

    def split(self, per_segment: np.ndarray):
        """(batch, its part of an array over all segments)"""
        for i, b in enumerate(self.batches):
            yield b, per_segment[self.base[i]:self.base[i + 1]]

    def entries_of(self, which: np.ndarray):
        """(batch, entry numbers, segment numbers) of the chosen entries, batch by batch."""
        source = self.source[which]
        for i, b in enumerate(self.batches):
            mine = (source >= self.base[i]) & (source < self.base[i + 1])
            yield b, which[mine], source[mine] - self.base[i]


def pack(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, which leaves the shuffle's codec runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def deal(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the bytes of all texts."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return slim.select(block.alias("block"), "doc_id", "text"), total


ENTRIES = "bucket int, block int, a binary, s binary, doc binary, pos binary"
REPLIES = "block int, bucket int, kind int, data binary"


def send_entries(table, batches, buckets: int, length: int, k: int):
    import pyarrow as pa

    block_no = table.column("block")[0].as_py()
    block = Block(table, batches, buckets, length, k)
    rows = [(b, block_no, pack(block.a[p]), pack(block.s[p]), pack(block.doc[p]), pack(block.pos[p].astype(np.uint32)))
            for b, p in block.by_bucket()]
    return _table(pa, rows, ENTRIES)


def _table(pa, rows: list, schema: str):
    types = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], types[t]) for i, (name, t) in enumerate(fields)})


def answer(table, by_doc: bool, hot: int | None = None):
    """One state per entry of a bucket. ``by_doc``: only a smaller id is
    earlier. ``hot``: anchors with more segments are to be checked window by
    window, dealt by the windows' own hashes."""
    import pyarrow as pa

    parts = [[unpack(d.as_py(), t) for d in table.column(c)]
             for c, t in (("a", np.uint64), ("s", np.uint64), ("doc", np.int64), ("pos", np.uint32))]
    edges = np.cumsum([0, *(len(x) for x in parts[0])])
    a, s, doc, pos = (np.concatenate(x) for x in parts)
    order = np.lexsort((pos, doc, s, a))
    a, s, doc, pos = a[order], s[order], doc[order], pos[order]
    new_a = np.ones(len(a), dtype=bool)
    new_a[1:] = a[1:] != a[:-1]
    new = new_a.copy()
    new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    group = np.cumsum(new_a) - 1
    contexts = np.bincount(group, weights=new)[group]
    earlier = doc > doc[first]
    if not by_doc:
        earlier |= pos > pos[first]
    state = np.where(earlier, REPEAT, np.where(contexts > 1, CHECK, NOTHING)).astype(np.uint8)
    if hot is not None:
        state[(state == CHECK) & (contexts > hot)] = HOT
    out = np.empty(len(a), dtype=np.uint8)
    out[order] = state
    rows = [(blk.as_py(), bkt.as_py(), 0, out[lo:hi].tobytes())
            for blk, bkt, lo, hi in zip(table.column("block"), table.column("bucket"), edges, edges[1:])]
    return _table(pa, rows, REPLIES)


def replies_of(table, kind: int) -> dict[int, bytes]:
    """Bucket -> data of one kind of reply."""
    return {b: d for b, k, d in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(),
                                    table.column("data").to_pylist()) if k == kind}


def covered(batch: Batch, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which symbols of a batch lie in any of the spans."""
    step = np.zeros(batch.n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
