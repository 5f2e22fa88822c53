"""Repeated byte strings by the interval tree of an enhanced suffix array.

The anchor exchange (see ``anchors``) finds, for all windows of ``length``
bytes of all documents, those whose whole segment stands earlier, and leaves
the segments at the ends of repeats. Those are gathered by anchor, so
all places of a window meet in one unit. There an enhanced suffix array is
built: the suffixes of at least a window's length in order, and the common
prefix of each with the one before. A stack scan lists the intervals of
suffixes that share ``length`` bytes or more; one whose members are all
preceded by the same byte only repeats a longer group and is passed over.
Each remaining interval is a maximal repeat group with all its places: every
place but the earliest is covered over the whole common prefix.

An anchor with more than ``HOT_CONTEXTS`` different surroundings is split:
its windows travel by themselves, dealt by their own hashes, after equal ones
of a block are combined. So no anchor puts its segments in one task.

Defined cases: null text is empty; a text shorter than a window keeps all its
bytes. Removal may split a character; the result is bytes. Earlier means a
smaller doc_id, or the same doc_id and a smaller start; a null id is larger
than any other; rows that share id and text do not remove each other's bytes
and get equal results. An empty table gives an empty result. Columns other than
id and text play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame

from tabforge.llm import anchors as A

LENGTH = 100
GRAM = 32
HOT_CONTEXTS = 20_000
UNIT_WINDOWS = 60_000
SEGMENTS = "bucket int, block int, kind int, a binary, doc binary, pos binary, size binary, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"


def suffix_array(data: np.ndarray, starts: np.ndarray, rest: np.ndarray):
    """(order, lcp): the suffixes from ``starts``, each ``rest`` bytes long,
    sorted, and the length of the prefix each shares with the one before."""
    width = int(rest.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts].copy()
    rows[np.arange(width)[None, :] >= rest[:, None]] = 0
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    length = rest[order]
    return order, np.concatenate([[0], np.minimum(lcp, np.minimum(length[1:], length[:-1]))])


def intervals(lcp: np.ndarray, least: int):
    """(common prefix, first, last) of every interval of the tree with a prefix of at least ``least``."""
    deep = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if hi - lo == 1:
            yield int(lcp[lo]), lo - 1, lo
            continue
        stack = []
        for i, depth in enumerate([*lcp[lo:hi].tolist(), 0], lo):
            left = i - 1
            while stack and stack[-1][0] > depth:
                prefix, left = stack.pop()
                yield prefix, left, i - 1
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))


def maximal_repeats(data: np.ndarray, sizes: np.ndarray, least: int):
    """(prefix length, suffix starts) of each maximal repeat group among segments laid end to end."""
    base = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - least + 1, 0)
    seg = np.repeat(np.arange(len(sizes)), count)
    if not len(seg):
        return
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    starts = base[seg] + offset
    order, lcp = suffix_array(data, starts, sizes[seg] - offset)
    before = np.where(offset > 0, data[starts - 1].astype(np.int64), -1 - np.arange(len(seg)))[order]
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for prefix, lo, hi in intervals(lcp, least):
        if change[hi] > change[lo]:
            yield prefix, order[lo:hi + 1]


def repeated_windows(data: np.ndarray, sizes: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Which windows (in segment order) also stand at an earlier place; ``place`` ranks the windows."""
    count = np.maximum(sizes - least + 1, 0)
    total = int(count.sum())
    end = np.repeat(np.cumsum(count), count)
    step = np.zeros(total + 1, dtype=np.int64)
    for prefix, members in maximal_repeats(data, sizes, least):
        later = members[place[members] > place[members].min()]
        np.add.at(step, later, 1)
        np.add.at(step, np.minimum(later + prefix - least + 1, end[later]), -1)
    return np.cumsum(step[:-1]) > 0


def _send(block: A.Block, no: int, states: np.ndarray, buckets: int, length: int) -> list:
    """The segments to be checked, and the windows of hot anchors."""
    rows = []
    chosen = np.flatnonzero(states == A.CHECK)
    texts, sizes = np.empty(len(block.a), dtype=object), np.zeros(len(block.a), dtype=np.uint32)
    for batch, entries, seg in block.entries_of(chosen):
        lo, hi = batch.lo[seg], batch.hi[seg] + length
        sizes[entries] = hi - lo
        for e, s, t in zip(entries.tolist(), lo.tolist(), hi.tolist()):
            texts[e] = batch.raw[s:t]
    for bucket, part in block.by_bucket():
        mine = np.flatnonzero(states[part] == A.CHECK) + part.start
        if len(mine):
            rows.append((bucket, no, 1, A.pack(block.a[mine]), A.pack(block.doc[mine]), A.pack(block.pos[mine]),
                         A.pack(sizes[mine]), b"".join(texts[mine].tolist())))
    h, doc, pos, found = _hot_windows(block, states)
    if len(h):
        raws, bucket = [], (h % np.uint64(buckets)).astype(np.int64)
        for batch, start in found:
            raws.append(batch.raw[start:start + length])
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            rows.append((int(b), no, 2, A.pack(h[mine]), A.pack(doc[mine]), A.pack(pos[mine]),
                         A.pack(np.full(len(mine), length, np.uint32)), b"".join([raws[i] for i in mine])))
    return rows


def _hot_windows(block: A.Block, states: np.ndarray):
    """Distinct windows of hot anchors, ordered by hash, each with its earliest place in the block."""
    found = list(block.windows_of(states[block.entry] == A.HOT))
    h, doc, pos = (np.concatenate([*[f[i] for f in found], np.empty(0, t)])
                   for i, t in ((3, np.uint64), (4, np.int64), (5, np.int64)))
    owner = np.repeat(np.arange(len(found)), [len(f[3]) for f in found])
    start = np.concatenate([*[f[2] for f in found], np.empty(0, np.int64)])
    order = np.lexsort((pos, doc, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = order[new]
    return h[first], doc[first], pos[first], [(found[owner[i]][0], int(start[i])) for i in first]


def _check(table, length: int):
    """Replies with one bit per window of each message's segments, in order."""
    import pyarrow as pa

    get = lambda c, t: [A.unpack(d.as_py(), t) for d in table.column(c)]
    a, doc, pos, size = get("a", np.uint64), get("doc", np.int64), get("pos", np.int64), get("size", np.uint32)
    message = np.repeat(np.arange(len(a)), [len(x) for x in a])
    a, doc, pos, size = (np.concatenate(x) for x in (a, doc, pos, size))
    size = size.astype(np.int64)
    data = np.frombuffer(b"".join(table.column("data").to_pylist()), dtype=np.uint8)
    base = np.cumsum(size) - size
    windows = size - length + 1
    bit_base = np.cumsum(windows) - windows
    bits = np.zeros(int(windows.sum()), dtype=bool)
    # units: whole anchors, together about UNIT_WINDOWS windows
    order = np.argsort(a, kind="stable")
    new = np.diff(a[order], prepend=a[order][:1] + np.uint64(1)) != 0
    filled = np.cumsum(windows[order])
    anchor_start = np.flatnonzero(new)
    units, begin, at_begin = [], 0, 0
    for s in anchor_start[1:].tolist():
        if filled[s - 1] - at_begin >= UNIT_WINDOWS:
            units.append(order[begin:s])
            begin, at_begin = s, filled[s - 1]
    units.append(order[begin:])
    for unit in units:
        sizes = size[unit]
        text = np.concatenate([data[b:b + n] for b, n in zip(base[unit].tolist(), sizes.tolist())])
        count = windows[unit]
        seg = np.repeat(np.arange(len(unit)), count)
        offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        d, p = doc[unit][seg], pos[unit][seg] + offset
        by_place = np.lexsort((p, d))
        tie = np.ones(len(seg), dtype=bool)
        tie[1:] = (d[by_place][1:] != d[by_place][:-1]) | (p[by_place][1:] != p[by_place][:-1])
        place = np.empty(len(seg), dtype=np.int64)
        place[by_place] = np.cumsum(tie)
        bits[bit_base[unit][seg] + offset] = repeated_windows(text, sizes, place, length)
    edges = np.searchsorted(message, np.arange(table.num_rows + 1))
    ends = np.append(bit_base, len(bits))
    rows = [(blk, bkt, kind, np.packbits(bits[ends[lo]:ends[hi]]).tobytes()) for blk, bkt, kind, lo, hi in
            zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), table.column("kind").to_pylist(),
                edges.tolist(), edges[1:].tolist())]
    return A._table(pa, rows, A.REPLIES)


def _removed(block: A.Block, replies, length: int):
    """(batch, mask of its removed bytes)"""
    states = block.states(A.replies_of(replies, 0))
    copied = (states[block.entry] == A.REPEAT) | block.later
    # windows of the checked entries, in entry order
    count = np.zeros(len(block.a), dtype=np.int64)
    for batch, entries, seg in block.entries_of(np.flatnonzero(states == A.CHECK)):
        count[entries] = batch.hi[seg] - batch.lo[seg] + 1
    first = np.cumsum(count) - count
    bits, checked = np.zeros(int(count.sum()), dtype=bool), A.replies_of(replies, 1)
    for bucket, part in block.by_bucket():
        n = int(count[part].sum())
        if n:
            bits[first[part.start]:first[part.start] + n] = np.unpackbits(np.frombuffer(checked[bucket], np.uint8), count=n)
    h, doc, pos, _ = _hot_windows(block, states)
    hot, bucket = np.zeros(len(h), dtype=bool), (h % np.uint64(block.buckets)).astype(np.int64)
    single = A.replies_of(replies, 2)
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        hot[mine] = np.unpackbits(np.frombuffer(single[int(b)], np.uint8), count=len(mine))
    hot_windows = block.windows_of(states[block.entry] == A.HOT)
    todo = (states[block.entry] == A.CHECK) & ~copied
    for (batch, full), (_, check), (_, entry), (_, _, start, wh, wdoc, wpos) in zip(
            block.split(copied), block.split(todo), block.split(block.entry), hot_windows):
        whole = np.flatnonzero(full)
        seg, at = batch.windows(np.flatnonzero(check))
        hit = at[bits[first[entry[seg]] + at - batch.lo[seg]]]
        k = np.searchsorted(h, wh)
        hot_hit = start[hot[k] | (wdoc > doc[k]) | ((wdoc == doc[k]) & (wpos > pos[k]))] if len(h) else start
        yield batch, A.covered(batch, np.concatenate([batch.lo[whole], hit, hot_hit]),
                               np.concatenate([batch.hi[whole], hit, hot_hit]) + length)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row; with
    ``with_bytes`` also the removed spans (byte offsets, end exclusive) and
    the kept bytes."""
    dealt, total = A.deal(docs, id_col, text_col)
    buckets = max(1, math.ceil(total * 2 / (length - gram + 2) / A.BUCKET_ENTRIES))
    by_block = dealt.groupBy("block")

    def index(table):
        return A.send_entries(table, A.byte_batches, buckets, length, gram)

    def answer(table):
        return A.answer(table, by_doc=False, hot=hot_contexts)

    def ask(table, replies):
        import pyarrow as pa

        rows = []
        if table.num_rows:
            block = A.Block(table, A.byte_batches, buckets, length, gram)
            rows = _send(block, table.column("block")[0].as_py(), block.states(A.replies_of(replies, 0)), buckets, length)
        return A._table(pa, rows, SEGMENTS)

    def check(table):
        return _check(table, length)

    def finish(table, replies):
        import pyarrow as pa

        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
        out = {c: [] for c in names}
        if table.num_rows:
            block = A.Block(table, A.byte_batches, buckets, length, gram)
            for batch, gone in _removed(block, replies, length):
                for i, row in enumerate(batch.rows):
                    lo, hi = int(batch.starts[i]), int(batch.starts[i + 1])
                    cut, raw = gone[lo:hi], batch.raw[lo:hi]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))).tolist()
                    spans = list(zip(edge[::2], edge[1::2]))
                    kept = b"".join([raw[s:e] for s, e in zip([0, *edge[1::2]], [*edge[::2], len(raw)])]) if spans else raw
                    for c, v in zip(names, (block.ids[row], hi - lo, len(raw) - len(kept), len(spans),
                                            hashlib.sha256(kept).hexdigest(),
                                            [{"start": s, "end": e} for s, e in spans] if with_bytes else None,
                                            kept if with_bytes else None)):
                        out[c].append(v)
        types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
                 "kept_sha256": pa.string(), "kept": pa.binary(),
                 "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
        return pa.table({c: pa.array(out[c], types[c]) for c in names})

    entries = by_block.applyInArrow(index, A.ENTRIES)
    replies = entries.groupBy("bucket").applyInArrow(answer, A.REPLIES)
    segments = by_block.cogroup(replies.groupBy("block")).applyInArrow(ask, SEGMENTS)
    checked = segments.groupBy("bucket", "kind").applyInArrow(check, A.REPLIES)
    done = by_block.cogroup(replies.unionByName(checked).groupBy("block")).applyInArrow(finish, RESULT)
    return done if with_bytes else done.drop("spans", "kept")
