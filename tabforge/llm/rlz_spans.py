"""Substring de-duplication by relative Lempel-Ziv parsing.

Every block of documents is a reference block, indexed by the anchors of its
word sequence (see ``anchors``), and every document is factored against
the indexes of all blocks at once. The parse is greedy: a segment that also
stands in a document with a smaller id is copied from the reference, and
consecutive copied segments grow into one factor. Where a factor ends, the
windows of the adjoining segments are looked up one by one, so a match that
straddles the border of two factors is not lost. Factors of at least a
window's length are the duplicate spans; the words in between are literals.

Volume: one shuffle of the texts into blocks (read three times), about 0.2
index entries of 21 bytes a word, and the windows at factor ends only. No
anchor or window that a third of all documents hold is a hot group: within a
block it is one entry.

Defined cases: null or wordless text has no words and the digest of the empty
string. A document shorter than a window keeps all its words. Rows that share
a ``doc_id`` do not make each other's windows duplicates; a null id is larger
than any other. An empty table gives an empty result. Columns other than id
and text play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm import anchors as A

WINDOW = 13
GRAM = 6
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"


def _distinct_windows(found: list):
    """Sorted distinct window hashes of a block with the smallest id of each."""
    h = np.concatenate([f[3] for f in found]) if found else np.empty(0, np.uint64)
    doc = np.concatenate([f[4] for f in found]) if found else np.empty(0, np.int64)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    return h[new], doc[new]


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
          with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row; with ``with_text`` also
    the duplicate spans (word numbers, end exclusive) and the kept text."""
    dealt, total = A.deal(docs, id_col, text_col)
    buckets = max(1, math.ceil(total / 6 * 2 / (window - gram + 2) / A.BUCKET_ENTRIES))
    by_block = dealt.groupBy("block")

    def index(table):
        return A.send_entries(table, A.word_batches, buckets, window, gram)

    def answer(table):
        return A.answer(table, by_doc=True)

    def ask(table, replies):
        import pyarrow as pa

        rows = []
        if table.num_rows:
            block = A.Block(table, A.word_batches, buckets, window, gram)
            states = block.states(A.replies_of(replies, 0))
            h, doc = _distinct_windows(list(block.windows_of(states[block.entry] == A.CHECK)))
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            no = table.column("block")[0].as_py()
            for b in np.unique(bucket):
                mine = bucket == b
                rows.append((int(b), no, A.pack(h[mine]), A.pack(doc[mine])))
        return A._table(pa, rows, "bucket int, block int, h binary, doc binary")

    def check(table):
        import pyarrow as pa

        hs = [A.unpack(d.as_py(), np.uint64) for d in table.column("h")]
        docs_ = [A.unpack(d.as_py(), np.int64) for d in table.column("doc")]
        edges = np.cumsum([0, *map(len, hs)])
        h, doc = np.concatenate(hs), np.concatenate(docs_)
        names, inverse = np.unique(h, return_inverse=True)
        least = np.full(len(names), A.NO_ID)
        np.minimum.at(least, inverse, doc)
        repeat = least[inverse] < doc
        rows = [(blk.as_py(), bkt.as_py(), 1, np.packbits(repeat[lo:hi]).tobytes())
                for blk, bkt, lo, hi in zip(table.column("block"), table.column("bucket"), edges, edges[1:])]
        return A._table(pa, rows, A.REPLIES)

    def finish(table, replies):
        import pyarrow as pa

        out = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept")}
        if table.num_rows:
            block = A.Block(table, A.word_batches, buckets, window, gram)
            states = block.states(A.replies_of(replies, 0))
            found = list(block.windows_of(states[block.entry] == A.CHECK))
            h, doc = _distinct_windows(found)
            bits, bucket = A.replies_of(replies, 1), (h % np.uint64(buckets)).astype(np.int64)
            repeat = np.zeros(len(h), dtype=bool)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                repeat[mine] = np.unpackbits(np.frombuffer(bits[int(b)], np.uint8), count=len(mine)).astype(bool)
            copied = (states[block.entry] == A.REPEAT) | block.later_doc
            for (batch, mine), (_, _, start, wh, wdoc, _) in zip(block.split(copied), found):
                at = np.searchsorted(h, wh)
                hit = repeat[at] | (doc[at] < wdoc)
                factors = np.flatnonzero(mine)
                gone = A.covered(batch, np.concatenate([batch.lo[factors], start[hit]]),
                                 np.concatenate([batch.hi[factors], start[hit]]) + window)
                _emit(out, block, batch, gone, with_text)
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
                 "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept": pa.string()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    entries = by_block.applyInArrow(index, A.ENTRIES)
    replies = entries.groupBy("bucket").applyInArrow(answer, A.REPLIES)
    asked = by_block.cogroup(replies.groupBy("block")).applyInArrow(ask, "bucket int, block int, h binary, doc binary")
    checked = asked.groupBy("bucket").applyInArrow(check, A.REPLIES)
    done = by_block.cogroup(replies.unionByName(checked).groupBy("block")).applyInArrow(finish, RESULT)
    return done if with_text else done.drop("spans", "kept")


def _emit(out: dict, block: A.Block, batch: A.Batch, gone: np.ndarray, with_text: bool) -> None:
    for i, row in enumerate(batch.rows):
        lo, hi = int(batch.starts[i]), int(batch.starts[i + 1])
        cut = gone[lo:hi]
        n = int(cut.sum())
        at, end = batch.word_at[lo:hi], batch.word_end[lo:hi]
        if n:
            at, end = at[~cut], end[~cut]
        kept = b" ".join([batch.raw[s:e] for s, e in zip(at.tolist(), end.tolist())])
        out["doc_id"].append(block.ids[row])
        out["n_words"].append(hi - lo)
        out["n_removed"].append(n)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))) if with_text and n else []
        out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])] if with_text else None)
        out["kept"].append(kept.decode() if with_text else None)
