"""Fill-in-the-middle transformation with content-defined chunks.

A text is a sequence of units: a word with the white space before it, or the
white space that ends the text. Prefix, middle and suffix are cut between
units, at places that a digest of the document's id chooses, and laid out in
one of two orders around three sentinels.

Units are counted in chunks. A gear hash over the last 32 bytes, computed for
a whole batch at once, ends a chunk where its upper bits are zero, so a
passage that many documents share falls into the same chunks wherever it
stands. Each different chunk is scanned once and a cache keeps its boundary
summary: does it begin or end inside a word, how many words end in it, how
many code points it has. The cache is keyed by the chunk's bytes themselves,
so a hit is verified by content, never by a hash alone. Summaries of adjacent
chunks combine: a word that runs over a boundary ends in the later chunk.
Running counts then name the chunk that holds a cut, and only that chunk is
searched for the exact byte.

The cache has two generations of ``CACHE_BYTES`` bytes each: a chunk that is
met again survives, others leave, and results never depend on what it holds.

Defined cases. Null or empty text: no unit, form ``plain``. Null id: the
digest of the seed alone. A text that holds a sentinel: ``plain``, as it
could not be restored. White space only: one unit. Very long texts: chunks of
at most ``MOST`` bytes, so memory is that of the text. Repeated rows and ids:
each row by itself, equal ids cut equally. Empty table: no row. Extra columns
are kept; new columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import free_prefix
from tabforge.llm.source_audit import strings

# Fixed values of the transformation.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80

# A chunk ends where the upper bits of the hash are zero: one byte in 1024, LEAST to MOST bytes apart.
CUT_BITS, LEAST, MOST = 10, 64, 8192
CACHE_BYTES = 16 << 20
PIECE = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < 32 (mod 2^32), by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, never inside a code point."""
    if not len(data):
        return []
    found = np.concatenate([np.flatnonzero(gear(data[at:at + PIECE + 31])[31 * (at > 0):] >> np.uint32(32 - CUT_BITS) == 0)
                            + at + 31 * (at > 0) + 1 for at in _pieces(len(data))])
    ends, begin = [], 0
    for end in [*found.tolist(), len(data)]:
        while end - begin > MOST:
            begin = _whole(data, begin + MOST)
            ends.append(begin)
        if end == len(data) or end - begin >= LEAST:
            end = _whole(data, end)
            if end > begin:
                ends.append(end)
                begin = end
    return ends


def _pieces(n: int) -> Iterator[int]:
    """Starts of pieces of PIECE bytes; each but the first needs the 31 bytes before it."""
    yield 0
    at = PIECE + 31
    while at < n:
        yield at - 31
        at += PIECE


def _whole(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _word_ends(chunk: bytes) -> np.ndarray:
    """Places after the last byte of each word that ends inside the chunk."""
    space = _SPACE[np.frombuffer(chunk, np.uint8)]
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def summary(chunk: bytes) -> tuple[bool, bool, int, int]:
    """(begins with a space, ends with a space, words that end inside, code points)."""
    data = np.frombuffer(chunk, np.uint8)
    return (bool(_SPACE[data[0]]), bool(_SPACE[data[-1]]), len(_word_ends(chunk)),
            int(np.count_nonzero(data & 0xC0 != 0x80)))


class ChunkCache:
    """Boundary summaries by content, in two generations of bounded size."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}
        self.asked = self.scanned = 0

    def __call__(self, chunk: bytes) -> tuple[bool, bool, int, int]:
        self.asked += 1
        known = self.young.get(chunk)
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                known = summary(chunk)
                self.scanned += 1
            if self.size + len(chunk) > self.limit:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = known
            self.size += len(chunk) + 200
        return known


class Units:
    """The units of one text: their number, and where the k-th ends."""

    def __init__(self, data: bytes, cache: ChunkCache):
        self.data = data
        self.ends = chunk_ends(np.frombuffer(data, np.uint8))
        parts = [cache(data[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        # words that ended before each chunk is left; one that touches its end has ended if a space or nothing follows
        self.words, self.chars = np.zeros(len(parts) + 1, np.int64), np.zeros(len(parts) + 1, np.int64)
        if parts:
            opens, closes, inside, chars = (np.array(x) for x in zip(*parts))
            self.closed = ~closes & np.append(opens[1:], True)
            # a word that ran into the chunk has ended at its boundary, which the chunk before has counted
            np.cumsum(inside + self.closed, out=self.words[1:])
            np.cumsum(chars, out=self.chars[1:])
        self.trailing = bool(parts) and bool(_SPACE[data[-1]])
        self.n = int(self.words[-1]) + self.trailing

    def end(self, k: int) -> tuple[int, int]:
        """(byte, code point) after the first ``k`` units."""
        if k == 0:
            return 0, 0
        if k > self.words[-1]:
            return len(self.data), int(self.chars[-1])
        c = int(np.searchsorted(self.words, k)) - 1  # the chunk that holds the k-th word's end
        begin, end = ([0, *self.ends][c], self.ends[c])
        chunk, nth = self.data[begin:end], k - int(self.words[c]) - 1
        inside = _word_ends(chunk)
        if nth == len(inside):  # it ends where the chunk does
            return end, int(self.chars[c + 1])
        at = int(inside[nth])
        return begin + at, int(self.chars[c]) + sum(b & 0xC0 != 0x80 for b in chunk[:at])


def transform_text(data: bytes, h: tuple[int, int, int, int], cache: ChunkCache, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> tuple:
    """(n, form, prefix code points, middle code points, output bytes)."""
    units = Units(data, cache)
    if not data or h[2] % 100 >= fim_percent or any(s.encode() in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, data
    (a, a_chars), (b, b_chars) = sorted(units.end(x % (units.n + 1)) for x in h[:2])
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h[3] % 100 < spm_percent
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return units.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, out


_RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(fim_percent: int, spm_percent: int):
    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cache = ChunkCache()
        for text, *h in columns:
            offsets, data = strings(text)
            data = data.tobytes() if len(data) else b""
            h = [c.to_numpy(zero_copy_only=False).tolist() for c in h]
            rows = [transform_text(data[offsets[i]:offsets[i + 1]], x, cache, fim_percent, spm_percent)
                    for i, x in enumerate(zip(*h))]
            n, form, prefix, middle, out = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], fields=list(_RESULT))
    return run


def digest_parts(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 32-bit groups of the hex SHA-256 of ``seed:id``, unsigned."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of. The sentinels are the only ones in it,
    so the first three places that look like one are theirs."""
    parts = F.split(F.substr(output, F.lit(4)), "<[PSM]>", 3)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(parts[0], parts[2], parts[1]))
            .otherwise(F.concat(parts[1], parts[2], parts[0])))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and the output text."""
    made = f"{free_prefix(docs)}fim"
    run = _transform(fim_percent, spm_percent)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn(made, run(text, *digest_parts(F.col(id_col), seed)))
    return out.withColumns({c: F.col(f"{made}.{c}") for c in _RESULT.names}).drop(made)
