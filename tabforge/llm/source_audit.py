"""Source divergence audit by length-bucketed packing.

How far apart are the word frequencies of a language's sources, and which
terms set a source apart from its language?

A batch of texts is one byte buffer. Letters (A-Z, a-z and every byte of a
non-ASCII character) are found by a table look-up, so a term is a pair of
offsets and no string is made. Terms of up to 8 bytes become one uint64 and
terms of up to 16 bytes two (big-endian, zero-padded: no term holds a zero
byte, so packing is reversible). They are sorted by a radix sort of 16-bit
digits after a first pass by group, and equal runs are counted at once, with
the number of documents in each run. Longer terms go to one bucket a length,
sorted as bytes.

The runs travel packed: one row for each length class and hash bucket, so the
shuffle moves arrays and not millions of strings. The other side merges the
arrays as they come by the same sorts; what it holds are the distinct terms
of one bucket and at most ``MERGE_ROWS`` runs more. A frequent term of a
large source is one run a slice, so no bucket is hot.

Divergences of all pairs of sources are summed in exact integers, in tiles of
``TILE`` x ``TILE`` sources over buckets of terms: a term that neither source
of a pair holds adds a value that depends on the pair alone, so it is counted
and not visited.

Defined cases. Null text, language or source: ''. Text without letters, or
empty: no term, its group still appears. Repeated rows and repeated ids:
every row is a document. A text of any length is counted whole, in pieces of
``PIECE`` bytes cut between terms; its document counts once. Language
without a kept term: pairs have value 0 and there is no term row. Language
with one source: no pair. Ties: by the item's UTF-8 bytes. Empty table: no
row. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import materialize

# Fixed values of the audit: documents a kept term needs, and the scale of a share (1000^3, see ``share``).
MIN_DOCUMENTS, SCALE = 10, 1_000_000_000
PIECE = 4 << 20
BUCKET_BYTES, MAX_BUCKETS = 4 << 20, 4096
MERGE_ROWS = 1 << 20
# Sources looked up by broadcast; beyond, by a join.
BROADCAST_GROUPS = 20_000
TILE = 128
CELLS_PER_TASK = 150_000
CELLS_AT_ONCE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_KEEP = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)
_RUNS = "kind int, bucket int, terms binary, groups binary, n binary, docs binary"
_KEPT = "lid int, place int, term string, n long, lang_n long, leads boolean"


def strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings, without a copy of the bytes."""
    wide = pa.types.is_large_string(values.type)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset:values.offset + len(values) + 1]
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _radix(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``order``, stably sorted by the uint64 ``words``, in 16-bit digits."""
    for shift in (0, 16, 32, 48):
        digit = ((words >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16 bits
    return order


def _sort(terms: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Order by (term, group), stable. ``terms``: (rows, 1 or 2) uint64, or byte strings."""
    order = _radix(np.arange(len(groups)), groups)
    if terms.ndim == 1:
        return order[np.argsort(terms[order], kind="stable")]
    for k in reversed(range(terms.shape[1])):
        order = _radix(order, terms[:, k])
    return order


def _new_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        changed = k[1:] != k[:-1]
        new[1:] |= changed.any(1) if changed.ndim == 2 else changed
    return new


def _strings(terms: np.ndarray) -> pa.Array:
    """Packed words or byte strings as an Arrow array of strings."""
    matrix = terms.astype(">u8").view(np.uint8).reshape(len(terms), -1) if terms.ndim == 2 else \
        terms.view(np.uint8).reshape(len(terms), -1)
    used = matrix != 0
    offsets = np.zeros(len(matrix) + 1, np.int32)
    np.cumsum(used.sum(1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(matrix), pa.py_buffer(offsets), pa.py_buffer(matrix[used].tobytes()))


def count_terms(data: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
    """(terms, groups, occurrences, documents) of the texts that end at
    ``ends`` in ``data`` and belong to ``groups``, one length class after the other."""
    letter = _LETTER[data]
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    stops[:-1] &= ~letter[1:]
    starts = ends[:-1][(ends[:-1] < len(data)) & (ends[:-1] > 0)]  # a text begins a new term
    begins[starts], stops[starts - 1] = letter[starts], letter[starts - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(stops) + 1 - start
    doc = np.searchsorted(ends, start, side="right")
    low = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    eight = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))  # the eight bytes from every offset
    for least, most in [(1, 8), (9, 16)] + [(n, n) for n in np.unique(length[length > 16]).tolist()]:
        mine = np.flatnonzero((length >= least) & (length <= most))
        if not len(mine):
            continue
        at, n, of = start[mine], length[mine], doc[mine]
        if most <= 16:
            terms = [eight[at].astype(np.uint64) & _KEEP[np.minimum(n, 8)]]
            terms += [eight[at + 8].astype(np.uint64) & _KEEP[n - 8]] if most > 8 else []
            terms = np.stack(terms, 1)
        else:
            terms = low[at[:, None] + np.arange(most)].view(f"S{most}").ravel()
        group = groups[of]
        order = _sort(terms, group)
        terms, group, of = terms[order], group[order], of[order]
        new = _new_runs(terms, group)
        first = np.flatnonzero(new)
        new[1:] |= of[1:] != of[:-1]
        yield terms[first], group[first], np.diff(np.append(first, len(of))), np.add.reduceat(new.astype(np.int64), first)


def _long_text(data: np.ndarray, group: np.uint64) -> Iterator[tuple]:
    """The same of one long text, piece by piece: cut between terms, then merged."""
    parts, begin = {}, 0
    while begin < len(data):
        end = min(begin + PIECE, len(data))
        while end < len(data) and _LETTER[data[end]]:
            gap = np.flatnonzero(~_LETTER[data[end:end + PIECE]])
            end = min(end + int(gap[0]) if len(gap) else end + PIECE, len(data))
        piece = data[begin:end]
        for terms, groups, n, docs in count_terms(piece, np.array([len(piece)]), np.full(1, group, np.uint64)):
            parts.setdefault(_kind(terms), []).append((terms, groups, n, docs))
        begin = end
    for found in parts.values():
        terms, groups, n, _ = _merge(found)
        yield terms, groups, n, np.ones(len(n), np.int64)


def _kind(terms: np.ndarray) -> int:
    """Bytes of a packed term: 8 and 16 for words, else the length itself."""
    return 8 * terms.shape[1] if terms.ndim == 2 else terms.dtype.itemsize


def _merge(parts: list[tuple]) -> tuple:
    """Runs of equal (term, group) of several sorted parts, added up."""
    if len(parts) == 1:
        return parts[0]
    terms, groups, n, docs = (np.concatenate(x) for x in zip(*parts))
    order = _sort(terms, groups)
    terms, groups = terms[order], groups[order]
    first = np.flatnonzero(_new_runs(terms, groups))
    return terms[first], groups[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def _buckets(terms: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each term, by multiplicative hashing of its words."""
    if terms.ndim == 1:
        width = -(-terms.dtype.itemsize // 8) * 8
        terms = terms.astype(f"S{width}").view(np.uint64).reshape(len(terms), -1)
    h = np.zeros(len(terms), np.uint64)
    for k in range(terms.shape[1]):
        h = (h ^ terms[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _pack(buckets: int):
    """Batches of (group, text) as rows of packed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy().astype(np.uint64)
            offsets, data = strings(batch.column(1))
            row = 0
            while row < batch.num_rows:
                to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
                part = data[offsets[row]:offsets[to]]
                found = (_long_text(part, groups[row]) if len(part) > PIECE else
                         count_terms(part, offsets[row + 1:to + 1] - offsets[row], groups[row:to]))
                for terms, group, n, docs in found:
                    bucket = _buckets(terms, buckets)
                    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # at most MAX_BUCKETS
                    bucket = bucket[order]
                    cut = np.flatnonzero(_new_runs(bucket))
                    cells = [np.split(x[order], cut[1:]) for x in (terms, group, n.astype(np.int64), docs.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cut), _kind(terms), np.int32)), pa.array(bucket[cut].astype(np.int32)),
                         *[pa.array([x.tobytes() for x in cell], pa.binary()) for cell in cells]],
                        ["kind", "bucket", "terms", "groups", "n", "docs"])
                row = to
    return run


def _unpack(kind: int, row: list[bytes]) -> tuple:
    terms = (np.frombuffer(row[0], np.uint64).reshape(-1, kind // 8) if kind in (8, 16) else np.frombuffer(row[0], f"S{kind}"))
    return terms, np.frombuffer(row[1], np.uint64), np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int64)


def _kept(kind: int, parts: list[tuple], least: int) -> Iterator[pa.RecordBatch]:
    """The merged runs of one bucket whose term occurs in ``least`` documents of its language."""
    terms, groups, n, docs = _merge(parts)
    lang = groups >> np.uint64(32)
    leads = _new_runs(terms, lang)
    first = np.flatnonzero(leads)
    of = np.cumsum(leads) - 1
    enough = (np.add.reduceat(docs, first) >= least)[of]
    lang_n = np.add.reduceat(n, first)[of]
    for at in range(0, len(n), 100_000):
        sel = at + np.flatnonzero(enough[at:at + 100_000])
        if len(sel):
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[sel].astype(np.int32)), pa.array((groups[sel] & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                 _strings(terms[sel]), pa.array(n[sel]), pa.array(lang_n[sel]), pa.array(leads[sel])],
                ["lid", "place", "term", "n", "lang_n", "leads"])


def _merge_buckets(least: int):
    """Rows of packed runs, sorted by length class and bucket, as kept terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, pending = None, [], 0
        for batch in batches:
            for kind, bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, bucket) != now:
                    if parts:
                        yield from _kept(now[0], parts, least)
                    now, parts, pending = (kind, bucket), [], 0
                parts.append(_unpack(kind, row))
                pending += len(parts[-1][1])
                if pending > MERGE_ROWS:
                    parts, pending = [_merge(parts)], 0
        if parts:
            yield from _kept(now[0], parts, least)
    return run


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), divided three digits
    at a time: every product stays within a long up to 9 x 10^15 occurrences."""
    whole, left, digits = f"({total} + 2 * {terms})", f"({n} + 2)", []
    for _ in range(3):
        digits.append(f"(({left} * 1000L) div {whole})")
        left = f"(({left} * 1000L) % {whole})"
    return F.expr(f"1 + ({digits[0]} * 1000 + {digits[1]}) * 1000 + {digits[2]}")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over one bucket of terms of the pairs of one tile. Rows without a
    term hold every source's share of an absent term."""
    lid, left, right, _ = (k.as_py() for k in key)
    term, place, p = (table[c].combine_chunks() for c in ("term", "place", "p"))
    absent = term.is_null().to_numpy(zero_copy_only=False)
    place, p = place.to_numpy(), p.to_numpy()
    sources, base = place[absent], p[absent]
    order = np.argsort(sources)
    sources, base = sources[order], base[order]
    codes = term.filter(pa.array(~absent)).dictionary_encode()
    m = len(codes.dictionary)
    codes, where, p = codes.indices.to_numpy(), np.searchsorted(sources, place[~absent]), p[~absent]
    order = np.argsort(codes, kind="stable")
    codes, where, p = codes[order], where[order], p[order]
    rows = np.flatnonzero(sources // TILE == left)
    sums = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, CELLS_AT_ONCE // max(1, len(sources)))
    for begin in range(0, m, step):
        a, b = np.searchsorted(codes, [begin, begin + step])
        shares = np.tile(base, (min(step, m - begin), 1))
        shares[codes[a:b] - begin, where[a:b]] = p[a:b]
        shares = np.ascontiguousarray(shares.T)
        for i in rows:
            others = slice(i + 1 if left == right else len(rows), None)
            d, s = shares[others] - shares[i], shares[others] + shares[i]
            sums[i, others] += (d * d // s).sum(1)
    i, j = np.nonzero(np.triu(np.ones_like(sums, bool), 1) & (sources // TILE == left)[:, None]
                      & (sources // TILE == right)[None, :])
    return pa.table({"lid": pa.array([lid] * len(i), pa.int32()), "a": pa.array(sources[i], pa.int32()),
                     "b": pa.array(sources[j], pa.int32()), "f": pa.array(sums[i, j], pa.int64()),
                     "m": pa.array(np.full(len(i), m), pa.int64())})


def source_groups(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, lid, place, bytes): every group with the number of its
    language and its place within it."""
    groups = (docs.groupBy(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                           F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
              .agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")))
    langs = groups.select("lang").distinct().withColumn("lid", F.row_number().over(Window.orderBy("lang")) - 1)
    # windows over one row a language, and over one row a source of a language
    return materialize(groups.join(langs, "lang").withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "audit-groups")


def term_counts(docs: DataFrame, groups: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lid, place, term, n, lang_n, leads) of the kept terms: occurrences in
    the source and in the language; ``leads`` marks one row a (language, term)."""
    size = groups.agg(F.sum("bytes"), F.count("*")).first()
    buckets = max(1, min(MAX_BUCKETS, -(-int(size[0] or 0) // BUCKET_BYTES)))
    code = groups.select("lang", "source", (F.col("lid") * F.lit(1 << 32) + F.col("place")).alias("code"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for n, c in (("lang", lang), ("source", source), ("text", text))])
    coded = named.join(F.broadcast(code) if size[1] <= BROADCAST_GROUPS else code, ["lang", "source"])
    runs = coded.select("code", "text").mapInArrow(_pack(buckets), _RUNS)
    return (runs.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
            .mapInArrow(_merge_buckets(min_documents), _KEPT))


def audit_sources(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                  min_documents: int = MIN_DOCUMENTS, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other
    sources of the language by divergence, part ``term`` the terms that the
    source holds a larger share of than its language (the first ``top``)."""
    groups = source_groups(docs, lang, source, text)
    kept = materialize(term_counts(docs, groups, lang, source, text, min_documents), "audit-terms")
    of_lang = kept.groupBy("lid").agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("terms"))
    groups = (groups.join(kept.groupBy("lid", "place").agg(F.sum("n").alias("total")), ["lid", "place"], "left")
              .join(of_lang, "lid", "left").na.fill(0, ["total", "lang_total", "terms"])
              .withColumn("absent", F.when(F.col("terms") > 0, share("0", "total", "terms"))))
    groups = materialize(groups, "audit-groups")
    cells = (kept.join(groups, ["lid", "place"])
             .withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}))

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.withColumn("rank", F.row_number().over(order))

    terms = ranked(cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                apart("p", "q").alias("value"))).filter(F.col("rank") <= top)
    one, other = (groups.select("lid", *[F.col(c).alias(f"{c}_{s}") for c in ("lang", "source", "place", "absent", "terms")])
                  for s in ("a", "b"))
    pairs = (one.join(other, "lid").filter("place_a <> place_b")  # the result itself: all pairs of a language's sources
             .withColumns({"a": F.least("place_a", "place_b"), "b": F.greatest("place_a", "place_b")})
             .join(_pair_sums(cells, groups), ["lid", "a", "b"], "left"))
    rest = (F.col("terms_a") - F.coalesce(F.col("m"), F.lit(0))) * apart("absent_a", "absent_b")
    pairs = ranked(pairs.select(F.col("lang_a").alias("lang"), F.col("source_a").alias("source"), F.lit("pair").alias("part"),
                                F.col("source_b").alias("item"),
                                (F.coalesce(F.col("f"), F.lit(0)) + F.coalesce(rest, F.lit(0))).alias("value")))
    return pairs.unionByName(terms)


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lid, a, b, f, m): divergence of places a < b over the terms that some
    source of their tile holds, and the number of those terms."""
    block = (F.col("place") / TILE).cast("int")
    groups = groups.withColumn("last", F.max(block).over(Window.partitionBy("lid")))
    # about as many cells as there can be: terms of a language, at each of its sources, in each tile
    most = groups.agg(F.sum(F.col("terms") * (F.col("last") + 1))).first()[0] or 0
    buckets = max(1, -(-int(most) // CELLS_PER_TASK))
    cells = (cells.select("lid", "place", "term", "p").join(groups.select("lid", "place", "last"), ["lid", "place"])
             .withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    absent = (groups.filter("terms > 0").withColumns({"term": F.lit(None).cast("string"), "p": F.col("absent")})
              .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    rows = cells.unionByName(absent.select(cells.columns)).withColumn("mine", block)
    rows = (rows.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("last"))))
            .select("lid", F.least("mine", "their").alias("left"), F.greatest("mine", "their").alias("right"),
                    "bucket", "term", "place", "p"))
    return (rows.groupBy("lid", "left", "right", "bucket").applyInArrow(_tile, "lid int, a int, b int, f long, m long")
            .groupBy("lid", "a", "b").agg(F.sum("f").alias("f"), F.sum("m").alias("m")))
