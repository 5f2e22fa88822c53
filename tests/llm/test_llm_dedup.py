"""Exact, near and substring de-duplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tabforge.llm.block_naming import drop_exact_duplicates, exact_duplicates
from tabforge.llm.components import components
from tabforge.llm.repeat_intervals import intervals, maximal_repeats, remove_repeats, suffix_array
from tabforge.llm.rlz_spans import parse
from tabforge.llm.simhash_bk import BKTree, _masks, drop_near_duplicates, fingerprint, links, near_duplicates

SCHEMA = "doc_id long, text string, name string, level int, block int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def text_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ß", "the", "of"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            body = body[:40] + " " + passage[rng.randint(0, 40):] + "\n" + body
        out.append((i, body))
    out += [(100, out[3][1]), (101, out[3][1].upper()), (102, ""), (103, None), (104, "a " * 400), (105, "aaaa" * 200),
            (105, "aaaa" * 200), (None, out[6][1]), (106, "x" * 99), (107, "one\ttwo\x0bthree four"), (108, "Ab\0" * 60)]
    return out


def test_exact_duplicates_match_brute_force(spark):
    rows = text_rows() + [(200, "long " * 30000), (201, "LONG " * 30000), (202, "long " * 29999 + "lonG!")]
    got = sorted(map(tuple, exact_duplicates(docs(spark, rows), block_bytes=64).collect()), key=str)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    kept = {}
    want = []
    for i, t in rows:
        ids = groups[lower(t)]
        best = max(ids, key=lambda x: (x is not None, x or 0))
        stays = i == best and not kept.get(lower(t))
        kept[lower(t)] = kept.get(lower(t)) or stays
        want.append((i, best, len(ids), stays, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_duplicates_keep_columns_and_empty_table(spark):
    rows = text_rows()
    out = drop_exact_duplicates(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "name", "level", "block"]
    assert out.count() == len({lower(t) for _, t in rows})
    assert exact_duplicates(docs(spark, []), block_bytes=64).count() == 0


def test_fingerprint_bits():
    import xxhash

    for text in (None, "", "One", "one two", "a b c d e f a b c", "X " * 5000):
        w = lower(text).split()
        shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert fingerprint(text) & (1 << 64) - 1 == want


def clusters(seed=3, n=400):
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 20):
        x = rng.getrandbits(64)
        for _ in range(20):
            out.add(x - (1 << 64) if x >= 1 << 63 else x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def brute_components(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("items", [10, 10**6, 10**12])
def test_links_of_every_shard_layout(spark, monkeypatch, items):
    import tabforge.llm.simhash_bk as module

    monkeypatch.setattr(module, "_masks", lambda n, r: _masks(items, r))
    monkeypatch.setattr(module, "UNIT", 8)  # every dense shard is cut into units
    values = clusters()
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(links(frame), "t").collect()}
    want = brute_components(values)
    assert {v: got.get(v, v) for v in values} == want


def test_tree_takes_each_item_once():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 500).astype(np.uint64) >> np.uint64(40)
    tree = BKTree(values, 4)
    near = lambda q: {i for i, v in enumerate(values.tolist()) if (v ^ int(q)).bit_count() <= 4}
    assert set(tree.take(values[:1]).tolist()) == near(values[0])
    assert not set(tree.take(values[:1]).tolist())


def test_near_duplicates_and_stage(spark):
    rows = text_rows()
    got = near_duplicates(docs(spark, rows)).collect()
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = brute_components(sorted({f for _, f in fps}))
    first = {}
    for i, f in fps:
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == sorted(
        ((i, f, first.get(root[f])) for i, f in fps), key=str)
    out = drop_near_duplicates(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "name", "level", "block"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(first.values())
    assert near_duplicates(docs(spark, [])).count() == 0


def brute_words(rows):
    words = [__import__("re").findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    key = [i if i is not None else 1 << 63 for i, _ in rows]
    for k, w in zip(key, words):
        for j in range(len(w) - 12):
            g = tuple(w[j:j + 13])
            first[g] = min(first.get(g, k), k)
    out = []
    for (i, _), k, w in zip(rows, key, words):
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < k:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def thue_morse(n, a="a", b="b"):
    word = a
    other = b
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


def test_different_long_words_are_told_apart(spark):
    one, other = thue_morse(1024)
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}"), (4, "ab\0 " + tail), (5, "ab " + tail),
            (6, "x" * 9 + " " + tail), (7, "x" * 10 + " " + tail)]
    got = {r.doc_id: r.n_removed for r in parse(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0, 6: 0, 7: 0}


def test_parse_of_texts_of_megabytes(spark):
    rng = random.Random(21)
    long = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(250_000)]
    shared = long[100_000:100_400]
    rows = [(1, " ".join(shared)), (2, " ".join(long)), (3, "z" * 1_200_000), (4, "new " + " ".join(shared[:50]) + " end")]
    assert len(rows[1][1]) > 1_500_000
    got = {r.doc_id: r for r in parse(docs(spark, rows)).collect()}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {1: (400, 0), 2: (250_000, 400), 3: (1, 0), 4: (52, 50)}
    assert [(s.start, s.end) for s in got[2].spans] == [(100_000, 100_400)] and got[4].kept == "new end"


@pytest.mark.parametrize("seed", [1, 2])
def test_parse_matches_brute_force(spark, seed):
    rows = text_rows(seed)
    got = parse(docs(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute_words(rows)
    for r in got.collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert parse(docs(spark, [])).count() == 0


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    key = [i if i is not None else 1 << 63 for i, _ in rows]
    first = {}
    for k, b in zip(key, data):
        for j in range(len(b) - length + 1):
            w = b[j:j + length]
            first[w] = min(first.get(w, (k, j)), (k, j))
    out = []
    for (i, _), k, b in zip(rows, key, data):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j:j + length]] < (k, j):
                gone[j:j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_remove_repeats_matches_brute_force(spark, hot):
    rows = text_rows(4)
    got = remove_repeats(docs(spark, rows), hot_contexts=hot)
    cols = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, cols), key=str) == brute_bytes(rows, 100)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())
    assert remove_repeats(docs(spark, [])).count() == 0


def test_interval_tree_lists_maximal_repeats():
    rng = random.Random(5)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 30))) for _ in range(8)]
    data, sizes = np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments])
    least = 3
    count = np.maximum(sizes - least + 1, 0)
    places = [(s, o) for s, n in enumerate(count) for o in range(n)]
    got = {}
    for prefix, members in maximal_repeats(data, sizes, least):
        where = {places[m] for m in members.tolist()}
        text = {segments[s][o:o + prefix] for s, o in where}
        assert len(text) == 1
        got[text.pop()] = where
    occurrences = {}
    for s, t in enumerate(segments):
        for o in range(len(t)):
            for e in range(o + least, len(t) + 1):
                occurrences.setdefault(t[o:e], set()).add((s, o))
    want = {}
    for text, where in occurrences.items():
        left = {segments[s][o - 1] if o else ("start", s) for s, o in where}
        right = {segments[s][o + len(text)] if o + len(text) < len(segments[s]) else ("end", s) for s, o in where}
        if len(where) > 1 and len(left) > 1 and len(right) > 1:
            want[text] = where
    assert got == want
    order, lcp = suffix_array(data, np.array([0]), np.array([4]))
    assert list(intervals(lcp, 1)) == []


def test_the_row_that_stays_depends_on_the_rows_alone(spark):
    from tabforge.llm.simhash_bk import drop_near_duplicates

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, s) for s in ("d", "b", None, "c")] * 20 + [(1, "another text of its own words", "z"), (2, text.upper(), "a"),
                                                                 (None, text, "n"), (None, None, "n"), (None, "", "m")]
    schema = "doc_id long, text string, source string"
    for drop in (drop_exact_duplicates, drop_near_duplicates):
        got = []
        for parts, order in ((1, rows), (7, rows[::-1])):
            out = drop(spark.createDataFrame(order, schema).repartition(parts))
            assert out.columns == ["doc_id", "text", "source"]
            got.append(sorted(map(tuple, out.collect()), key=str))
        assert got[0] == got[1]
    near = {(i, s) for i, _, s in got[0]}
    assert near == {(1, None), (1, "z"), (None, "m")} or near == {(1, None), (1, "z"), (None, "n")}


def test_texts_above_a_megabyte_are_compared_whole(spark):
    from tabforge.llm.simhash_bk import near_duplicates

    base = " ".join(f"w{i * 7919 % 100_003}" for i in range(200_000))
    rows = [(1, base), (2, base + " tail"), (3, base.upper()), (4, "x" * 2_000_000), (5, "x" * 1_999_999 + "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.keep_id for r in exact_duplicates(frame).collect()}
    assert kept == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    near = {r.doc_id: r.component_id for r in near_duplicates(frame).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
