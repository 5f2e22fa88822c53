"""Archives, infilling and the source audit against plain Python."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tabforge.llm import infilling, source_audit, warc_zstd
from tabforge.session import scratch_path

ODD = ["", " ", "\t\n", "one", " one", "one ", "é", "<P> no", "a b c", "日本語 テキスト", "x" * 40 + " " + "y" * 17, None,
       "\x0b\x0c a\r\nb\x1c", "𝒳𝒴 <S", "Aa aA AA-bB_cC9d"]


def _documents(spark, rows, extra=()):
    schema = "doc_id long, text string, lang string, source string" + "".join(f", {c} long" for c in extra)
    return spark.createDataFrame([r + (0,) * len(extra) for r in rows], schema)


# ---- fill-in-the-middle ---------------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _fim(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def _texts(seed, n):
    rng = random.Random(seed)
    shared = "".join(rng.choice("abcdé \n") for _ in range(6000))
    for i in range(n):
        k = rng.randrange(5)
        yield (rng.choice(ODD) if k == 0 else "".join(rng.choice("ab é\t日<PSM>") for _ in range(rng.randrange(60))) if k == 1
               else shared[rng.randrange(100):] + str(i) if k == 2 else " ".join(rng.choice(["über", "x" * 30, "<", "S>"]) for _ in range(400)))


def test_infilling_equals_plain_python(spark):
    rows = [(i // 2 if i % 7 else None, t, "en", "s") for i, t in enumerate(_texts(1, 400))]
    docs = _documents(spark, rows, ("_x_fim", "N_words"))
    out = infilling.fill_in_middle(docs)
    assert out.columns == docs.columns + ["n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted((_fim(r[0], r[1]) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = out.select(F.coalesce("text", F.lit("")).alias("t"), infilling.restore(F.col("output"), F.col("form")).alias("r"))
    assert back.filter("t <> r").count() == 0


def test_infilling_of_long_texts(spark):
    rng = random.Random(3)
    words = ["wörd", "b", "cc" * 20, "日本"]
    long = "".join(rng.choice(words) + rng.choice([" ", "\n", "  "]) for _ in range(300_000))
    ids = [i for i in range(400) if _fim(i, "a b")[2] != "plain"][:3]
    rows = [(ids[0], long, "", ""), (ids[1], "é" * 1_500_000, "", ""), (ids[2], " " * 1_200_000, "", "")]
    got = [tuple(r) for r in infilling.fill_in_middle(_documents(spark, rows))
           .select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got) == sorted(_fim(r[0], r[1]) for r in rows)


def test_infilling_of_an_empty_table(spark):
    assert infilling.fill_in_middle(_documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_chunks_cover_the_text_and_follow_its_content(seed, monkeypatch):
    monkeypatch.setattr(infilling, "PIECE", 5000)  # many pieces
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 107, 40_000).astype(np.uint8)
    ends = infilling.chunk_ends(data)
    assert ends[-1] == len(data) and all(0 < b - a <= infilling.MOST for a, b in zip([0, *ends], ends))
    monkeypatch.setattr(infilling, "PIECE", 1 << 20)
    assert infilling.chunk_ends(data) == ends
    moved = infilling.chunk_ends(np.concatenate([rng.integers(97, 107, 777).astype(np.uint8), data]))
    assert len({e - 777 for e in moved} & set(ends)) >= 0.8 * len(ends)


def test_shared_chunks_are_scanned_once():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef gh") for _ in range(100_000)).encode()
    cache = infilling.ChunkCache(limit=1 << 20)
    for i in range(20):
        infilling.Units(f"{i} opening words ".encode() * 3 + passage, cache)
    assert cache.scanned < 0.15 * cache.asked
    small = infilling.ChunkCache(limit=1000)  # results never depend on what the cache holds
    text = b"a bc  def " * 3000
    assert infilling.Units(text, small).n == len(UNITS.findall(text.decode()))


# ---- archives -------------------------------------------------------------------------------------

def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, n long")


def _expected(rows, min_bytes=0):
    first = {}
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= min_bytes:
            old = first.get(body, "none")
            first[body] = page if old in ("none", None) or (page is not None and page < old) else old
    out, seen = [], set()
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = len(body) >= min_bytes and body in seen
        seen.add(body)
        out.append((page, len(body), digest, "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def _read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives_round_trip(spark, min_bytes):
    rng = random.Random(2)
    html = ["", None, "a", "abcd", "abcde", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x\x00y", "same " * 50, "日本" * 100]
    rows = [(rng.choice([None, i, i // 3]), rng.choice([None, "", "http://a/é b", "http://a/\r\nWARC-Type: evil"]),
             rng.choice(html + [f"page {i} " * rng.randrange(40)]), "clash", i) for i in range(300)]
    path = scratch_path(spark, "warc-test")
    warc_zstd.write_archives(_pages(spark, rows), path, min_bytes=min_bytes)
    back = warc_zstd.read_archives(spark, path)
    assert _read(back) == _expected(rows, min_bytes)
    kept = back.filter("record_type = 'response'").select("page_id", "payload").collect()
    assert {bytes(r[1]) for r in kept} == {(r[2] or "").encode() for r in rows}
    assert back.filter("error is not null").count() == 0
    assert back.filter("uri like '%evil%' and uri not like '%\\%0D\\%0AWARC-Type:\\%20evil'").count() == 0


def test_archives_of_copies_and_long_pages(spark):
    rows = [(i, f"http://h/{i}", "copied page" if i % 3 else f"<html>{i}" + "text é " * 20, "", 0) for i in range(3000)]
    rows += [(5000, "u", "z" * 3_000_000, "", 0), (5001, "u", "z" * 3_000_000, "", 0), (5002, "u", "é日" * 700_000, "", 0)]
    assert _read(warc_zstd.archived(_pages(spark, rows))) == _expected(rows)


def test_archives_of_an_empty_table(spark):
    assert warc_zstd.archived(_pages(spark, [])).count() == 0


def _archive(bodies, dictionary=b"", packed=False):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frame = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    c = zstandard.ZstdCompressor(dict_data=known, write_checksum=True, write_content_size=False)
    out = warc_zstd.dictionary_frame(frame)
    for i, b in enumerate(bodies):
        sha1 = warc_zstd.base32_sha1(b)
        out += c.compress(warc_zstd.record(i, "u", b, len(b), sha1, None, False, "2020-01-01T00:00:00Z"))
    return out


def _dictionary():
    rng = random.Random(9)
    return zstandard.train_dictionary(4096, [" ".join(rng.choice(["alpha", "beta", "gamma", "<p>"]) for _ in range(200)).encode()
                                             for _ in range(300)]).as_bytes()


@pytest.mark.parametrize("packed", [False, True])
def test_reader_takes_plain_and_packed_dictionaries(packed):
    bodies = [b"alpha beta " * 50, b"", b"\r\n\r\n", bytes(range(256)) * 600]
    data = _archive(bodies, _dictionary(), packed)
    assert [r["payload"] for r in warc_zstd.read_archive(data)] == bodies
    assert [r["payload"] for r in warc_zstd.read_archive(_archive(bodies))] == bodies
    spaced = data + warc_zstd.SEPARATOR.encode() + struct.pack("<II", 0x184D2A53, 3) + b"abc"
    assert [r["page_id"] for r in warc_zstd.read_archive(spaced)] == [0, 1, 2, 3]


def _frame(record: bytes) -> bytes:
    return zstandard.ZstdCompressor(write_checksum=True).compress(record)


def test_reader_checks_frames_headers_and_lengths():
    body = b"hello"
    good = warc_zstd.record(1, "u", body, 5, warc_zstd.base32_sha1(body), None, False, "2020-01-01T00:00:00Z")
    faults = {
        "Content-Length": good.replace(b"Content-Length: 5\r\n", b"Content-Length: 6\r\n"),
        "the block is": good[:-1],
        "WARC header": good.replace(b"WARC/1.1", b"WARC/9.9"),
        "WARC-Date": good.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""),
        "bad header line": good.replace(b"WARC-Type: response", b"no colon here"),
        "digest": good.replace(b"hello", b"hellO"),
    }
    for what, bad in faults.items():
        data = _frame(bad) + _frame(good)
        with pytest.raises(warc_zstd.ArchiveError):
            list(warc_zstd.read_archive(data))
        rows = list(warc_zstd.read_archive(data, strict=False))
        assert rows[0]["error"] and rows[1]["payload"] == body, what
    whole = _frame(good)
    for broken in (whole[:-3], whole[:8], b"nonsense" + whole, whole[:-1] + bytes([whole[-1] ^ 1]),
                   warc_zstd.dictionary_frame(b"not a dictionary") + whole):
        with pytest.raises(warc_zstd.ArchiveError):
            list(warc_zstd.read_archive(broken))
        assert any(r["error"] for r in warc_zstd.read_archive(broken, strict=False))
    other = _archive([b"alpha " * 100], _dictionary())
    at = [begin for magic, begin, _ in warc_zstd.frames(memoryview(other)) if magic == warc_zstd.FRAME_MAGIC][0]
    with pytest.raises(warc_zstd.ArchiveError):
        list(warc_zstd.read_archive(other[at:]))  # the dictionary is gone


# ---- source audit ---------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _audit(rows, least=10, top=10):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        n[g].update(terms)
        docs[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        mine = sorted(g[1] for g in groups if g[0] == lang)
        everything = Counter()
        for s in mine:
            everything.update(n[lang, s])

        def p(count, total):
            return 1 + 1000000000 * (count + 2) // (total + 2 * len(kept))

        totals = {s: sum(n[lang, s][t] for t in kept) for s in mine}
        total = sum(everything[t] for t in kept)
        for s in mine:
            pairs = [(o, sum((p(n[lang, s][t], totals[s]) - p(n[lang, o][t], totals[o])) ** 2
                             // (p(n[lang, s][t], totals[s]) + p(n[lang, o][t], totals[o])) for t in kept)) for o in mine if o != s]
            terms = []
            for t in kept:
                if n[lang, s][t]:
                    a, b = p(n[lang, s][t], totals[s]), p(everything[t], total)
                    if a > b:
                        terms.append((t, (a - b) ** 2 // (a + b)))
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def _corpus(seed, n, sources):
    rng = random.Random(seed)
    words = ["a", "Bc", "über", "ab" * 4, "ab" * 4 + "c", "q" * 16, "q" * 17, "日本語", "x" * 40, "ÄÄ", "zz-top", "9lives", "é" * 9]
    words += ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    for i in range(n):
        text = rng.choice(ODD) if i % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        yield (i // 2, text, rng.choice(["en", "de", None, ""]), rng.choice(sources))


@pytest.mark.parametrize("least", [10, 3, 10_000])
def test_audit_equals_plain_python(spark, least):
    rows = list(_corpus(least, 500, ["s1", "S2", None, "", "ü", "s10"])) + [(9, "only here", "xx", "one"), (9, "", "yy", "a"), (9, None, "yy", "b")]
    got = source_audit.audit_sources(_documents(spark, rows, ("term", "n", "place")), min_documents=least)
    assert sorted(tuple(r) for r in got.collect()) == _audit(rows, least)


def test_audit_in_small_pieces_tiles_and_buckets(spark, monkeypatch):
    rows = list(_corpus(7, 300, [f"s{i}" for i in range(9)]))
    docs = _documents(spark, rows).repartition(5)
    for name, value in (("PIECE", 64), ("MERGE_ROWS", 20), ("TILE", 4), ("CELLS_AT_ONCE", 32)):
        monkeypatch.setattr(source_audit, name, value)
    table = pa.table({"g": [{"en": 1, "de": 2}.get(r[2], 0) << 32 | int(r[3][1:]) for r in rows], "t": [r[1] or "" for r in rows]})
    packed = [b for b in source_audit._pack(3)(iter(table.to_batches(max_chunksize=50)))]
    whole = pa.Table.from_batches(packed).sort_by([("kind", "ascending"), ("bucket", "ascending")])
    found = Counter()
    for b in source_audit._merge_buckets(10)(iter(whole.to_batches())):
        for lid, place, term, n, *_ in zip(*(c.to_pylist() for c in b.columns)):
            found[lid, place, term] += n
    want, in_docs = Counter(), Counter()
    for _, text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        lid = {"en": 1, "de": 2}.get(lang, 0)
        want.update((lid, int(source[1:]), t) for t in terms)
        in_docs.update({(lid, t) for t in terms})
    assert found == Counter({k: v for k, v in want.items() if in_docs[k[0], k[2]] >= 10})
    got = source_audit.audit_sources(docs)
    assert sorted(tuple(r) for r in got.collect()) == _audit(rows)


def test_audit_of_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "Beta", "x" * 30, "日本語日本語"]) for _ in range(1_000_000))
    assert len(long.encode()) > source_audit.PIECE  # cut into pieces
    rows = [(i, "alpha gamma " + "x" * 30, "en", f"s{i % 2}") for i in range(12)] + [(20, long, "en", "s0"), (21, "é" * 1_000_000, "en", "s1")]
    assert sorted(tuple(r) for r in source_audit.audit_sources(_documents(spark, rows)).collect()) == _audit(rows)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit_sources(_documents(spark, [])).count() == 0
