"""Mixing, encoding, toxicity, resampling, quotes and vector search."""

import math
import random
import re

import numpy as np
import pytest

from tabforge.llm.cross_polytope import hadamard, nearest
from tabforge.llm.mixing import mix, mixed_documents, taken_words
from tabforge.llm.piece_bpe import SPACE, PieceEncoder, encode_documents, read_model
from tabforge.llm.quotes import _parsed, parse, quote_links, reply_order
from tabforge.llm.resampling import hashed_ngrams, importance_sample, kth_largest
from tabforge.llm.weak_supervision import drop_toxic, is_held_out, label_model, score_documents

SCHEMA = "doc_id long, text string, source string, size int, target int, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 0.5) for i, t, s in rows], SCHEMA)


def corpus(n=120):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows + [(500, None, "a"), (501, "", "zz"), (7, rows[7][1], rows[7][2]), (None, "x y z", "b"), (None, "x y z", "b"),
                   (502, "w " * 20000, "c"), (503, "tiny", "d")]


def test_targets_and_taken_words(spark):
    rows = corpus()
    got = taken_words(docs(spark, rows), block_words=16).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, held = sum(size.values()), {}, set()
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(3 * size[s] for s in held)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        held.update(over)
    target = {s: 3 * size[s] if s in held else level * weight[s] for s in order}
    source = {}
    for i, t, s in rows:
        source.setdefault((i, len((t or "").split())), []).append(s)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        s = source[(r.doc_id, r["size"])][0]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s], abs=1e-5)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in order:
        assert taken[s] == round(target[s])
    again = taken_words(docs(spark, rows).repartition(7), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert taken_words(docs(spark, [])).count() == 0


def test_slots_keep_to_the_weights_all_along(spark):
    _, segments = mix(docs(spark, corpus()), block_words=16)
    slots = [r.src for r in segments.select("src", "slot").distinct().orderBy("slot").collect()]
    share = {s: slots.count(s) / len(slots) for s in set(slots)}
    for n in range(40, len(slots), 40):
        for s in share:
            assert abs(slots[:n].count(s) - n * share[s]) < 12


def test_mixed_documents_follow_the_mix(spark):
    rows = corpus()
    out = mixed_documents(docs(spark, rows), block_words=16)
    assert out.columns == ["doc_id", "text", "source", "size", "target", "score"]
    rows_, segments = mix(docs(spark, rows), block_words=16)
    want = {}
    for r in segments.groupBy("src", "doc_id", "size", "text_key", "copy", "epoch").sum("taken").collect():
        if r["sum(taken)"] * 2 >= r["size"]:
            want[(r.doc_id, r["size"])] = want.get((r.doc_id, r["size"]), 0) + 1
    got = {}
    for r in out.collect():
        k = (r.doc_id, len(r.text.split()))
        got[k] = got.get(k, 0) + 1
    assert got == want


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, PieceEncoder(read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoder_equals_the_library(bpe):
    _, ours, library = bpe
    rng = random.Random(4)
    letters = "abcé▁ \n\t<>0x1Ⅷ执🙂ß  the"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["", " ", "▁", "intent" * 800, "a" * 5000, " " * 700 + "x", "\n" * 50, "re \n  inter " * 40, "<s></s><0x41>\0"]
    texts += [" " * n + "word" + " " * n for n in range(40)]
    for t in texts:
        ids = library.encode(t)
        assert ours.encode(t) == ids, t
        assert ours.decode(ids) == library.decode(ids), t


def test_encoded_documents(spark, bpe):
    path, _, library = bpe
    rows = corpus(30)
    for r in encode_documents(docs(spark, rows), path).collect():
        assert library.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens
    got = encode_documents(docs(spark, rows), path)
    assert sorted(tuple(r.ids) for r in got.collect()) == sorted(tuple(library.encode(t or "")) for _, t, _ in rows)
    assert encode_documents(docs(spark, []), path).count() == 0


def test_words_are_cut_only_where_no_merge_crosses(bpe, monkeypatch):
    from tabforge.llm import piece_bpe

    monkeypatch.setattr(piece_bpe, "MEMO_WORDS", 40)  # both generations turn over many times
    path, _, library = bpe
    encoder = PieceEncoder(read_model(path))
    rng = random.Random(12)
    marks = [".", ",", "\n", "é", "日本", "\U00013000", "''", "...", "%%%", "don't", "e.g.", "x=1", SPACE, "-", "", "a" * 90]
    for _ in range(1500):
        text = " ".join("".join(rng.choice(marks + ["the", "ing", "Th", "er"]) for _ in range(rng.randrange(6))) for _ in range(4))
        ids = encoder.encode(text)
        assert ids == library.encode(text) and encoder.decode(ids) == library.decode(ids)
    assert len(encoder.memo) <= 40 and len(encoder.memo.old) <= 40 and len(encoder.parts) <= 40


def test_very_long_texts_are_encoded_whole(spark, bpe):
    path, _, library = bpe
    text = "long words, and lines.\nagain é  " * 40_000 + "z" * 200_000
    (row,) = encode_documents(docs(spark, [(1, text, "s")]), path).collect()
    assert row.ids == library.encode(text) and row.decoded == library.decode(row.ids) and row.n_tokens == len(row.ids)


def toxic_corpus(spark, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('aeiou')}r" for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(30)] = rng.choice(["idiot", "moron", "grumbleface", "snotling"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    rows += [(900, None, None), (901, "", "s"), (None, "you idiot moron", "s"), (0, rows[0][1], "s")]
    return docs(spark, rows), spark.createDataFrame(labels + [(3, None), (None, 1), (12, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    frame, labels = toxic_corpus(spark)
    got = {r.doc_id: r for r in score_documents(frame, labels).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert 60 < len(held) < 200
    right = sum(got[i].predicted == (i % 6 == 0) for i in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score and got[900].predicted == 0 and got[None].predicted == 1
    kept = drop_toxic(frame, labels)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r.predicted == 0 for r in got.values()) - (got[0].predicted == 0)


def test_voters_the_sample_does_not_hold_count(spark):
    frame, labels = toxic_corpus(spark)
    plain = "alor bkar"
    planted = docs(spark, [(1000, f"{plain} vermin {plain}", "s"), (1001, f"{plain} f**k {plain}", "s"),
                           (1002, f"{plain} {plain}", "s"), (1003, f"{plain} crétin {plain}", "s"),
                           (1004, f"{plain} " * 150_000 + "scum", "s"), (1005, f"{plain} " * 150_000, "s")])
    got = {r.doc_id: r.predicted for r in score_documents(frame.unionByName(planted), labels).collect()}
    assert [got[i] for i in range(1000, 1006)] == [1, 1, 0, 1, 1, 0]


def test_a_pattern_is_learnt_as_a_feature(spark):
    frame, labels = toxic_corpus(spark)
    clean = [w for r in frame.filter("doc_id < 600 AND doc_id % 6 = 1").collect() for w in r.text.split()]
    rng = random.Random(31)
    shouts = [(2000 + i, " ".join(rng.sample(clean, 20)) + " !!!!" * (i % 2), "s") for i in range(300)]
    more = spark.createDataFrame([(2000 + i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_documents(frame.unionByName(docs(spark, shouts)), labels.unionByName(more)).collect()}
    held = [i for i in range(300) if got[2000 + i].held_out]
    assert sum(got[2000 + i].predicted == i % 2 for i in held) / len(held) > 0.95


def plain_label_model(votes, m, prior, anchor, belief, rounds):
    """The estimate, cell by cell, without arrays or Spark."""
    total = sum(n for _, n in votes)
    rho = [[0.0] * m for _ in range(m)]

    def log_odds(prior, rates, rho):
        prior, bias, weights = min(max(prior, 1e-4), 1 - 1e-4), 0.0, []
        for i in range(m):
            c, t = (min(max(rates[k][i], 1e-6), 1 - 1e-6) for k in (0, 1))
            absent = math.log((1 - t) / (1 - c)) / (1 + sum(rho[i]))
            bias += absent
            weights.append(math.log(t / c) - absent)
        return math.log(prior / (1 - prior)) + bias, weights

    bias, weights = log_odds(prior, anchor, rho)
    for _ in range(rounds):
        post = []
        for cast, _ in votes:
            z = bias + sum(weights[i] / (1 + sum(rho[i][j] for j in cast)) for i in cast)
            post.append(1 / (1 + math.exp(-z)))
        mass = min(max(sum(n * p for (_, n), p in zip(votes, post)), 1e-3), total - 1e-3)
        both = [[sum(n * p for (cast, n), p in zip(votes, post) if i in cast and j in cast) for j in range(m)] for i in range(m)]
        every = [sum(n for cast, n in votes if i in cast) for i in range(m)]
        p = [both[i][i] / mass for i in range(m)]
        rho = [[0.0] * m for _ in range(m)]
        for i in range(m):
            for j in range(m):
                if i != j and both[i][i] + both[j][j] >= 6:
                    spread = math.sqrt(max(p[i] * (1 - p[i]), 1e-12) * max(p[j] * (1 - p[j]), 1e-12))
                    r = min(max((both[i][j] / mass - p[i] * p[j]) / spread, 0), 1)
                    rho[i][j] = r if r >= 0.1 else 0.0
        rates = [[((every[i] - both[i][i] + belief[0][i]) / (total - mass + 100) + anchor[0][i]) / 2 for i in range(m)],
                 [((both[i][i] + belief[1][i]) / (mass + 20) + anchor[1][i]) / 2 for i in range(m)]]
        bias, weights = log_odds((mass / total + prior) / 2, rates, rho)
    return bias, weights, rho


def test_label_model_equals_plain_em(spark):
    rng = random.Random(17)
    seen = {}
    for _ in range(800):
        toxic = rng.random() < 0.2
        cast = {i for i in range(5) if rng.random() < (0.4 if toxic else 0.03)}
        cast |= {5} if 0 in cast and rng.random() < 0.9 else set()
        seen[tuple(sorted(cast))] = seen.get(tuple(sorted(cast)), 0) + 1
    votes = sorted(seen.items())
    anchor = np.array([[0.04] * 6, [0.3] * 6])
    belief = np.array([[0.1] * 6, [0.1, 0.2, 0.1, 0.1, 0.2, 0.1]])
    frame = spark.createDataFrame([(list(v), n) for v, n in votes], "votes array<int>, n long").repartition(3)
    bias, weights, rho = label_model(frame, 6, 0.2, anchor, belief, rounds=6)
    want = plain_label_model(votes, 6, 0.2, anchor.tolist(), belief.tolist(), 6)
    assert bias == pytest.approx(want[0], rel=1e-9)
    assert list(weights) == pytest.approx(want[1], rel=1e-9)
    assert rho[0, 5] > 0.5 and rho.tolist() == [pytest.approx(r, abs=1e-9) for r in want[2]]


def test_held_out_labels_do_not_matter(spark):
    frame, labels = toxic_corpus(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in score_documents(frame, labels).collect()}
    b = {r.doc_id: r.score for r in score_documents(frame, flipped).collect()}
    assert a == pytest.approx(b, abs=1e-6)


def test_toxicity_without_rows_or_labels(spark):
    frame, labels = toxic_corpus(spark)
    assert score_documents(frame.limit(0), labels).count() == 0
    got = {r.doc_id: r.score for r in score_documents(frame, labels.limit(0)).collect()}
    assert got[None] > got[900]


def test_importance_weights_and_selection(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(20)), "s") for i in range(100)]
    bad = [(i, " ".join(rng.choice(["junk", "spam", "beta"]) for _ in range(20)), "s") for i in range(100, 200)]
    rows = good + bad + [(300, None, "s"), (301, "", "s"), (5, good[5][1], "s"), (None, "alpha", "s")]
    frame = docs(spark, rows)
    got = importance_sample(frame, frame.filter("doc_id < 50"), keep=0.5).collect()
    assert sum(r.selected for r in got) >= round(len(rows) / 2)
    assert min(r.key for r in got if r.selected) > max(r.key for r in got if not r.selected)
    assert sum(r.selected for r in got if r.doc_id is not None and r.doc_id < 100) >= 95
    raw = sum(np.bincount(hashed_ngrams(t), minlength=10_000) for _, t, _ in rows)
    target = sum(np.bincount(hashed_ngrams(t), minlength=10_000) for i, t, _ in rows if i is not None and i < 50)
    ratio = np.log((target + 1) / (target.sum() + 10_000)) - np.log((raw + 1) / (raw.sum() + 10_000))
    weight = {i: ratio[hashed_ngrams(t)].sum() for i, t, _ in rows}
    assert all(r.log_weight == pytest.approx(weight[r.doc_id]) for r in got)
    assert importance_sample(frame.limit(0), frame).count() == 0
    assert all(r.selected for r in importance_sample(frame, frame.limit(0), k=10**6).collect())


def test_kth_largest(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(500)] + [1.5] * 50 + [1.5 + 2**-52] * 3
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 3, 60, 300, len(values)):
        assert kth_largest(frame, k, bins=7) == sorted(values, reverse=True)[k - 1]


def test_the_decoded_text_is_that_of_the_ids(bpe):
    encoder = PieceEncoder(read_model(bpe[0]))
    for text in ("hello world", "two  spaces é\U00013000 and\nlines"):
        words = encoder.encode_words(text)
        assert "".join(t for _, t in words)[1:] == text == encoder.decode(encoder.encode(text))
    encoder = PieceEncoder(read_model(bpe[0]))
    encoder._prepare()
    encoder.pieces[int(encoder.encode("hello")[0])] = SPACE + "other"
    encoder.memo.clear()
    assert [t for _, t in encoder.encode_words("hello")] == [encoder.pieces_text(encoder.encode("hello"))]
    assert "other" in encoder.encode_words("hello")[0][1]


MESSAGES = [
    (1, 0, "user", "Hello there\n\nHow are you?"), (1, 1, "bot", "> How are you?\nFine."), (1, 2, "user", "unrelated"),
    (1, 3, "a", "Bob wrote:\n> Hello  THERE\n>> nested old\nyes"), (1, 4, "b", "> Fine.\n>> How are you?\nok"),
    (1, 4, "b", "again"), (2, 0, "u", None), (2, 1, "u", "> unrelated\nfrom elsewhere"), (None, None, "u", "x > y"),
    (3, 0, "u", ""), (3, 1, "u", "> nobody said this"), (3, 2, "u", "z " * 30000)]


def test_quotes_are_linked_and_removed(spark):
    frame = spark.createDataFrame([(*m, 1, "k") for m in MESSAGES], "conv_id long, turn long, role string, text string, depth int, key string")
    got = {(r.conv_id, r.turn, r.text): (r.position, r.reply_to, r.depth, r.n_quotes, r.n_linked) for r in reply_order(frame).collect()}
    assert got == {
        (1, 0, "Hello there\n\nHow are you?"): (0, None, 0, 0, 0), (1, 1, "Fine."): (1, 0, 1, 1, 1),
        (1, 2, "unrelated"): (2, 1, 2, 0, 0), (1, 3, "yes"): (3, 0, 1, 2, 1), (1, 4, "ok"): (4, 1, 2, 2, 2),
        (1, 4, "again"): (4, 1, 2, 0, 2), (2, 0, ""): (0, None, 0, 0, 0), (2, 1, "from elsewhere"): (1, 0, 1, 1, 1),
        (None, None, "x > y"): (0, None, 0, 0, 0), (3, 0, ""): (0, None, 0, 0, 0), (3, 1, ""): (1, 0, 1, 1, 0),
        (3, 2, "z " * 30000): (2, 1, 2, 0, 0)}
    assert reply_order(frame.limit(0)).count() == 0


def test_parts_of_a_passage_and_other_conversations_are_tried(spark):
    rows = [
        (1, 0, "first one here\n\nsecond two here\n\nthird three"), (1, 1, "one line\na long line that is edited later\nlast line"),
        (1, 2, "no quote"), (1, 3, "> first one\n> here\n>\n> second two, but changed a lot\nyes"),
        (1, 4, "> a long line that was edited later\n> last line\nno"),
        # its own conversation is the first that holds the text, but only later
        (1, 5, "> held elsewhere too\nheld elsewhere too"), (2, 0, "held elsewhere too"), (3, 0, "held elsewhere too"),
        (None, 0, "> held by none\nheld by none"), (5, 0, "held by none"), (4, 0, "> alone\nalone")]
    frame = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked) for r in reply_order(frame).collect()}
    assert got == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 0), (1, 2): (1, 0, 0), (1, 3): (0, 1, 1), (1, 4): (1, 1, 1), (1, 5): (4, 1, 1),
        (2, 0): (None, 0, 0), (3, 0): (None, 0, 0), (None, 0): (None, 1, 1), (5, 0): (None, 0, 0), (4, 0): (None, 1, 0)}
    links = {(r.conv_id, r.turn): (r.from_conv, r.from_turn) for r in quote_links(_parsed(frame)).collect()}
    assert links[(1, 5)] == (2, 0) and links[(None, 0)] == (5, 0)


def test_a_message_without_a_turn_quotes_earlier_ones(spark):
    import duckdb

    from tabforge.llm.queries import QUOTES_SQL

    rows = [(1, 0, "u", "the first text"), (1, 1, "u", "another"), (1, None, "u", "> the first text\nreply"),
            (2, None, "u", "> alone\nalone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in reply_order(frame).select("conv_id", "text", "position", "reply_to", "depth", "n_quotes", "n_linked").collect())
    assert got == [(1, "another", 1, 0, 1, 0, 0), (1, "reply", 2, 0, 1, 1, 1), (1, "the first text", 0, None, 0, 0, 0),
                   (2, "alone", 0, None, 0, 1, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    want = con.sql(f"SELECT conv_id, text, position, reply_to, depth, n_quotes, n_linked FROM ({QUOTES_SQL})").fetchall()
    assert sorted(want) == got


def test_quotes_match_their_sql():
    import duckdb

    from tabforge.llm.queries import QUOTES_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(m) for m in MESSAGES])
    got = {(r[0], r[1], r[8]): r[3:8] for r in con.sql(QUOTES_SQL).fetchall()}
    assert got[(1, 3, "yes")] == (3, 0, 1, 2, 1) and got[(2, 1, "from elsewhere")] == (1, 0, 1, 1, 1)
    assert len(got) == len(MESSAGES)


def test_quote_levels():
    assert parse("> > two\n>one\nown") == ("own", [(2, "two"), (1, "one")])
    assert parse("1 > 0") == ("1 > 0", [])
    assert re.match("", parse(None)[0])


def vectors(n=1500, dim=24):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[n // 2:] = rng.normal(size=(10, dim))[rng.integers(0, 10, n - n // 2)] + 0.05 * rng.normal(size=(n - n // 2, dim))
    x[300:340] = x[300]
    return x.astype(np.float32)


def test_nearest_matches_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in x[i]], 0, 0.0) for i in range(len(x))]
    rows += [(2000, None, 0, 0.0), (2100, [0.0] * 24, 0, 0.0), (2200, [float("nan")] * 24, 0, 0.0), (2300, [1.0], 0, 0.0),
             (2400, [None] * 24, 0, 0.0), (None, rows[3][1], 0, 0.0), (2500, [], 0, 0.0), (7, rows[7][1], 0, 0.0)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in nearest(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    y = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 1500, 100))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((d[r.vec_id], r.vec_id) for r in found)
        hits += len(set(best.tolist()) & {r.vec_id for r in found})
    assert hits / (10 * len(got)) >= 0.9
    assert [r.vec_id for r in got[300]] == list(range(301, 311))
    assert nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_where_few_buckets_are_visited(spark):
    from pyspark.sql import functions as F

    y = np.random.default_rng(4).normal(size=(6000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(frame, F.col("vec_id") % 100 == 0, tables=2, occupancy=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.95


def test_layout_visits_every_bucket_where_hashing_does_not_prune():
    from tabforge.llm.cross_polytope import Tables, layout

    # opposite vectors as neighbours: the last in every order of probes
    x = np.random.default_rng(5).normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables, probes, occupancy = layout(16, 20000, 200, [(v, -v[None]) for v in x], 4)
    assert (tables, probes) == (1, Tables(16, 20000, 1, 1, occupancy).buckets)
    few = layout(16, 2000000, 20000, [(v, v[None] + 1e-9) for v in x], 4)
    assert few[1] < 4


def test_buckets_above_the_unit_size(spark, monkeypatch):
    import tabforge.llm.cross_polytope as module
    from pyspark.sql import functions as F

    x = vectors()
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, nearest(frame, F.col("vec_id") % 100 == 0).collect()))
    monkeypatch.setattr(module, "UNIT", 16)
    assert sorted(map(tuple, nearest(frame, F.col("vec_id") % 100 == 0).collect())) == whole


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_a_word_that_decodes_to_itself_is_kept_once():
    """The memo held each word's ids, its decoded text and a tuple of both: of an executor's memory too much."""
    from tabforge.llm import piece_bpe
    from tabforge.llm.queries import model_path

    encoder = piece_bpe.PieceEncoder(piece_bpe.read_model(model_path()))
    for text in ("plain words, and 日本語 too", "\u2581x\u2581 y", " a  b ", "a\x00b \U0001f642", "", "  ", "a\nb"):
        pairs = encoder.encode_words(text)
        assert encoder.encode_text(text) == (",".join(i for i, _ in pairs), "".join(t for _, t in pairs)[1:])
    assert encoder.memo and all(isinstance(v, str) for v in (*encoder.memo.values(), *encoder.parts.values()))
    encoder.memo["odd"] = ("1,2", " other")  # a word that decodes to something else keeps it
    assert encoder.encode_text("an odd word")[1] == "an other word"


def test_a_part_is_encoded_once_a_batch(bpe, monkeypatch):
    """words were looked up whole, one by one, so that a stem was met anew with every mark after it."""
    from tabforge.llm import piece_bpe

    monkeypatch.setattr(piece_bpe, "MEMO_WORDS", 20)  # the memo alone cannot hold the stems
    _, _, library = bpe
    encoder = PieceEncoder(read_model(bpe[0]))
    encoder._prepare()
    calls = []
    monkeypatch.setattr(encoder, "tokens", lambda s, tokens=encoder.tokens: calls.append(s) or tokens(s))
    stems = [a + b for a in ("then", "ing", "Ren", "all") for b in ("oth", "ere", "ach", "ung", "ado")]
    texts = [" ".join(s + mark for s in stems) for mark in ("", "\n", "\n\nñ", "Ç", "\x00")]
    ids, ends, decoded = encoder.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode(texts) and decoded == texts
    assert len(calls) == len(set(calls)) and len(calls) < 30


def test_batches_equal_the_library(bpe, monkeypatch):
    from tabforge.llm import piece_bpe

    monkeypatch.setattr(piece_bpe, "MEMO_WORDS", 40)
    _, _, library = bpe
    rng = random.Random(21)
    bits = ["a", "b", "é", "ñ", SPACE, " ", "  ", "\n", "\t", ".", ",", "%%", "the", "ing", "ß", "執", "🙂", "\0", "0x1", "don't", "z" * 70]
    for chars, kinds in ((1, 4000), (7, 4000), (1000, 40), (50_000, 4000)):
        monkeypatch.setattr(piece_bpe, "SLICE_CHARS", chars)
        monkeypatch.setattr(piece_bpe, "CHAR_KINDS", kinds)  # 259 in the model
        encoder = PieceEncoder(read_model(bpe[0]))
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)]
        texts += [None, "", " ", SPACE, "   ", "x ", " x", "", "word" + " " * 9, " " * 9, None]
        ids, ends, decoded = encoder.encode_batch(texts)
        want = library.encode([t or "" for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        assert decoded == library.decode(want) == [encoder.encode_text(t or "")[1] for t in texts]
        assert len(encoder.parts) <= 40 and len(encoder.parts.old) <= 40
    assert [len(x) for x in encoder.encode_batch([None, ""])] == [0, 3, 2] and len(encoder.encode_batch([])[0]) == 0


def test_a_batch_decodes_its_ids(bpe):
    encoder = PieceEncoder(read_model(bpe[0]))
    encoder._prepare()
    encoder.pieces[int(encoder.encode("hello")[0])] = SPACE + "other"
    encoder.memo.clear()
    encoder.parts.clear()
    assert encoder.encode_batch(["so hello", "plain"])[2] == ["so" + encoder.pieces_text(encoder.encode("hello")), "plain"]
