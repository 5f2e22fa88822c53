"""The pipeline against a plain Python version of its stages."""

import hashlib
import random

import pytest

import corpus_pipeline
from tabforge.llm.simhash_bk import fingerprint
from tabforge.llm.weak_supervision import score_documents


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("pipeline")
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('aeiou')}{rng.choice('rstx')}" for _ in range(rng.randint(0, 300))]
        bad = i % 8 == 0
        if bad:
            words += ["idiot", "moron"]
        rows.append((i, " ".join(words), rng.choice(["one", "one", "two", "three"]), "en", "k"))
        labels.append((i, int(bad)))
    for i in range(400, 440):  # copies and copies with one word changed
        text = rows[rng.randrange(400)][1]
        if i % 2:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "other"
            text = " ".join(words)
        rows.append((i, text.upper() if i % 4 == 0 else text, "two", "en", "k"))
    rows.append((500, None, "two", "en", "k"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, count string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def mixed(rows):
    """doc_id -> times, by cumulative sums over the shuffled order."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows})
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    held = set()
    while True:
        free = [s for s in sources if s not in held]
        level = (sum(total.values()) - sum(3 * total[s] for s in held)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            break
        held.update(over)
    times = {}
    for s in sources:
        target, at = round(3 * total[s] if s in held else level * weight[s]), 0
        for epoch in range(3):
            ids = [i for i, _, x in rows if x == s and size[i]]
            for i in sorted(ids, key=lambda i: (int(hashlib.md5(f"7|{epoch}|{i}".encode()).hexdigest()[:15], 16), i)):
                if (min(at + size[i], target) - at) * 2 >= size[i]:
                    times[i] = times.get(i, 0) + 1
                at += size[i]
    return times


def test_pipeline_matches_plain_python(spark, folder):
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(folder + "/documents.parquet")
    scores = score_documents(docs, spark.read.parquet(folder + "/labels.parquet")).collect()
    clean = {r.doc_id for r in scores if r.predicted == 0}
    assert 340 < len(clean) < 400
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in clean]
    best = {}
    for i, t, _ in rows:
        best[lower(t)] = max(best.get(lower(t), -1), i)
    rows = [r for r in rows if best[lower(r[1])] == r[0]]
    fps = {i: fingerprint(t) for i, t, _ in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    rows = [r for r in rows if find(r[0]) == r[0]]
    times = mixed(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t, _ in rows:
        tokens = library.encode(t or "")
        want += [(i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(tokens).encode()).hexdigest(), tokens, library.decode(tokens))] * times.get(i, 0)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
