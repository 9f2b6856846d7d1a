"""Whole jobs: what earlier versions of the training-data operators cut short."""

import random
import zlib

import numpy as np

from agendula.llm import langid, simhash, toxicity


def _labelled(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")


def test_every_gram_has_counts_of_its_own(spark):
    r = random.Random(2)
    texts = [(" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(20)), i % 2) for i in range(400)]
    docs, labels = _labelled(spark, texts)
    table = toxicity.counts(docs, toxicity.known_labels(labels))
    counted = [t for i, (t, _) in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 25 // 5]
    spelled = [toxicity._START + w + toxicity._END for t in counted for w in t.split()]
    grams = {s[i : i + toxicity.ORDER] for s in spelled for i in range(len(s) - toxicity.ORDER + 1)}
    assert len(grams) > 20_000
    assert table.where("clean + toxic > 0").count() == len(grams)


def test_rare_expressions_of_a_class_carry_evidence(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [(" ".join(word() for _ in range(15)), i % 2) for i in range(400)]
    counted = [i for i in range(1, 400, 2) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 25 // 5]
    for i in counted[:2]:
        texts[i] = (texts[i][0] + " abcdxyzzyx", 1)
    docs, labels = _labelled(spark, texts)
    words = spark.createDataFrame([("abcdxyzzyx",)], "word string")
    assert toxicity.word_evidence(words, toxicity.counts(docs, toxicity.known_labels(labels))).first().v > 2


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang != 'de'").select("doc_id", "text", "lang")
    other = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'de'").selectExpr("doc_id", "text", "cast(null as string) lang")
    r = random.Random(3)
    noise = [(10**9 + i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)), None) for i in range(20)]
    n_docs, n_other = docs.count(), other.count()
    both = docs.unionByName(other).unionByName(spark.createDataFrame(noise, docs.schema))
    kept = langid.keep_identified(both).selectExpr("lang is null as other", "doc_id").collect()
    assert sum(not x.other for x in kept) == n_docs
    assert not [x for x in kept if x.doc_id >= 10**9]
    assert sum(x.other for x in kept) < 0.05 * n_other


def test_near_copies_match_brute_force(spark):
    r = random.Random(11)
    texts = []
    for n in [5, 6, 7, 8, 9, 10, 12, 15, 20] * 12 + [90, 100, 120] * 25:
        w = [f"w{r.randrange(10**6)}" for _ in range(n)]
        v = w[1:] if r.random() < 0.4 else [*w, "x"] if r.random() < 0.5 else [*w, *(f"y{k}" for k in range(r.randrange(1, 3 + n // 5)))]
        for p in r.sample(range(len(v)), r.randrange(0, 4) if n >= 90 else 0):
            v[p] += "z"
        texts += [" ".join(w), " ".join(v)]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(0, len(texts), 2):
        if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) - 1e-9:
            root[i + 1] = i
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()
    assert sorted(x.doc_id for x in got) == sorted(set(root))


def _groups(texts):
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_large_candidate_components_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    monkeypatch.setattr(simhash, "FREQUENT", 8)
    r = random.Random(21)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    line = [f"l{i}" for i in range(9)]
    texts = []
    for _ in range(140):
        w = list(base)
        for p in r.sample(range(120), r.randrange(1, 5)):
            w[p] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    for _ in range(60):  # one common line among brief texts, a few of which are alike
        w = line + [f"v{r.randrange(10**6)}" for _ in range(r.choice([1, 2, 30]))]
        texts += [" ".join(w)] * (1 + (r.random() < 0.2))
    want = _groups(texts)
    assert 5 < len(set(want)) < 150
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()
    assert sorted(x.doc_id for x in got) == sorted(set(want))


def test_block_keys_grow_with_the_rows():
    few, many = (simhash.Scheme(8, 111, rows=n, share=simhash.share_apart(0.8)) for n in (10**5, 10**10))
    assert few.bits == 16 and many.bits == 28 and many.n > few.n
    fps = np.random.default_rng(1).integers(0, 1 << 63, (50, 8)).astype(np.uint64)
    for s in (few, many):
        keys = s.keys(fps)
        assert keys.shape == (50, s.n) and int(keys.max()) < 1 << s.bits
        assert len(np.unique(keys[:, 0])) > 40


def test_near_dedup_of_a_very_long_text_among_clashing_columns(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long, "a", 0, "x"), (2, long + " end", "b", 1, "y"), (3, "", None, None, None), (None, None, "c", 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, cand int, shingles string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(str(x.doc_id) for x in got.collect()) == ["1", "3"]
    same = simhash.near_duplicates(df).collect()
    assert len(same) == 4 and len({x.component_id for x in same if x.doc_id in (1, 2)}) == 1


def test_components_over_many_chunks_of_edges(spark, monkeypatch):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(200)] + [(500, 501), (501, 500), (7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in list(root) if find(i) != i}
    for chunk in (1 << 20, 32):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert {x.node: x.root for x in got if x.node != x.root} == want
    assert simhash.components(spark.createDataFrame([], "u binary, v binary")).collect() == []
