"""Language, toxicity, quality and tokenisation: held-out accuracy, brute force and exact round trips on small tables."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from sentencepiece import sentencepiece_model_pb2 as proto

import corpus_pipeline
from agendula.llm import langid, quality, sptok, toxicity
from agendula.llm.calibrate import fit_logistic, logistic

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _odd(spark, like):
    rows = [(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "123 !!! \n\n", "en", "s", 0), (10**9 + 1, "x", None, None, None), (10**9 + 2, "a" * 300_000 + " b\n" * 1000, "en", "s", 0)]
    return like.unionByName(spark.createDataFrame(rows, like.schema))


def test_language_held_out(spark, docs):
    got = langid.predict(_odd(spark, docs)).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.98
    assert sorted((r.lang_pred, r.score) for r in got if r.doc_id in (None, 10**9)) == [("und", 0.0)] * 2
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(want) + 5
    kept = {r.doc_id for r in langid.keep_identified(_odd(spark, docs)).select("doc_id").collect()}
    assert not {None, 10**9} & kept and set(want) <= kept


def test_mixture_finds_both_languages():
    r = random.Random(1)
    counts = np.zeros((1 << langid.BITS, 3))
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    sets = ["abcdef", "ghijkl", "mnopqr"]
    for i, letters in enumerate(sets):
        np.add.at(counts[:, i], langid.grams(text(letters, 3000)), 1)
    model = langid.Model(["x", "y", "z"], counts)
    share = model.infer(text(sets[0], 60) + " " + text(sets[2], 30))
    assert set(share) == {"x", "z"} and abs(share["x"] - 2 / 3) < 0.05
    assert model.infer(text(sets[1], 50)) == {"y": 1.0}
    # The proportions are a fixed point of expectation-maximisation.
    g = langid.grams(text(sets[0], 60) + " " + text(sets[2], 30))
    p = np.exp(model.log[g].astype(float))[:, [0, 2]]
    u, n = np.unique(g, return_counts=True)
    s, _ = model._mix(np.exp(model.log[u].astype(float)), n.astype(float), [0, 2], 0.0)
    assert np.allclose((p * s / (p @ s)[:, None]).mean(axis=0), s, atol=1e-3)


def test_language_without_labels(spark, docs):
    got = langid.predict(docs.limit(5).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 5
    assert langid.predict(docs.limit(0)).collect() == []


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(_odd(spark, docs), labels).collect()
    want = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.96
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got if r.doc_id is not None)
    assert {r.predicted for r in got if r.doc_id in (None, 10**9)} == {0}


def _kneser_ney(grams):
    """log P(word | toxic) - log P(word | ordinary) by dictionaries, from {gram: (clean, toxic)}."""
    from collections import Counter

    order, level, cont = toxicity.ORDER, set(grams), {}
    for k in range(order - 1, 0, -1):
        cont[k] = Counter(g[1:] for g in level)
        level = set(cont[k])
    tops = [{g: n[c] for g, n in grams.items()} for c in (0, 1)]
    seen = [[sum(v == k for v in t.values()) for k in (1, 2)] for t in tops]
    taken = [one / (one + 2 * two) if one and two else toxicity.TOP_DISCOUNT for one, two in seen]

    def smooth(counts, discount, g, below):
        total = sum(v for h, v in counts.items() if h[:-1] == g[:-1])
        if not total:
            return below
        rest = sum(min(v, discount) for h, v in counts.items() if h[:-1] == g[:-1])
        return (max(counts.get(g, 0) - discount, 0) + rest * below) / total

    def log_odds(word):
        s, out = toxicity._START + word + toxicity._END, 0.0
        for i in range(order - 1, len(s)):
            p = 1e-4
            for k in range(1, order):
                p = smooth(cont[k], toxicity.DISCOUNT, s[i - k + 1 : i + 1], p)
            q = [smooth(t, d, s[i - order + 1 : i + 1], p) for t, d in zip(tops, taken, strict=True)]
            out += np.log(q[1]) - np.log(q[0])
        return out

    return log_odds


def test_whole_toxicity_scores_match_brute_force(spark, monkeypatch):
    """Kneser-Ney by dictionaries, evidence by text and the logistic weights, against the tables, in chunks of a few texts."""
    from collections import defaultdict

    monkeypatch.setattr(toxicity, "CHUNK", 300)
    r = random.Random(4)
    base = ["moron", "morons", "more", "mo", "a", "ab", "été", "𝒳y", "river", "rivers"]
    texts = [" ".join(r.choice(base[:4] if i % 2 and r.random() < 0.6 else base[2:]) for _ in range(r.randrange(1, 9))) for i in range(120)] + ["", "!!", "zzz unseen", "MORON moron"]
    docs = spark.createDataFrame([(i, t, 0.1, 1) for i, t in enumerate(texts)] + [(None, None, 0.2, 0), (None, "moron", 0.2, 0)], "doc_id long, text string, score double, label int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(110)], "doc_id long, toxic int")
    crc = lambda i: zlib.crc32(str(i).encode())
    grams = defaultdict(lambda: [0, 0])
    for i in range(110):
        if crc(i) % 5 and crc(i) % 25 // 5:
            for w in set(toxicity.words_of(texts[i])):
                for g in toxicity.spell(w):
                    grams[g][i % 2] += 1
    odds = _kneser_ney(grams)

    def brute(text):
        words = toxicity.words_of(text)
        if not words:
            return 0.0, 0.0
        once = [odds(w) for w in set(words)]
        return np.mean([odds(w) for w in words]), sum(v for v in once if v > toxicity.STRONG) / len(once) ** 0.5

    want = [brute(t) for t in texts]
    aside = [i for i in range(110) if crc(i) % 5 and crc(i) % 25 // 5 == 0]
    scale = lambda x: np.column_stack([10 * np.array(x)[:, 0], np.log1p(np.array(x)[:, 1])])
    w = fit_logistic(scale([want[i] for i in aside]), np.array([i % 2 for i in aside], float))
    score = logistic(scale(want), w)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(texts) + 2
    by = {x.doc_id: x.score for x in got if x.doc_id is not None}
    assert np.allclose([by[i] for i in range(len(texts))], score, atol=1e-6)
    assert np.allclose(sorted(x.score for x in got if x.doc_id is None), sorted(logistic(scale([(0.0, 0.0), brute("moron")]), w)), atol=1e-6)


def test_quality_held_out(spark, docs, labels):
    got = quality.score(_odd(spark, docs), labels).collect()
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got if r.doc_id is not None)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got if r.predicted and r.doc_id is not None and r.doc_id < 10**9}


def test_forward_backward_matches_enumeration():
    r = np.random.default_rng(1)
    from itertools import product

    lengths = np.array([5, 4, 1])
    score, moves = r.normal(size=(5, 3)), r.normal(size=(2, 2))
    p, pairs = quality.marginals(score, moves, lengths)
    for c, n in enumerate(lengths):
        total, bad, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[t, c] * s for t, s in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            bad += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                moved[a, b] += w
        assert np.allclose(p[:n, c], bad / total) and np.allclose(pairs[c], moved / total)
        assert np.allclose(quality._chain(score[:n, c].tolist(), np.exp(moves).ravel().tolist()), bad / total)


def test_lines_far_down_a_text_teach_the_field(spark):
    r = random.Random(4)
    plain = lambda: " ".join(r.choice(["the", "river", "house", "morning", "walked", "slowly", "under"]) for _ in range(12)).capitalize() + "."
    junk = lambda: "$$$ %% ### 0x7F >>> " * 3
    texts = [("\n".join([plain() for _ in range(300)] + [(plain if i % 2 else junk)() for _ in range(60)]), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, (t, _) in enumerate(texts)], "doc_id long, text string, good string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, good int")
    field = quality.train(docs, labels)
    score = lambda line: quality.features(f"{line}\n{line}\n{line}")[0][1] @ field.w
    assert score(junk()) > score(plain()) + 1
    assert [x.predicted for x in quality.score(docs, labels).orderBy("doc_id").collect()] == [y for _, y in texts]


def test_whole_quality_scores_match_brute_force(spark, docs, labels):
    from itertools import product

    field = quality.train(docs, labels)
    texts = {"a": "A plain line of text.\n$$$ ### %%% 0x00\n\nWords again, quite ordinary ones.", "b": "", "c": "CLICK HERE NOW!!!\nclick here now"}
    for text in texts.values():
        x, n = quality.features(text)
        total, bad = 0.0, np.zeros(len(x))
        for y in product((0, 1), repeat=len(x)):
            w = np.exp(sum(np.clip(x[t] @ field.w, -30, 30) * s for t, s in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, bad = total + w, bad + w * np.array(y)
        n = np.maximum(n, 1)
        assert abs(field.bad_share(text) - (bad / total) @ n / n.sum()) < 1e-9


def test_models_without_labels(spark, docs, labels):
    for f in (toxicity.score, quality.score):
        got = f(docs.limit(4), labels.limit(0)).collect()
        assert len(got) == 4 and all(r.score == 0.5 for r in got)
        assert f(docs.limit(0), labels).collect() == []


ODD = ["", " ", "  ", " a", "a ", "a  b", "\n\n a", "▁x", "x▁", "▁ ▁", "日本 語", "\0a", "é́", "😀😀 😀", "a\tb", "   lead", "trail   ", " \n ", "...  ...", "<unk> <s> <0x41>", "　x", "ﬁ ½"]


def test_bpe_parity_and_round_trip(spark, docs):
    data = sptok.read_model()
    texts = [r.text for r in docs.limit(300).collect()] + ODD
    assert sptok.differing(data, texts) == []
    model, own = sptok.SentencePiece(data), sptok.reference(data)
    assert [model.decode(i).decode("utf-8", "replace") for i in model.encode(ODD)] == [own.decode(own.encode(t)) for t in ODD]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    back = sptok.decode(sptok.encode(df)).collect()
    assert all(r.text == t for r, t in zip(sorted(back, key=lambda r: r.doc_id), [*texts, None], strict=True) if "▁" not in (t or ""))
    assert all(r.round_trip == ("▁" not in (t or "")) for r, t in zip(sorted(sptok.digests(df).collect(), key=lambda r: r.doc_id), [*texts, None], strict=True))
    assert sptok.encode(df.limit(0)).collect() == []


@pytest.mark.parametrize(("squeeze", "prefix", "fallback"), [(True, True, True), (False, True, False), (True, False, True)])
def test_unigram_parity(squeeze, prefix, fallback):
    """A unigram model put together by hand: pieces of the public vocabulary with scores by length and rank."""
    m = proto.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, prefix
    r = random.Random(3)
    for p in m.pieces:
        if p.type == 1:
            p.score = -3.0 - 7.0 * r.random() - 1.5 / len(p.piece)
    if not fallback:
        kept = [p for p in m.pieces if p.type != 6]
        del m.pieces[:]
        m.pieces.extend(kept)
    texts = ["Hello world, the quick  brown fox", "naïve café 日本", "a b  c", "words ▁ and more words", *["".join(r.choice("abc de\n") for _ in range(80)) for _ in range(30)]]
    assert sptok.differing(m.SerializeToString(), texts) == []


def test_texts_without_spaces_are_not_kept():
    data = sptok.read_model()
    model = sptok.SentencePiece(data, room=20_000)
    own, r = sptok.reference(data), random.Random(1)
    for _ in range(6):
        texts = ["".join(r.choice("abcdefé日") for _ in range(3000)), "short words and " + "x" * 500, " ".join(f"w{r.randrange(10**6)}" for _ in range(100))]
        assert [i.tolist() for i in model.encode(texts)] == own.encode(texts)
        assert max(map(len, model.known)) <= sptok.LONG and sum(map(len, model.known)) < 60_000


def test_parser_reads_what_protobuf_writes():
    data = sptok.read_model()
    m = proto.ModelProto()
    m.ParseFromString(data)
    spec = sptok.parse(data)
    assert spec["pieces"] == [(p.piece, p.score, p.type) for p in m.pieces]
    assert (spec["type"], spec["byte_fallback"], spec["squeeze"], spec["prefix"]) == (2, True, False, True)


def test_pipeline(spark, docs, labels):
    spark_docs, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in spark_docs.select("doc_id").collect()}
        spark_docs = stage(spark, spark_docs, SF)
        assert spark_docs.columns == docs.columns, name
        spark_docs = spark.createDataFrame(spark_docs.collect(), docs.schema)
        assert {r.doc_id for r in spark_docs.select("doc_id").collect()} <= before
        counts.append(spark_docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] and counts[1] > 0.98 * counts[0]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == counts[4]
    own = sptok.reference(sptok.read_model())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.token_ids == own.encode(texts[r.doc_id]) for r in out.limit(50).collect())
