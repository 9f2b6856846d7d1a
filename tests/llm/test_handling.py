"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for operators and for every stage of the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agendula.llm import langid, mix, quality, sptok, toxicity, winnow

SF = "/root/testdata/sf0.001"
CLASH = {"label": 1, "good": "g", "score": 0.5, "predicted": 3, "held_out": "h", "lang_pred": "zz", "node": "n", "token_ids": "t", "__row": 1, "__copy": 2, "__h": 3, "__id": 4, "id": 7, "v": 1.0, "part": 9, "n_tokens": "x"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def test_scores_do_not_see_clashing_columns(spark, docs, labels):
    pick = lambda df, c: sorted((r.doc_id, r[c]) for r in df.collect())
    wide = labels.withColumns({"label": F.lit(9), "good": F.lit("x"), "text": F.lit("y")})
    assert pick(quality.score(_clashing(docs), wide), "score") == pick(quality.score(docs, labels), "score")
    assert pick(toxicity.score(_clashing(docs), wide), "predicted") == pick(toxicity.score(docs, labels), "predicted")
    assert pick(langid.predict(_clashing(docs)), "lang_pred") == pick(langid.predict(docs), "lang_pred")


def test_very_long_texts(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeé ") for _ in range(9)).strip() or "a" for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(150_000))
    df = spark.createDataFrame([(1, long, "a"), (2, "x" * 1_000_000, "a"), (3, long, "b")], "doc_id long, text string, source string")
    got = {x.doc_id: x for x in sptok.digests(df).collect()}
    own = sptok.reference(sptok.read_model()).encode(long)
    assert got[1].n_tokens == got[3].n_tokens == len(own) and all(x.round_trip for x in got.values())
    sizes = {x.doc_id: x["size"] for x in mix.mix_words(df).collect()}
    assert sizes == {1: len(long.split()), 2: 1, 3: len(long.split())}
    prints = {x.doc_id: x for x in winnow.fingerprints(df).collect()}
    changed = winnow.edited(long, "x" * 1_000_000)
    assert prints[1].n_chars == len(long) and prints[1].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    assert prints[1].fingerprint == prints[3].fingerprint and prints[3].near_next == 1.0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, docs, stage):
    name, f = corpus_pipeline.STAGES[stage]
    odd = [(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "123 !!! \n\n", None, None, 0), (None, "a plain short line of text", "en", "s", 0)]
    extra = spark.createDataFrame(odd, docs.schema)
    rows = _clashing(docs.unionByName(extra).unionByName(extra).unionByName(docs.limit(20)))
    out = f(spark, rows, SF)
    if stage < 4:
        assert out.columns == rows.columns and [x.dataType for x in out.schema] == [x.dataType for x in rows.schema]
    got = out.collect()
    kept = {x.doc_id for x in got}
    assert kept <= {x.doc_id for x in rows.collect()}
    assert name != "language_id" or 10**9 not in kept and 10**9 + 1 not in kept
    assert name != "near_dedup" or len(got) == len({(x.doc_id, x.text) for x in got})
    assert name != "sentencepiece" or len(got) == rows.count()
    assert f(spark, rows.limit(0), SF).collect() == []


def test_proportions_match_a_search_over_all_mixtures():
    """Expectation-maximisation and the choice of the set against a grid over every mixture of three models."""
    import numpy as np

    r = np.random.default_rng(3)
    counts = r.integers(0, 40, (1 << langid.BITS, 3)).astype(float)
    model = langid.Model(["x", "y", "z"], counts)
    text = "the quick brown fox jumps over the lazy dog and runs away"
    g = langid.grams(text)
    p = np.exp(model.log[g].astype(float))
    grid = [(a / 100, b / 100, (100 - a - b) / 100) for a in range(101) for b in range(101 - a)]
    best = max(np.log(p @ np.array(s)).sum() for s in grid)
    u, n = np.unique(g, return_counts=True)
    share, value = model._mix(np.exp(model.log[u].astype(float)), n.astype(float), [0, 1, 2], 0.0)
    assert abs(share.sum() - 1) < 1e-9 and value >= best - 1e-2
    cost = langid.PENALTY * np.log(len(g) + 1)
    alone = np.log(p).sum(axis=0)
    if max(np.log(p @ np.array(s)).sum() for s in grid) - alone.max() <= cost:
        assert model.infer(text) == {"xyz"[int(alone.argmax())]: 1.0}
