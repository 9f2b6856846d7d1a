"""The corpus pipeline: five stages over the documents table, each the next one's input as Parquet.

Every stage works on all rows its predecessor kept. Results for nulls, empty texts, ties and repeated rows are those of the operators:
documents without a language go first, then those of bad quality, then all but one of each near-duplicate group; the mix
repeats rows, and the last stage gives each row its token ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agendula.llm import langid, mix, quality, simhash, sptok
from agendula.llm.common import scratch

#: No stage but the mix can be stated in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def language(spark, docs, sf_dir):
    """Documents in a language that the mixture can tell stay."""
    return langid.keep_identified(docs)


def good(spark, docs, sf_dir):
    """Documents whose lines the field finds good stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark, docs, sf_dir):
    """One document of every near-duplicate group stays."""
    return simhash.keep_one(docs)


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them."""
    return mix.emit(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens and token_ids of every row."""
    out = sptok.encode(docs)
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language_id", language), ("quality", good), ("near_dedup", dedup), ("mixing", mixing), ("sentencepiece", tokens)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
