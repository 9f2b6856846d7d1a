"""Licence scans by diagonal voting, with DataFrame functions alone.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Hashes of all runs of ``k`` words of a document are joined
with those of the templates; equal hashes whose words are equal vote for the diagonal: the place where the template would
begin in the document. Votes are counted before they are shuffled, one row a document, template and diagonal. Words that were
left out or put in move the diagonal, so diagonals up to ``gap`` apart merge. A merged span is verified by the template's words that
its runs hold: their share of the template, or of the span where that is longer, is its score; a diagonal counts alone as well.

Phrases (short templates, by runs of two words) hold only where all their words stand: their places are counted one by one. A
notice gives its label where its score is ``least`` or more. A document's score is the best of any template, 1.0 for a whole one.

The templates' runs are broadcast; their number is checked against ``MOST_GRAMS`` first.

Defined results: null text counts as empty; documents without a match have empty labels, no places and score 0; repeated rows and null
ids each get their row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, GAP, LEAST, MOST_GRAMS = 3, 3, 0.8, 100_000

# --- fixed values: phrases and the label each gives
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# --- fixed values: public licence notices and the label each gives
NOTICES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # To split takes time linear in a text; to extract all matches copies the whole text for each of them.
    return F.array_remove(F.split(lowered, BETWEEN), "")


def split(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def _gram(at, k: int) -> Column:
    """The words that ``at(0)``, ``at(1)``, ... give, as one text; words hold no spaces."""
    return F.concat_ws(" ", *[at(i) for i in range(k)])


def _table(spark: SparkSession, templates: Sequence[tuple[int, list[str]]], k: int, name: str) -> DataFrame:
    rows = [(t, len(w), i, w[i : i + k]) for t, w in templates for i in range(len(w) - k + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"templates of {len(rows)} runs of words: more than are broadcast")
    table = spark.createDataFrame(rows, "t int, n int, at int, w array<string>")
    gram = _gram(lambda i: F.col("w")[i], k)
    return F.broadcast(table.select(F.xxhash64(gram).alias(f"{name}_hash"), gram.alias(f"{name}_gram"), F.struct("t", "n", "at", F.lit(k).alias("k")).alias(name)))


def votes(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, k: int = K) -> DataFrame:
    """(row, doc_id, n_words, t, n, k, diagonal, at): for each diagonal of a document and template the template places that voted. ``t``
    counts the phrases, then the notices. A document without votes has one row whose t is null.
    """
    spark = docs.sparkSession
    short = _table(spark, [(t, split(p)) for t, (p, _) in enumerate(phrases)], 2, "p")
    long = _table(spark, [(len(phrases) + t, split(text)) for t, (_, text) in enumerate(notices)], k, "q")
    split_docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text")).alias("w"))
    split_docs = split_docs.withColumn("n_words", F.size("w").cast("long"))
    each = split_docs.select("row", "doc_id", "n_words", "w", F.posexplode_outer("w").alias("pos", "word"))
    each = each.withColumns({f"__{n}": _gram(lambda i: F.get("w", F.col("pos") + i), n) for n in {2, k}})
    met = each.drop("w").join(short, F.xxhash64("__2") == F.col("p_hash"), "left").join(long, F.xxhash64(f"__{k}") == F.col("q_hash"), "left")
    # Equal hashes count only with equal words.
    hits = [F.when(F.col("p_gram") == F.col("__2"), F.col("p")), F.when(F.col("q_gram") == F.col(f"__{k}"), F.col("q"))]
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    met = met.where(first | hits[0].isNotNull() | hits[1].isNotNull()).select("row", "doc_id", "n_words", "pos", F.explode(F.array(*hits)).alias("hit"))
    met = met.where(F.col("hit").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    return met.groupBy("row", "doc_id", "n_words", F.col("hit.t").alias("t"), F.col("hit.n").alias("n"), F.col("hit.k").alias("k"), (F.col("pos") - F.col("hit.at")).alias("diagonal")).agg(F.collect_set("hit.at").alias("at"))


def spans(voted: DataFrame, n_phrases: int, gap: int = GAP) -> DataFrame:
    """(row, doc_id, n_words, t, start, score): a phrase's places and the merged spans of notices; t null for documents without any."""
    # A row's hash places all its rows, for the window and for what is aggregated after it.
    voted = voted.repartition("row")
    before = F.lag("diagonal").over(Window.partitionBy("row", "t").orderBy("diagonal"))
    apart = before.isNull() | (F.col("t") < n_phrases) | (F.col("diagonal") - before > gap)
    order = Window.partitionBy("row", "t").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    marked = voted.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    held = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("k") - 1))))
    marked = marked.withColumn("held", held).withColumn("alone", F.size("held") / F.col("n"))
    marked = marked.withColumns({"from": F.col("diagonal") + F.array_min("at"), "to": F.col("diagonal") + F.array_max("at") + F.col("k")})
    each = marked.select("row", "doc_id", "n_words", "t", "n", "run", "alone", "from", "to", F.explode_outer("held").alias("place"))
    merged = each.groupBy("row", "doc_id", "n_words", "t", "n", "run").agg(F.size(F.collect_set("place")).alias("held"), F.max("alone").alias("alone"), F.min("from").alias("start"), F.max("to").alias("end"))
    score = F.greatest("alone", F.col("held") / F.greatest(F.col("n"), F.col("end") - F.col("start")))
    return merged.select("row", "doc_id", "n_words", "t", F.col("start").cast("long").alias("start"), score.alias("score"))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, k: int = K, gap: int = GAP, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    found = spans(votes(docs, phrases, notices, k), len(phrases), gap)
    labels = F.array(*[F.lit(x) for x in [label for _, label in phrases] + [label for label, _ in notices]])
    whole = (F.col("t") < len(phrases)) & (F.col("score") >= 1)
    place = F.when(whole, F.col("start"))
    label = F.get(labels, F.col("t"))
    told = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, label))), ",")
    rated = F.when(whole | (F.col("t") >= len(phrases)), F.col("score"))
    out = found.groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), told(whole).alias("base_labels"),
        told(whole | ((F.col("t") >= len(phrases)) & (F.col("score") >= least))).alias("labels"), F.coalesce(F.max(rated), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
