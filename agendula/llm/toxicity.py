"""Toxicity by class-conditional Kneser-Ney models.

Texts are words, and each word is spelled by a model of ``ORDER`` characters that starts anew with the word. The highest order is
counted for each class apart; all lower orders are Kneser-Ney continuation counts shared by both classes, so an expression
not counted under a class falls back on the same probability for either, while rare forms of a known stem still weigh by the
stem. A document's evidence is the difference of its two log-likelihoods over its number of words, and that of its distinct words
at least ``STRONG`` nats apart over the root of the number of distinct words (chance adds up as the root); a logistic regression
fitted on labelled rows that were not counted turns both into a score.

A document counts a word once. The highest order's discount is estimated for each class from how many grams were counted once and
twice under it, so a rare expression is smoothed and keeps a share of its count.

Counting covers all labelled training rows but every fifth, which calibrate (at most ``CALIBRATE`` rows, least hash first). The
counts of all grams and contexts stay tables that grow with the corpus, and no worker holds them: texts are read once into chunks of
bounded size, each with a dictionary of its words, and every chunk gets the evidence of its own words back by a join. The distinct
words of all chunks are spelled in the same way: chunks of words with a dictionary of their grams, whose probabilities follow order
by order from joins with the counts.

Defined results: null, empty and wordless texts have no evidence and get the score of none; repeated rows count as often as they
stand; a document with several labels is toxic if one says so; null labels teach nothing; without labels of both classes the score
is the smoothed share of toxic labels; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibrate import fit_logistic
from .common import Batches, crc_mod, cut, discard, lean, small

ORDER, STRONG, CALIBRATE = 6, 4.0, 20_000
DISCOUNT, TOP_DISCOUNT, WORDS = 0.75, 0.75, re.compile(r"\w+")
#: Characters of text in a chunk (a longer text is a chunk of its own).
CHUNK, WORD_CHUNK = 48_000_000, 4_000_000
_START, _END, _NONE = "\x01" * (ORDER - 1), "\x02", 1e-4


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def spell(word: str) -> list[str]:
    """The grams of the highest order, one for each character and one for the end."""
    s = _START + word + _END
    return [s[i : i + ORDER] for i in range(len(word) + 1)]


def _count(batches: Batches, room: int = 200_000) -> Batches:
    """(text, label) to (gram, clean, toxic): grams of the distinct words of many texts at a time."""

    def grams(words: dict) -> pa.RecordBatch:
        total: dict[str, list[int]] = {}
        for word, (clean, toxic) in words.items():
            for gram in spell(word):
                n = total.setdefault(gram, [0, 0])
                n[0] += clean
                n[1] += toxic
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([n[0] for n in total.values()], pa.int64()), pa.array([n[1] for n in total.values()], pa.int64())], ["gram", "clean", "toxic"])

    words: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            for w in set(words_of(text)):
                n = words.get(w)
                if n is None:
                    n = words[w] = [0, 0]
                n[label] += 1
            if len(words) > room:
                yield grams(words)
                words = {}
    if words:
        yield grams(words)


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows that may teach."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    return known.where(crc_mod("doc_id", 5) != 0)


def _fifth() -> Column:
    return F.floor(crc_mod("doc_id", 25) / 5) == 0


def counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """gram, clean, toxic of the labelled rows that do not calibrate."""
    known = known.where(~_fifth())
    rows = docs.select("doc_id", "text").join(small(known, known.count()), "doc_id").select("text", "label")
    counted = rows.mapInArrow(_count, "gram string, clean long, toxic long")
    return cut(counted.groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-grams")


def discounts(grams: DataFrame, columns: list[str]) -> list[float]:
    """By column the discount that the grams counted once and twice give; ``TOP_DISCOUNT`` where either is missing."""
    got = grams.agg(*[F.sum((F.col(c) == k).cast("long")).alias(f"{c}{k}") for c in columns for k in (1, 2)]).first()
    seen = [(got[f"{c}1"] or 0, got[f"{c}2"] or 0) for c in columns]
    return [one / (one + 2 * two) if one and two else TOP_DISCOUNT for one, two in seen]


def _smooth(own: str, total: str, taken: str, discount: float, below: Column) -> Column:
    """The discounted share of a gram in its context, and what was taken shared out by the order below; that alone without the context."""
    n = F.coalesce(total, F.lit(0.0))
    return F.when(n > 0, (F.greatest(F.coalesce(own, F.lit(0)) - discount, F.lit(0.0)) + F.col(taken) * below) / n).otherwise(below)


def _contexts(grams: DataFrame, order: int, columns: dict[str, float]) -> DataFrame:
    """By context the sums of each column and of what its discount takes."""
    sums = [f(c, d) for c, d in columns.items() for f in (lambda c, d: F.sum(F.col(c).cast("double")).alias(f"total_{c}"), lambda c, d: F.sum(F.least(F.col(c), F.lit(d))).alias(f"taken_{c}"))]
    return grams.groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(*sums)


def apart(needed: DataFrame, grams: DataFrame, taken: list[float]) -> DataFrame:
    """Distinct grams of the highest order (word) to word, v: log P(last character | toxic) - log P(... | ordinary)."""
    needed, done = cut(needed.select(F.col("word").alias("gram")), "toxicity-needed"), []
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "toxicity-grams")
    p = None  # of the order below
    for k in range(1, ORDER + 1):
        columns = {"n": DISCOUNT} if k < ORDER else dict(zip(("clean", "toxic"), taken, strict=True))
        rows = needed.select(F.substring("gram", ORDER - k + 1, k).alias("gram")).distinct() if k < ORDER else needed
        rows = rows.select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        rows = rows.join(levels[k], "gram", "left").join(_contexts(levels[k], k, columns), "context", "left")
        if p is None:
            below = F.lit(_NONE)
        else:
            rows, below = rows.join(p.withColumnRenamed("gram", "suffix"), "suffix"), F.col("p")
        each = {c: _smooth(c, f"total_{c}", f"taken_{c}", d, below) for c, d in columns.items()}
        if k < ORDER:
            p = cut(rows.select("gram", each["n"].alias("p")), "toxicity-order")
            done += [levels[k], p]
        else:
            least = lambda c: F.log(F.greatest(each[c], F.lit(1e-30)))
            out = cut(rows.select(F.col("gram").alias("word"), (least("toxic") - least("clean")).alias("v")), "toxicity-order")
    for table in [needed, *done]:
        discard(table)
    return out


_CHUNKS = "words array<string>, ids array<bigint>, sizes binary, which binary, times binary"


def _chunks(batches: Batches, split, room: int) -> Batches:
    """(id, text) to a row a chunk: its distinct words, and for each text how many it has, which (as differences), and how often."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    pack = lambda x: pa.array([squeeze(x.astype(np.int32).tobytes())], pa.binary())

    def chunk() -> pa.RecordBatch:
        n, w, t = (np.frombuffer(x, np.int32) for x in (sizes, which, times))
        of = np.repeat(np.arange(len(n)), n)
        by = np.lexsort((w, of))
        w, t = np.diff(w[by], prepend=0), t[by]
        starts = np.cumsum(n) - n
        w[starts[n > 0]] = np.cumsum(w)[starts[n > 0]]  # each text's first is no difference
        return pa.RecordBatch.from_arrays([pa.array([list(index)], pa.list_(pa.string())), pa.array([ids], pa.list_(pa.int64())), pack(n), pack(w), pack(t)], ["words", "ids", "sizes", "which", "times"])

    fresh = lambda: ({}, [], array("i"), array("i"), array("i"), 0)
    index, ids, sizes, which, times, held = fresh()
    for batch in batches:
        for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = Counter(split(text))
            ids.append(i)
            sizes.append(len(words))
            which.extend([index.setdefault(w, len(index)) for w in words])
            times.extend(words.values())
            held += len(text or "") + 8
            if held > room:
                yield chunk()
                index, ids, sizes, which, times, held = fresh()
    if ids:
        yield chunk()


def _weighed(batches: Batches) -> Batches:
    """Chunks with the weights of their words in place of the words to (id, v, n, strong, distinct)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for ids, at, values, *blobs in zip(*[batch[c] for c in ("ids", "i", "v", "sizes", "which", "times")], strict=True):
            sizes, which, times = (np.frombuffer(unpack(b.as_py()), np.int32) for b in blobs)
            of, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            run = np.concatenate(([0], np.cumsum(which, dtype=np.int64)))
            known = np.zeros(len(at.values) if at.is_valid else 0)
            if at.is_valid:
                known[np.asarray(at.values)] = np.asarray(values.values)
            weights = known[run[1:] - run[starts][of]]
            total = lambda x: pa.array(np.bincount(of, x, minlength=len(sizes)).astype(np.float64))  # noqa: E731, B023
            columns = [ids.values, total(weights * times), total(times), total(np.where(weights > STRONG, weights, 0.0)), pa.array(sizes.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "n", "strong", "distinct"])


def weigh(rows: DataFrame, split, room: int, weights) -> DataFrame:
    """(id, text) to id and of its words by ``split``: v (sum of weights), n (words), strong (sum of the distinct strong ones), distinct.

    ``weights`` makes of all distinct words (word) their weights (word, v).
    """
    chunks = rows.select("id", "text").mapInArrow(partial(_chunks, split=split, room=room), _CHUNKS)
    chunks = cut(chunks.withColumn("chunk", F.monotonically_increasing_id()), "toxicity-chunks")  # numbered once
    met = chunks.select("chunk", F.posexplode("words").alias("i", "word"))
    known = weights(met.select("word").distinct())
    # Every word of a chunk has a weight; both lists are gathered row by row, so they have one order.
    back = met.join(known, "word").groupBy("chunk").agg(F.collect_list("i").alias("i"), F.collect_list(F.col("v").cast("float")).alias("v"))
    whole = chunks.drop("words").join(back, "chunk", "left")
    out = cut(whole.drop("chunk").mapInArrow(_weighed, "id long, v double, n double, strong double, distinct long"), "toxicity-weighed")
    for done in (chunks, known):
        discard(done)
    return out


def word_evidence(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Distinct words (word) to word, v: log P(word | toxic) - log P(word | ordinary)."""
    words = cut(words.withColumn("id", F.monotonically_increasing_id()), "toxicity-words")  # numbered once
    taken = discounts(grams, ["clean", "toxic"])
    found = weigh(words.select("id", F.col("word").alias("text")), spell, WORD_CHUNK, lambda needed: apart(needed, grams, taken))
    out = cut(words.join(found, "id").select("word", "v"), "toxicity-weights")
    for done in (words, found):
        discard(done)
    return out


def evidence(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, a (mean difference a word), b (differences of the distinct strong words over the root of their number) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = weigh(rows, words_of, CHUNK, lambda words: word_evidence(words, grams))
    least = lambda c: F.greatest(c, F.lit(1))
    return found.select(F.col("id").alias("doc_id"), (F.col("v") / least("n")).alias("a"), (F.col("strong") / F.sqrt(least("distinct"))).alias("b"))


def calibrate(found: DataFrame, known: DataFrame) -> np.ndarray:
    """Weights of the two kinds of evidence, from at most ``CALIBRATE`` rows that were not counted."""
    chosen = known.where(_fifth()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATE)
    seen = found.join(F.broadcast(chosen), "doc_id").select("label", *_scaled()).toPandas()
    return fit_logistic(seen[["a", "b"]].to_numpy(float), seen["label"].to_numpy(float))


def _scaled() -> list[Column]:
    return [(F.col("a") * 10).alias("a"), F.log1p("b").alias("b")]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    lean(docs.sparkSession)
    known = cut(known_labels(labels), "toxicity-labels")
    found = evidence(docs, counts(docs, known))
    bias, *weights = calibrate(found, known).tolist()
    z = F.lit(bias)
    for c, w in zip(_scaled(), weights, strict=True):
        z = z + c * w
    z = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    out = found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), z.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
