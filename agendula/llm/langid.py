"""Language identification as inference of a mixture of languages.

Each language is a model of character trigrams (lower case, runs of other characters as one space), smoothed over 2^BITS
buckets. A document's proportions of languages come from expectation-maximisation over its distinct trigrams: a trigram is
shared out by proportion times likelihood, and the shares make the next proportions. Which languages take part is decided by
penalised likelihood: starting from the best single one, the language whose addition raises the likelihood most is added while
the rise exceeds ``PENALTY`` nats a language and trigram-count logarithm (a Bayesian criterion, scaled as overlapping trigrams are not
independent).

Counts cover all training rows; the tables that reach the driver have languages times 2^BITS cells at most.

Defined results: null texts and texts without a letter are ``und`` with score 0; any other text gets a learned language (the
least by name among equals) with its proportion as score; without any learned language every text is ``und``; repeated rows
count as often as they stand; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, crc_mod, lean

BITS, PENALTY, STEPS, TOLERANCE = 16, 3.0, 30, 1e-4


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """Buckets of the text's trigrams in order; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.uint64)
    h = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77C2B2) + codes[2:] * np.uint64(0x27D4EB2F165667)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Batches) -> Batches:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            g = grams(text)
            if len(g):
                if lang not in totals:
                    totals[lang] = np.zeros(1 << BITS, np.int64)
                totals[lang] += np.bincount(g, minlength=1 << BITS)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        n = counts + 0.5
        self.log = np.log(n / n.sum(axis=0)).astype(np.float32) if langs else counts
        # What a trigram of a text in the language has on average, by all its labelled texts.
        self.mean = (n / n.sum(axis=0) * self.log).sum(axis=0) if langs else np.empty(0)

    def _mix(self, p: np.ndarray, n: np.ndarray, of: list[int], shift: float) -> tuple[np.ndarray, float]:
        """Proportions of the languages ``of`` and the log-likelihood."""
        p, total = np.ascontiguousarray(p[:, of]), n.sum()
        share = np.full(len(of), 1 / len(of))
        for _ in range(STEPS):
            joint = p @ share
            new = share * ((n / joint) @ p) / total
            done = np.abs(new - share).max() < TOLERANCE
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share)) + shift

    def infer(self, text: str | None) -> dict[str, float]:
        """Proportion of each language of the chosen set."""
        return self.explain(text)[0]

    def explain(self, text: str | None) -> tuple[dict[str, float], float]:
        """Proportion of each language of the chosen set, and how well the mixture explains the text.

        That is the mean log-likelihood of a trigram on a scale where 0 is the background, under which every bucket is as likely,
        and 1 is what labelled texts of these languages have on average.
        """
        g = grams(text)
        if not len(g) or not self.langs:
            return {}, 0.0
        u, n = np.unique(g, return_counts=True)
        log = self.log[u].astype(np.float64)
        n = n.astype(np.float64)
        top = log.max(axis=1)
        p, shift = np.exp(log - top[:, None]), float(n @ top)
        alone = n @ log
        chosen = [int(np.argmax(alone))]
        share, best = np.ones(1), float(alone[chosen[0]])
        cost = PENALTY * np.log(n.sum() + 1)
        # No mixture is likelier than one that explains every trigram by its best language.
        while len(chosen) < len(self.langs) and shift - best > cost:
            tried = [(*self._mix(p, n, [*chosen, i], shift), i) for i in range(len(self.langs)) if i not in chosen]
            more, value, i = max(tried, key=lambda t: (t[1], -t[2]))
            if value - best <= cost:
                break
            chosen, share, best = [*chosen, i], more, value
        background = -BITS * np.log(2)
        usual = max(float(share @ self.mean[chosen]) - background, 1e-9)
        return {self.langs[i]: float(s) for i, s in zip(chosen, share, strict=True)}, (best / float(n.sum()) - background) / usual


def train(docs: DataFrame, held_out: bool = True):
    """Broadcast model of the rows' languages; with ``held_out`` the rows that the contract holds out are left out."""
    lean(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null")
    if held_out:
        rows = rows.where(crc_mod("doc_id", 4) != 2)
    counted = rows.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(got["lang"]))
    counts = np.zeros((1 << BITS, len(langs)))
    counts[got["bucket"], [langs.index(x) for x in got["lang"]]] = got["n"]
    return docs.sparkSession.sparkContext.broadcast(Model(langs, counts))


def _predict(batches: Batches, model) -> Batches:
    model = model.value
    for batch in batches:
        langs, scores = [], []
        for text in batch["text"].to_pylist():
            share = model.infer(text)
            lang = min(share, key=lambda x: (-share[x], x)) if share else "und"
            langs.append(lang)
            scores.append(min(1.0, share.get(lang, 0.0)))
        rest = batch.drop_columns(["text"])
        yield rest.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs.select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(batches: Batches, model, least: float, fit: float) -> Batches:
    model = model.value
    for batch in batches:
        found = [model.explain(t) for t in batch["text"].to_pylist()]
        yield batch.filter(pa.array([max(share.values(), default=0.0) >= least and fits >= fit for share, fits in found], pa.bool_()))


def keep_identified(docs: DataFrame, least: float = 0.2, fit: float = 0.5) -> DataFrame:
    """``docs`` without rows in no learned language: null texts, texts without a letter, texts that the chosen languages explain
    less than ``fit`` as well as their labelled texts (a language that was not learned, or noise), or none with ``least``
    of the document."""
    return docs.mapInArrow(partial(_keep, model=train(docs), least=least, fit=fit), docs.schema)
