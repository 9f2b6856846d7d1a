"""Which of many short texts resemble or contain one another, without comparing all pairs.

Texts are folded (words of a-z and 0-9, one space between). Two ways lead to a pair, both equi-joins, and every pair they find is compared
whole. Words in order of rarity: texts with a Jaccard similarity of ``least`` share one of their first ``n - ceil(least * n) + 1`` words.
Containment: what is contained brings one gram of its rarest long word, whatever contains it has that gram among its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of a gram; shorter words are grams as they are.
GRAM = 4


def grams(text: Column, most: int = GRAM) -> Column:
    """All runs of up to ``most`` characters, and the empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.transform(starts, lambda i: F.substring(text, i, k)))))


def own_gram(words: Column, most: int = GRAM) -> Column:
    """The gram that stands for a text whose words come in order of rarity: of its first word that is long enough, else of its longest."""
    long = F.filter(words, lambda w: F.length(w) >= most)
    longest = F.element_at(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w), w.alias("w")))), -1)["w"]
    return F.substring(F.when(F.size(long) > 0, F.get(long, F.lit(0))).otherwise(longest), 1, most)


def likeness(a: Column, b: Column, a_words: Column, b_words: Column, held: bool = True) -> Column:
    """1 where one text holds the other (``held``), else the Jaccard similarity of their words; 0 if one is empty."""
    shared = F.size(F.array_intersect(a_words, b_words))
    share = shared / (F.size(a_words) + F.size(b_words) - shared)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(F.lit(held) & (a.contains(b) | b.contains(a)), F.lit(1.0)).otherwise(share)


def by_rarity(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (with a unique ``id``) with ``words``: a text's distinct words, those in the fewest rows first."""
    each = rows.select("id", F.explode(F.array_distinct(F.split(text, " "))).alias("word"))
    held = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    words = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word")))["word"].alias("words"))
    return rows.join(words, "id")


def _sides(rows: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By prefix words, by the own gram, by all grams."""
    kept = F.struct(*rows.columns)
    return tuple(rows.where("text <> ''").select(*on, key, kept.alias("row")) for key in (F.explode("prefix").alias("__key"), F.col("gram").alias("__key"), F.explode(grams(F.col("text"))).alias("__key")))


def candidates(a: DataFrame, b: DataFrame, on: list[str], least: float, held: bool = True) -> DataFrame:
    """(a, b): pairs of rows (id, text and ``on``, which are equal) that one of the indexes brings together, each once: by the first of their
    prefix words that they share, or if they share none, because one text holds the other (``held``).
    """
    if a.columns != b.columns:
        raise ValueError("both sides need the same columns")
    same = a is b
    both = a.select(F.struct(F.lit(0).alias("side"), F.col("id").cast("string").alias("id")).alias("id"), "text")
    if not same:
        both = both.unionByName(b.select(F.struct(F.lit(1).alias("side"), F.col("id").cast("string").alias("id")).alias("id"), "text"))
    n = F.size("words")
    ranked = by_rarity(both).select("id", "words", own_gram(F.col("words")).alias("gram"), F.slice("words", F.lit(1), n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1).alias("prefix"))

    def side(rows: DataFrame, k: int) -> tuple:
        own = ranked.where(F.col("id.side") == k).select(F.col("id.id").alias("__id"), "words", "gram", "prefix")
        return _sides(rows.join(own, F.col("id").cast("string") == F.col("__id")).drop("__id"), on)

    left = side(a, 0)
    right = left if same else side(b, 1)
    shared = F.array_intersect("a.prefix", "b.prefix")
    ways = [(0, 0, F.get(shared, F.lit(0)) == F.col("__key")), (1, 2, F.col("b.text").contains(F.col("a.text")) & (F.size(shared) == 0)), (2, 1, F.col("a.text").contains(F.col("b.text")) & (F.size(shared) == 0))]
    order = F.col("a.id") < F.col("b.id") if same else F.lit(True)
    met = [left[i].withColumnRenamed("row", "a").join(right[j].withColumnRenamed("row", "b"), [*on, "__key"]).where(order & new).select("a", "b") for i, j, new in (ways if held else ways[:1])]
    return reduce(DataFrame.unionByName, met)


def similar(a: DataFrame, b: DataFrame, on: list[str], least: float, also: Column | None = None, held: bool = True) -> DataFrame:
    """(a, b, likeness): pairs of rows with equal ``on`` whose texts resemble by ``least`` or more, each once.

    ``a`` and ``b`` have a unique ``id``, a folded ``text``, ``on`` and any other columns. One table as both (the same object): pairs of its
    rows, the smaller id first. ``also``: a further condition on ``a`` and ``b``. ``held``: a text that holds the other resembles it by 1; else
    words alone count.
    """
    met = candidates(a, b, on, least, held)
    met = met.where(also) if also is not None else met
    return met.withColumn("likeness", likeness(F.col("a.text"), F.col("b.text"), F.col("a.words"), F.col("b.words"), held)).where(F.col("likeness") >= least)


def folded(c: Column) -> Column:
    return T.fold(c, flatten=True)
