"""Places that texts name, from a table of any size.

A text's runs of words are joined with the names; of those a text holds, the name of most words counts, the first among equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Names beyond this number are not broadcast.
MOST_NAMES = 100_000


def runs(words: Column, most: int) -> Column:
    """All runs of up to ``most`` words, as structs (run, words, at)."""

    def from_place(i: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1))
        return F.transform(sizes, lambda n: F.struct(F.array_join(F.slice(words, i, n), "-").alias("run"), n.alias("words"), i.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), from_place))


def named_places(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` (with a unique ``id`` and ``text``) with ``place``: that of the longest of the ``names`` (name, place) in the text as whole words.

    Names and texts compare as slugs. Of places with one name the first by name counts; without a name in the text, ``place`` is null.
    """
    n = names.select(T.slugify(F.col("name")).alias("run"), "place").where("run <> '' and place is not null").groupBy("run").agg(F.min("place").alias("place"))
    most = n.agg(F.max(F.size(F.split("run", "-")))).first()[0] or 1
    small = F.broadcast(n) if n.limit(MOST_NAMES + 1).count() <= MOST_NAMES else n
    each = texts.select("id", F.explode(runs(F.split(T.slugify(F.col("text")), "-"), most)).alias("r")).select("id", "r.*")
    found = each.join(small, "run").groupBy("id").agg(F.min_by("place", F.struct(-F.col("words"), "at")).alias("place"))
    return texts.join(found, "id", "left")
