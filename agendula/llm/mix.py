"""Mixing sources to target weights, with DataFrame functions only.

Sizes (words) are summed by source; a source's target is its weight's share of the budget, held at ``cap`` times its size, the
excess going to the others by weight until none is above. That fixpoint is found in one pass: with sources ordered by the
level at which they reach their cap, the common level of those below it follows from running sums. Each document is then
taken floor(rate) times, plus once more if a draw seeded by its id falls below the fraction.

Bernoulli draws of a small source miss its target by their own noise, so ``seeds`` draws are derived from each id's hash and
every source uses the seed whose total comes nearest its target: one aggregation, no second pass over texts.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id draws as the text
'null'; repeated rows draw alike; a source of size 0 has target 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
_MOD = 1 << 48


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source, so the unpartitioned windows are small."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    full = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", weight)
    s = s.withColumn("all_size", F.sum("source_size").over(full))
    s = s.withColumn("held", F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("all_size") * F.lit(share) - F.col("held") * F.lit(cap)) / F.col("open_w")
    s = s.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("source_size") * F.lit(cap))
    s = s.withColumn("final", F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("w")).alias("a"), F.col("source").isNull().alias("b"), "source", "level"))).over(full)["level"])
    target = F.coalesce(F.least(F.col("source_size") * F.lit(cap), F.col("final") * F.col("w")), F.col("source_size") * F.lit(cap))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _draw(a, b, j):
    """A number from 0 to 2^48 - 1 for seed ``j``."""
    return (a + b * j) % F.lit(_MOD)


def _hashed(rows: DataFrame) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    part = lambda a: F.conv(F.substring(digest, a, 12), 16, 10).cast("long")
    return rows.withColumns({"__a": part(1), "__b": part(13)})


def decide(rows: DataFrame, seeds: int = 32) -> DataFrame:
    """Rows (doc_id, source, size) to one row a source: __source, source_size, target, __base, __frac, __j (its seed).

    The tables of sources are written and counted, and broadcast only within the size bound.
    """
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumnRenamed("source", "__source").withColumn("__base", F.floor(rate)).withColumn("__frac", (rate - F.col("__base")) * F.lit(float(_MOD)))
    goal = cut(goal, "mix-goal")
    both = _hashed(rows).join(small(goal, goal.count()), F.col("source").eqNullSafe(F.col("__source")))
    drawn = [F.sum(F.when(_draw(F.col("__a"), F.col("__b"), j) < F.col("__frac"), F.col("size")).otherwise(F.lit(0))).alias(f"s{j}") for j in range(seeds)]
    totals = both.groupBy("__source").agg(*drawn, F.sum(F.col("size") * F.col("__base")).alias("sure"), F.max("target").alias("t"))
    near = F.array(*[F.struct(F.abs(F.col("sure") + F.col(f"s{j}") - F.col("t")).alias("off"), F.lit(j).alias("j")) for j in range(seeds)])
    chosen = totals.select(F.col("__source").alias("__s"), F.array_min(near)["j"].alias("__j"))
    return cut(goal.join(chosen, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s"), "mix-plan")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size and any others) with source_size, target and copies (long)."""
    out = _hashed(rows).join(small(plan, plan.count()), F.col("source").eqNullSafe(F.col("__source")))
    once_more = (_draw(F.col("__a"), F.col("__b"), F.col("__j")) < F.col("__frac")).cast("long")
    return out.withColumn("copies", F.col("__base") + once_more).drop("__a", "__b", "__j", "__base", "__frac", "__source")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def mix_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = cut(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-rows")
    out = take(rows, decide(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    rows = cut(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-rows")
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = sized(docs.select("doc_id", "source", "text", body.alias("__row"))).select("doc_id", "source", "size", "__row")
    copies = take(packed, decide(rows)).where("copies > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
