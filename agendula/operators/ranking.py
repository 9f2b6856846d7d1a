"""Numbers by a total order, without one task that sees all rows or all rows of a key.

Rows are dealt by ranges of (key, order) and sorted there, and keep their places; a key's numbers in a range begin after those of the ranges
before, of which only the counts are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each ``by`` (of all rows, if that is empty), by ``order``, nulls first. ``ranges``: how many, if not the session's."""
    keys = [*by, *order]
    placed = cut(rows.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    # The upper bits of a place are its partition.
    placed = placed.withColumn("__range", F.shiftright("__place", 33))
    counts = placed.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__from"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "__from", "__before")
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = placed.join(starts, same)
    return out.withColumn(name, F.col("__before") + F.col("__place") - F.col("__from") + 1).select(*rows.columns, name)
