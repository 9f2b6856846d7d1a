"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups are the rows with equal texts. Groups by falling size go to the least-loaded shard through a heap. Groups of one size are
alike to the schedule, so the driver reads only how many there are of each size, as a stream: it holds the heap, one partition of sizes and one
chunk of the schedule, which it writes as a table. A long run of equal sizes is poured over the shards at once, to the loads that the heap
would reach one by one. Which group of a size goes where follows from its rank among them by digest; ranks and slots are numbered by ranges,
without a global window, and do not depend on the number of ranges.

Defined results: a null text weighs 1 and groups with the empty text; repeated rows and ties share their group's shard; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import cut, scratch, small


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, number of groups), largest first, to how many of each size every shard takes: each to the least-loaded shard (ties: the lowest)."""
    heap = [(0, k) for k in range(shards)]
    for size, count in sizes:
        took = [0] * shards
        if count > 4 * shards:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            # Below the level t the heap hands a shard a group as long as its load is lower.
            given = lambda t: [max(0, -(-(t - load) // size)) for load in loads]  # noqa: E731, B023
            low, high = min(loads), max(loads) + size * count
            while low < high:
                t = (low + high + 1) // 2
                low, high = (t, high) if sum(given(t)) <= count else (low, t - 1)
            took = given(low)
            heap = [(load + n * size, k) for k, (load, n) in enumerate(zip(loads, took, strict=True))]
            heapq.heapify(heap)
        for _ in range(count - sum(took)):
            load, k = heap[0]
            took[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        yield size, took


def lpt(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """:func:`schedule` of sizes in any order."""
    return dict(schedule(sorted(sizes, reverse=True), shards))


def _scheduled(groups: DataFrame, shards: int, chunk: int) -> tuple[DataFrame, int]:
    """__size and __ends (how many groups of that size the shards up to each take), written ``chunk`` rows at a time; and the number of rows."""
    spark, path, schema, n = groups.sparkSession, scratch(groups.sparkSession, "shard-schedule"), "__size long, __ends array<bigint>", 0
    counts = groups.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("__size"))
    plan = ((size, list(accumulate(took))) for size, took in schedule(((r["__size"], r["n"]) for r in counts.toLocalIterator()), shards))
    while rows := list(islice(plan, chunk)):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        n += len(rows)
    return spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema), n


def assign(rows: DataFrame, key: str, size: str, shards: int = 16, chunk: int = 100_000) -> DataFrame:
    """``rows`` plus ``shard`` (int). ``key``: a non-null column that names the group. ``size``: a long column of 1 or more."""
    groups = cut(rows.groupBy(key).agg(F.sum(size).alias("__size")), "shard-groups")
    ends, n = _scheduled(groups, shards, chunk)
    placed = slots(groups.withColumn("__row", F.lit(0)), "__size", F.col(key)).join(small(ends, n), "__size")
    placed = cut(placed.select(key, F.size(F.filter("__ends", lambda e: e <= F.col("slot"))).alias("shard")), "shard-placed")
    return rows.join(placed, key)


def slots(rows: DataFrame, shard: str, order: Column, per_cell: int = 20_000) -> DataFrame:
    """``rows`` plus ``slot``: numbers from 0 without gaps within each shard by ``order`` (ties: ``__row``), in ranges of about ``per_cell`` rows, so no task holds a shard."""
    cells = max(1, -(-rows.count() // per_cell))
    out = numbered(rows.withColumn("__order", order), [shard], ["__order", "__row"], "slot", cells)
    return out.withColumn("slot", (F.col("slot") - 1).cast("long")).drop("__order")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row: equal texts together, shards' bytes near equal."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key"))
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    return slots(cut(assign(rows, "key", "size", shards).drop("key"), "shard-assigned"), "shard", F.col("doc_id")).drop("__row")
