"""Numbers by a total order and blocks of nights against the plain loops, however rows are dealt; plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agendula.operators import ranking, sequences


def test_numbers(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot"] * 5 + ["a", "b", None]), r.choice([None, 1, 2, 3]), r.randrange(9)) for i in range(2000)]
    d = spark.createDataFrame(rows, "id long, k string, x int, y int").repartition(6)
    key = lambda v: (v is not None, v)
    for by in ([], ["k"]):
        want, seen = {}, {}
        for i, k, _, _ in sorted(rows, key=lambda t: (key(t[2]), key(t[3]), t[0])):
            seen[k if by else 0] = want[i] = seen.get(k if by else 0, 0) + 1
        out = ranking.numbered(d, by, ["x", "y", "id"])
        assert {q.id: q.position for q in out.collect()} == want
    assert ranking.numbered(d.limit(0), [], ["id"]).count() == 0


def test_no_task_sees_all_rows(spark):
    d = spark.range(5000).select(F.lit("hot").alias("k"), "id")
    out = ranking.numbered(d, ["k"], ["id"])
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in sizes) == 5000 and out.agg(F.max("position")).first()[0] == 5000
    plan = ranking.numbered(d, [], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of the counts of ranges


def _fold(rows):
    """(id, block) one row after the other."""
    out, n, reach, urls = {}, 0, None, set()
    for i, start, end, url in sorted(rows, key=lambda t: (t[1], t[2] or t[1], t[0])):
        last = end or start
        if n and (start - reach).days <= 1 and (url is None or url in urls):
            reach = max(reach, last)
        else:
            n, reach, urls = n + 1, last, set() if url is None else {url}
        out[i] = n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_the_fold(spark, seed):
    r, groups = random.Random(seed), {}
    for g in range(60):
        day, rows = dt.date(2026, 1, 1), []
        for i in range(r.randrange(1, 25)):
            day += dt.timedelta(r.choice([0, 0, 1, 1, 1, 2, 3]))
            rows.append((f"{g}-{i:03d}", day, r.choice([None, None, day + dt.timedelta(r.randrange(1, 6))]), r.choice([None, None, "u", "u", "v"])))
        groups[g] = rows
    flat = [(g, *row) for g, rows in groups.items() for row in rows]
    r.shuffle(flat)
    d = spark.createDataFrame(flat, "g int, fingerprint string, start date, end date, url string")
    out = sequences.consecutive_blocks(d, ["g"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {}
    for x in out.collect():
        got.setdefault((x.g, tuple(x.block)), set()).add(x.fingerprint)
    want = {}
    for g, rows in groups.items():
        for i, n in _fold(rows).items():
            want.setdefault((g, n), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
