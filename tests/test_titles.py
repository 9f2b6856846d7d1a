"""The title merge against the same rule applied row by row, however rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from agendula.operators import titles

ROWS = "fingerprint string, seq long, title string"
POOL = ["Big night", "BIG NIGHT", "Big night (Free)", "Big  night", "BIG  NIGHT", "BIG NIGHT (FREE)", "BIG  NIGHT (FREE)", "Cancelled: big night", "CANCELLED BIG NIGHT", "Cancelled  night (free)", "(ANNULÉE) BIG  NIGHT (FREE)", "Annulé: soirée"]


def _model(rows, classes):
    kept = {}
    for f, _, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[1])):
        (off, bad), held = classes[t], kept.get(f)
        if held is None or (off and not classes[held][0]) or bad < classes[held][1]:
            kept[f] = t
    return kept


def _classes(spark, names):
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", titles.title_class(F.col("t")).alias("c")).collect()
    return {r.t: (r.c >= 8, r.c % 8) for r in got}


def test_every_class_is_told(spark):
    assert len(set(_classes(spark, POOL).values())) >= 10


@pytest.mark.parametrize(("run", "runs"), [(12, 24), (2, 4), (0, 1), (1, 3)])
def test_equal_to_the_rule_in_turn(spark, run, runs):
    r = random.Random(run)
    rows = [(f"f{r.randrange(40)}", i, r.choice([*POOL, None])) for i in range(3000)] + [("one", 5, "BIG NIGHT"), ("none", 1, None)]
    r.shuffle(rows)
    got = {x.fingerprint: x.title for x in titles.kept_titles(spark.createDataFrame(rows, ROWS).repartition(7), run, runs).collect()}
    assert got == _model(rows, _classes(spark, POOL))
    assert titles.kept_titles(spark.createDataFrame([], ROWS)).collect() == []


def test_a_hot_event_of_a_million_rows(spark):
    n = 1_000_000
    pool = F.array(*map(F.lit, POOL))
    rows = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 1000)).alias("fingerprint"), F.col("id").alias("seq"), F.get(pool, F.pmod(F.xxhash64("id"), F.lit(len(POOL))).cast("int")).alias("title"))
    got = {x.fingerprint: x.title for x in titles.kept_titles(rows).collect()}
    assert got == _model([tuple(x) for x in rows.collect()], _classes(spark, POOL))
    # The hot event's rows are dealt over tasks by their order, none of which holds most of them.
    plan = titles.kept_titles(rows)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(fingerprint" in plan and "Window" not in plan
