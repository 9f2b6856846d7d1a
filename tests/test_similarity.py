"""Title similarity and rules by index against comparisons of all pairs; how many pairs the indexes bring together; plans."""

import datetime as dt
import random

from pyspark.sql import functions as F

from agendula.operators import rules
from agendula.operators import similarity as S

ROWS = "id long, text string, g string"
WORDS = "art arts party bal balade jazz nuit de la grand concert piano new orchestra x 9 2026 festival mer soleil theatre salle ouverte jardin lune".split()


def _rows(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 7))), r.choice("ab")) for i in range(n)]


def _like(a, b):
    x, y = set(a.split()), set(b.split())
    return 0 if not a or not b else 1 if a in b or b in a else len(x & y) / len(x | y)


def test_equal_to_all_pairs(spark):
    a, b = _rows(200, 1), _rows(220, 2)
    for least in (0.5, 0.6, 1.0):
        x, y = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
        got = sorted((r.a.id, r.b.id, round(r.likeness, 9)) for r in S.similar(x, y, ["g"], least).collect())
        assert got == sorted((i, j, round(_like(t, u), 9)) for i, t, g in a for j, u, h in b if g == h and _like(t, u) >= least)
        one = sorted((r.a.id, r.b.id) for r in S.similar(x, x, ["g"], least).collect())
        assert one == sorted((i, j) for i, t, g in a for j, u, h in a if i < j and g == h and _like(t, u) >= least)


def test_few_candidates(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(800)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(6)), "g") for i in range(600)]
    rows += [(600 + i, rows[i][1] + " " + r.choice(vocabulary), "g") for i in range(60)]
    d = spark.createDataFrame(rows, ROWS)
    tried = S.candidates(d, d, ["g"], 0.6).select("a.id", F.col("b.id").alias("other")).distinct().count()
    assert tried < 0.05 * len(rows) * (len(rows) - 1) / 2
    assert S.similar(d, d, ["g"], 0.6).count() >= 60


def test_no_texts(spark):
    d = spark.createDataFrame([(1, "", "g"), (2, "", "g")], ROWS)
    assert S.similar(d, d, ["g"], 0.5).count() == 0 and S.similar(d.limit(0), d, ["g"], 0.5).count() == 0


EVENTS = "title string, url string, town string, start date"
RULES = "url string, needle string, town string, date date"


def _fold(s):
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())


def test_rules_equal_all_pairs(spark):
    r, day = random.Random(3), lambda k: dt.date(2026, 7, 1 + k)
    some = lambda x: r.choice([None, x])
    events = [(" ".join(r.choice(WORDS) for _ in range(4)).title(), some(f"u{r.randrange(30)}"), some(r.choice("NC")), day(r.randrange(6))) for _ in range(300)] + [("", None, "N", None)]
    for seed in range(4):
        r.seed(seed)
        named = [(some(f"u{r.randrange(30)}"), r.choice([None, r.choice(WORDS), "rt", "a p", "9", "z"]), some(r.choice("NC")), r.choice([None, None, day(r.randrange(6))])) for _ in range(3)]
        ok = lambda e, q: any(v is not None for v in q) and all(v is None or w for v, w in ((q[0], e[1] == q[0]), (q[1], q[1] is not None and _fold(q[1]) in _fold(e[0])), (q[2], e[2] == q[2]), (q[3], e[3] == q[3])))
        got = rules.suppress(spark.createDataFrame(events, EVENTS), spark.createDataFrame(named, RULES)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str(e) for e in events if not any(ok(e, q) for q in named))


def test_many_rules_need_no_nested_loop(spark):
    events = spark.createDataFrame([("Grand bal numero 77", "u1", "N", dt.date(2026, 7, 1)), ("Concert", "u2", "N", dt.date(2026, 7, 1)), ("Rien", "u3", "C", dt.date(2026, 7, 2))], EVENTS)
    many = spark.range(20_000).select(F.when(F.col("id") == 5, "u2").alias("url"), F.when(F.col("id") % 2 == 1, F.lit(None)).otherwise(F.concat(F.lit("numero "), F.col("id").cast("string"))).alias("needle"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("town"), F.lit(None).cast("date").alias("date"))
    many = many.unionByName(spark.createDataFrame([("u2", None, None, None), (None, "numero 77", None, None)], RULES))
    out = rules.suppress(events, many)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.title for r in out.collect()] == ["Rien"]
