"""Results of the round's findings: row limits, references and times as their SQL states them, and costs that the plans show."""

import datetime as dt
import gc
import json
import re

import pyarrow as pa
from pyspark.sql import functions as F

from agendula.functions import fixed as X
from agendula.functions import text as T
from agendula.operators import recur
from agendula.operators import similarity as S
from agendula.plans import listing as L
from agendula.plans import queries as Q
from agendula.plans.quality import stale_feed
from agendula.sources import jsonld, landed

from .oracle import differences


def test_a_walk_of_many_objects(spark):
    rows = spark.range(30).select("id", F.lit(json.dumps({"a": [{"b": {"c": {}}}], "t": "{x"})).alias("json"))
    old = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = jsonld.objects(rows).groupBy("path").count().collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)
    assert sorted(r["count"] for r in got) == [30] * 4


def test_text_of_pages_with_references_cut_short(spark, tmp_path):
    html = "<p>a &amp; b</p><noscript><style>x</noscript></style>&copy &am</p>&amp"
    spark.createDataFrame([(1, html), (2, "<template><script></template></script>x\x0by&quot;")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (tmp_path / "all").mkdir()
    import duckdb

    duckdb.sql(f"copy (select * from '{tmp_path}/pages.parquet/*.parquet') to '{tmp_path}/all/pages.parquet'")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/all/pages.parquet'")
    assert differences(spark, Q.QUERIES["html_text"], Q.SQL["html_text"], f"{tmp_path}/all", c) == []


def test_words_alone_can_count(spark):
    t = spark.createDataFrame([(1, "old ring small"), (2, "cold ring small"), (3, "old rod large"), (4, "cold rod promo")], "id long, text string").withColumn("on", F.lit(1))
    got = {(r[0], r[1]): r[2] for r in S.similar(t, t, ["on"], 0.5, held=False).select("a.id", "b.id", "likeness").collect()}
    assert got == {(1, 2): 0.5}


def test_a_feed_is_stale_by_less_than_a_second(spark):
    now = dt.datetime(2024, 1, 20, 12)
    rows = spark.createDataFrame([(n, now - dt.timedelta(hours=48, microseconds=n)) for n in (-1, 0, 1, 999_999)], "n long, t timestamp_ntz")
    got = {r["n"]: r["s"] for r in rows.select("n", stale_feed(F.col("t"), F.lit(now).cast("timestamp_ntz")).alias("s")).collect()}
    assert got == {-1: False, 0: False, 1: True, 999_999: True}


def test_copies_of_titles_are_compared_once(spark, monkeypatch):
    day = lambda n: dt.date(2026, 1, 20) + dt.timedelta(n)
    sent = spark.createDataFrame([(i, "Jazz Night", "Nice", day(i)) for i in range(20)], "id long, title string, town string, start date")
    events = spark.createDataFrame([(100 + i, "jazz night at the harbour", "NICE", day(i), day(i + n)) for i, n in enumerate((0, 3, 45, -1))] + [(200, "jazz night", "Nice", day(5), None)], "fingerprint long, title string, town string, start date, end date")
    seen, similar = [], L.S.similar
    monkeypatch.setattr(L.S, "similar", lambda a, b, *more: seen.append((a.count(), b.count())) or similar(a, b, *more))
    got = {tuple(r) for r in L.find_duplicates(sent, events).collect()}
    assert got == {(0, 100)} | {(i, 101) for i in range(1, 5)} | {(i, 102) for i in range(2, 20)} | {(5, 200)}
    assert seen == [(2, 4)]


def test_a_pattern_runs_only_where_its_stem_stands(spark):
    for pattern, _ in X.CATEGORY_PATTERNS:
        assert "|".join(T._alternatives(pattern)) == pattern
        assert all(T._stem(a) in re.sub(r"\\b|[\[(].*?[\])]|\?", "", a) for a in T._alternatives(pattern))
    assert [T._stem(a) for a in (r"\bexpo\b", "soirees? latin", r"after[\s-]?party", "guided (tour|visit)", "self.?defense")] == ["expo", "soiree", "after", "guided ", "defense"]
    texts = ["un expo.", "exposant", "soirée latine", "les soirées latino", "bal", "balle", "visite", "guided tour", "self-defense", "ai", "j'ai", "tango", "xtango", None]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.classify(F.col("t")).alias("c")).collect()]
    assert got == ["expo", "autre", "danse", "danse", "danse", "autre", "visite", "visite", "sport", "business", "business", "danse", "autre", "autre"]


def test_marks_and_letters_of_several(spark):
    texts = ["\u00c9t\u00e9 \u00bd \ufb01n", "\ud55c\uad6d caf\u00e9", "\u00df\u0153", "plain", "AUX ARMES citoyens", "\u00c9COLE NR"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip_accents(F.col("t")), T.nfkc(F.col("t")), T.unshout_words(F.col("t"))).collect()]
    import unicodedata

    assert [g[0] for g in got] == ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert [g[1] for g in got] == [unicodedata.normalize("NFKC", t) for t in texts]
    assert [g[2] for g in got[4:]] == ["Aux Armes citoyens", "\u00c9cole NR"]


def test_a_rule_is_read_once(spark):
    days = recur.rule_dates(F.lit(dt.date(2024, 1, 3)), F.col("rule"), F.lit(None).cast("array<date>"), F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 3, 31)))
    rules = spark.createDataFrame([("FREQ=MONTHLY;BYDAY=-1TH,3WE",), ("FREQ=MONTHLY;BYDAY=5TH,-5TH,XX",), ("FREQ=WEEKLY;BYDAY=ZZ,1MO;COUNT=2",)], "rule string").select("rule", days.alias("days"))
    # In the parsed rule, BYDAY is looked for once.
    assert rules._jdf.queryExecution().analyzed().toString().count("BYDAY=") == 1
    got = {r["rule"]: [f"{d:%m%d}" for d in r["days"]] for r in rules.collect()}
    assert list(got.values()) == [["0117", "0125", "0221", "0229", "0320", "0328"], ["0201", "0229"], ["0108", "0115"]]


def test_a_writer_keeps_one_part_of_sorted_rows(tmp_path):
    writer, most = landed.Writer(str(tmp_path), False, True), 0

    def batches():
        nonlocal most
        for n in range(40):
            kept = gc.get_objects()
            most = max(most, sum(isinstance(o, pa.Table) for o in kept))
            yield pa.RecordBatch.from_pydict({"source": ["s"] * 10, "department": [f"{n // 2:03d}"] * 10, "doc": list(range(10)), "body": ["x"] * 10})

    done = writer.write(batches())
    lines = [json.loads(x) for x in (tmp_path / "_manifests" / done.manifest).read_text().splitlines()]
    assert sorted((x["department"], x["rows"]) for x in lines) == [(f"{n:03d}", 20) for n in range(20)]
    assert most < 12
