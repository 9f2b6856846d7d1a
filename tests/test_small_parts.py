"""Parts that no registered query runs: writers, lists of a page, and lookups."""

import datetime as dt
import json

from pyspark.sql import functions as F

from agendula.functions import dates as D
from agendula.operators import resolve, sequences
from agendula.plans import listing as L
from agendula.schema import EVENT
from agendula.sources import html, jsonld, sinks

AS_OF = dt.date(2026, 7, 1)


def _one(spark, c):
    return spark.range(1).select(c.alias("o")).first().o


def test_moments_and_hours(spark):
    assert _one(spark, D.feed_moment(F.lit("2026-07-01T10:00:00Z"))) is not None and _one(spark, D.feed_moment(F.lit("soon"))) is None
    spec = lambda o, a, z: F.struct(F.lit(o).alias("opens"), F.lit(a).cast("date").alias("from"), F.lit(z).cast("date").alias("to"))
    specs = F.array(spec(None, None, None), spec("09:30:00", None, "2026-06-30"), spec("10:00:00", "2026-07-01", None))
    assert _one(spark, jsonld.opening_time(F.lit(AS_OF), specs)) == "10:00" and _one(spark, jsonld.opening_time(F.lit("2026-06-01").cast("date"), specs)) == "09:30"
    assert _one(spark, sequences.position(F.array(F.lit("a"), F.lit("b")))) == [(1, "a"), (2, "b")]
    assert _one(spark, html.sitemap_slugs(F.lit("<loc>https://x/agenda/a-b/</loc><loc>https://x/news/c</loc><loc>https://x/agenda/d</loc>"), "agenda")) == ["a-b", "d"]
    assert [L.preview_size(n, c) for n, c in ((2, 0), (20, 0), (20, 5), (20, 99))] == [2, 3, 5, 8]


def test_rows_of_older_snapshots_and_towns(spark):
    old = spark.createDataFrame([("t",)], "title string")
    (r,) = resolve.add_missing_columns(old, EVENT).collect()
    assert r.title == "t" and r.town is None and len(r) == len(EVENT.split(", "))
    t = spark.createDataFrame([("", "rue X, Vence"), ("Nice", "Vence"), (None, "nowhere")], "town string, location string")
    assert sorted(str(r.town) for r in L.town_rows(t).collect()) == ["Nice", "None", "Vence"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("town", "Nice", 1, "a"), ("category", "danse", 1, "b")], "kind string, key string, position int, title string")
    sinks.write_pages(rows, str(tmp_path / "pages"))
    assert [(r.kind, r.key, r.title) for r in spark.read.json(str(tmp_path / "pages")).orderBy("title").collect()] == [("town", "Nice", "a"), ("category", "danse", "b")]
    for n in range(2):
        path = sinks.write_snapshot(rows.limit(n + 1), str(tmp_path / "snap"), n)
        sinks.append_runs(rows, str(tmp_path / "runs"))
    assert path.endswith("v00000001") and spark.read.parquet(path).count() == 2 and spark.read.parquet(str(tmp_path / "runs")).count() == 4


def test_lists_of_pages(spark):
    base = {"kind": "town", "key": "Nice", "start": AS_OF, "time": None, "town": "Nice", "venue": None, "online": False, "url": None, "cancelled": False, "end": None, "note": None, "slug": "s", "image": None, "free": False}
    schema = "kind string, key string, start date, time string, town string, venue string, online boolean, url string, cancelled boolean, end date, note string, slug string, image string, free boolean, title string, position int"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = spark.createDataFrame([tuple((base | {"title": t, "position": n}).get(c) for c in names) for n, t in ((2, "B"), (1, "A <x>"), (3, "C"))], schema)
    (r,) = sinks.item_list(rows, "https://x", "R", most=2).collect()
    assert "<" not in r.json
    items = json.loads(r.json)["itemListElement"]
    assert [(i["position"], i["item"]["name"]) for i in items] == [(1, "A <x>"), (2, "B")]


def test_documents_of_the_site(spark):
    report = spark.createDataFrame([("b", "ok", None), ("a", "failed", "x")], "name string, status string, error string")
    assert json.loads(sinks.sources_document(report).first().json) == [{"name": "a", "status": "failed", "error": "x"}, {"name": "b", "status": "ok", "error": None}]
    shown = spark.createDataFrame([("T <1>", AS_OF, "20:30", "Nice", "Hall", True)], "title string, start date, time string, town string, venue string, free boolean")
    total = spark.createDataFrame([(1, 0)], "total long, more long")
    m = sinks.digest_message(shown, total, "https://x", "https://x/u").first()
    assert m.subject == "One new event" and "<b>T &lt;1&gt;</b> Hall · Nice · 20:30 · free" in m.html and "more on the site" not in m.html + m.text
    assert "T <1> · 20:30 · Nice · free" in m.text and m.text.endswith("Unsubscribe: https://x/u")


def test_duplicates_of_long_runs(spark):
    s = spark.createDataFrame([(1, "Grand Bal", dt.date(2026, 9, 2), "NICE"), (2, "Grand Bal", dt.date(2026, 12, 2), "Nice")], "id int, title string, start date, town string")
    e = spark.createDataFrame([("f", "Le grand bal", dt.date(2026, 7, 20), dt.date(2026, 11, 1), "Nice"), ("g", "Grand bal", dt.date(2026, 9, 2), None, "Nice"), ("h", "Grand bal", dt.date(2026, 9, 2), dt.date(2026, 8, 1), "Nice")], "fingerprint string, title string, start date, end date, town string")
    assert sorted((r.id, r.fingerprint) for r in L.find_duplicates(s, e).collect()) == [(1, "f"), (1, "g")]
