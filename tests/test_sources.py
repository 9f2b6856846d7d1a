"""Adapters on small payloads, the registry, sinks and the stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from agendula.operators import resolve
from agendula.schema import EVENT
from agendula.sources import adapters as A
from agendula.sources import html, ics, sinks
from agendula.streaming import incremental

AS_OF = dt.date(2026, 7, 15)


def raw(spark, *bodies, source="x"):
    return spark.createDataFrame([(source, i, f"http://x/{i}", b) for i, b in enumerate(bodies)], "source string, doc long, url string, body string")


def day(n, m=7, y=2026):
    return dt.date(y, m, n)


def test_elements_and_cards():
    rows = html.parse('<div id=a><p>Hi <b>there</b></p><script>no</script><a href="/x">go</a></div>')
    assert [(r["tag"], r["parent"], r["text"]) for r in rows] == [("div", None, "Hi there go"), ("p", 0, "Hi there"), ("b", 1, "there"), ("script", 0, ""), ("a", 0, "go")]
    assert rows[2]["card"] == 0 and html.parse(None) == [] and html.parse("<p>open") != []


def test_heading_dated(spark):
    page = "<h2>Samedi 18 juillet 2026</h2><ul><li><h3>Vide-grenier</h3><a href='/v'>8h00</a></li></ul><h2>Dimanche 19 juillet 2026</h2><li><h3>Brocante</h3><a href='/b'>x</a></li><li><h3>Brocante</h3><a href='/b'>x</a></li>"
    got = A.heading_dated(raw(spark, page), AS_OF, town="Nice").orderBy("pos").collect()
    assert [(r.title, r.start, r.time, r.url, r.category) for r in got] == [("Vide-grenier", day(18), "08:00", "/v", "brocante"), ("Brocante", day(19), None, "/b", "brocante")]


def test_timed_and_text_cards(spark):
    page = "<article><h3>Expo</h3><a href='/e'>l</a><time datetime='2026-07-18T10:00'>a</time><time datetime='2026-07-30'>b</time></article>"
    assert [(r.title, r.start, r.end, r.url) for r in A.timed_cards(raw(spark, page), AS_OF).collect()] == [("Expo", day(18), day(30), "/e")]
    page = "<li><a href='/agenda/grand-bal/'>21/07/2026 19:30</a></li>"
    assert [(r.title, r.start, r.time) for r in A.text_dated(raw(spark, page), AS_OF).where("url is not null").collect()][0] == ("Grand Bal", day(21), "19:30")
    page = "<article><h3>Phedre</h3>10 au 12 octobre et 3 mars a 20h30</article>"
    got = A.season_calendar(raw(spark, page), AS_OF, 2026).orderBy("start").collect()
    assert [r.start for r in got] == [day(10, 10), day(11, 10), day(12, 10), day(3, 3, 2027)] and got[0].time == "20:30"


LD = {"@graph": [{"@type": ["Thing", "MusicEvent"], "name": "Jazz &amp; co", "startDate": "2026-07-20T20:30:00+02:00", "endDate": "2026-07-22", "location": {"name": "Arenes", "address": {"addressLocality": "Nice", "postalCode": "06000"}}, "offers": [{"price": "0"}]}, {"@type": "Event", "name": "Far", "startDate": "2026-07-20", "location": {"name": "P", "address": {"postalCode": "75001"}}}]}


def test_structured_pages_fall_back(spark):
    with_ld = f'<script type="application/ld+json">{json.dumps(LD)}</script><article><h3>No</h3><time datetime="2026-07-18"></time></article>'
    without = '<article><h3>Card</h3><time datetime="2026-07-18"></time></article>'
    got = sorted(A.structured_pages(raw(spark, with_ld, without, "<script type='application/ld+json'>Event {broken</script>"), AS_OF).collect(), key=lambda r: r.title)
    assert [(r.title, r.start, r.end, r.time, r.venue, r.town, r.free) for r in got] == [("Card", day(18), None, None, None, None, None), ("Jazz & co", day(20), day(22), "20:30", "Arenes", "Nice", True)]


def test_wordpress(spark):
    items = [{"slug": "bal", "link": "http://p/bal", "title": {"rendered": "Bal &amp; feu"}, "excerpt": {"rendered": "<p>x</p>"}, "event_types": [7], "acf": {"place": 3, "free": True, "pages": [9], "external_link": None, "event_dates": [{"start_date": "20260718", "end_date": "20260719", "start_time": "19h"}, {"start_date": "20260725", "ticketing": "http://t"}]}}, {"slug": "cool", "link": "l", "title": {"rendered": "Pause fraîcheur"}, "acf": {"event_dates": [{"start_date": "20260718"}]}}]
    tables = {"places": spark.createDataFrame([(3, "Salle")], "id int, name string"), "types": spark.createDataFrame([(7, "Danse")], "id int, label string"), "parents": spark.createDataFrame([(9, "http://parent")], "id int, link string")}
    slugs = spark.createDataFrame([("bal",)], "slug string")
    got = A.wordpress(raw(spark, json.dumps(items)), AS_OF, slugs=slugs, **tables).orderBy("pos").collect()
    assert [(r.title, r.start, r.end, r.time, r.venue, r.category, r.url, r.free) for r in got] == [("Bal & feu", day(18), day(19), "19:00", "Salle", "danse", "http://p/bal", True), ("Bal & feu", day(25), None, None, "Salle", "danse", "http://t", True)]
    first = lambda **k: A.wordpress(raw(spark, json.dumps(items)), AS_OF, **k).orderBy("pos").first().url
    assert first(slugs=slugs.where("false"), **tables) == "http://parent" and first() == "http://p/bal" and first(slugs=slugs.where("false")) is None


def test_open_data_state_and_submissions(spark):
    body = {"results": [{"title_fr": "Jazz", "firstdate_begin": "2026-07-18T21:00:00", "lastdate_end": "2026-07-18T23:00", "location_city": "x", "location_postalcode": "6310"}, {"title_fr": "Loin", "firstdate_begin": "2026-07-18", "location_postalcode": "83000"}]}
    assert [(r.title, r.start, r.end, r.time, r.town) for r in A.open_data(raw(spark, json.dumps(body)), AS_OF).collect()] == [("Jazz", day(18), None, "21:00", "Beaulieu-sur-Mer")]
    state = {"a": [{"b": {"title": "Talk [online]", "dateTime": "2026-07-20T18:00+02:00", "venue": {"name": "V", "city": "Nice"}}}, {"title": "DJ", "date": "2026-07-21", "artists": [{"name": str(i)} for i in range(9)]}]}
    got = A.state_objects(raw(spark, f'<script id="__NEXT_DATA__" type="x">{json.dumps(state)}</script>', "none"), AS_OF, town="Nice").orderBy("start").collect()
    assert [(r.title, r.start, r.time, r.venue, r.online, r.note) for r in got] == [("Talk [online]", day(20), "18:00", "V", True, None), ("DJ", day(21), None, None, False, "0, 1, 2, 3, 4, 5")]
    subs = [{"id": "7", "title": "Mine", "start_date": "2026-07-20", "town": "Nice", "approved": True, "email": "p@x"}, {"id": "8", "title": "No", "start_date": "2026-07-20", "approved": False}]
    got = A.submissions(raw(spark, json.dumps(subs)), AS_OF)
    assert [(r.title, r.submitted_by) for r in got.collect()] == [("Mine", "7")] and "email" not in got.columns


ICS = "BEGIN:VCALENDAR\r\n" + "".join(
    f"BEGIN:VEVENT\r\n{x}\r\nEND:VEVENT\r\n"
    for x in [
        "SUMMARY:Milonga\\, bal\r\nDTSTART;TZID=Europe/Paris:20260716T210000\r\nDTEND:20260717T010000\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nEXDATE:20260723T210000\r\nLOCATION:Casita\\, rue X 06300 Nice\r\nDESCRIPTION:long \r\n text TARIF : 12€",
        "SUMMARY:(ANNULEE) Milonga\\, bal\r\nDTSTART:20260730T210000\r\nRECURRENCE-ID:20260730T210000\r\nLOCATION:Casita 06300 Nice",
        "SUMMARY:Stage\r\nDTSTART;VALUE=DATE:20260718\r\nDTEND;VALUE=DATE:20260720",
        "SUMMARY:Over\r\nDTSTART:20200101",
    ]
)


def test_calendars(spark):
    rows = ics.read(spark.createDataFrame([("f", ICS)], "feed string, body string")).orderBy("seq").collect()
    assert (rows[0].summary, rows[0].dtstart, rows[0].exdate, rows[0].description) == ("Milonga, bal", "20260716T210000", "20260723T210000", "long text TARIF : 12€")
    got = sorted(A.calendar(raw(spark, ICS), AS_OF, town="Nice").collect(), key=lambda r: r.start)
    assert [(r.title, r.start, r.end, r.time, r.venue) for r in got] == [("Milonga, bal", day(16), None, "21:00", "Casita, rue X"), ("Stage", day(18), day(19), None, None), ("(ANNULEE) Milonga, bal", day(30), None, "21:00", "Casita")]
    assert got[0].price == "12€" and len(A.calendar(raw(spark, ICS), AS_OF, expand=False, coarse=True).collect()) == 3


def test_exclusions_details_and_budget(spark):
    rows = spark.createDataFrame([("a", "V", None, None, day(18), None), ("b", "V", "t", None, day(17), day(30)), ("c", "W", None, "n", day(16), None)], "url string, venue string, time string, note string, start date, end date")
    gone = spark.createDataFrame([("a",), ("c",)], "href string")
    left = lambda x: sorted(r.url for r in A.without_excluded(rows, "V", x).collect())
    assert left(gone) == ["b", "c"] and left(None) == ["c"] and left(gone.where("false")) == ["a", "b", "c"]
    d = spark.createDataFrame([("a", "Hall", "", "new"), ("b", None, "u", "")], "url string, venue string, time string, note string")
    assert sorted((r.url, r.venue, r.time, r.note) for r in A.enrich(rows, d).collect()) == [("a", "Hall", None, "new"), ("b", "V", "u", None), ("c", "W", None, "n")]
    assert [r.url for r in A.enrichment_budget(rows, AS_OF, most=2).collect()] == ["c", "a"]


def test_registry(spark):
    reg = A.default_registry()
    both = raw(spark, '{"start":"2026-07-20","title":"Fete","town":"Nice","note":"a 21h00"}\nbroken', source="curated").unionByName(raw(spark, ICS, None, source="calendars"))
    got = reg.extract(both, AS_OF, ["curated", "calendars"]).orderBy("seq").collect()
    assert [(r.source, r.title, r.time) for r in got][0] == ("curated", "Fete", "21:00") and len(got) == 4 and len({r.seq for r in got}) == 4
    with pytest.raises(ValueError):
        reg.extract(both, AS_OF, ["nowhere"])
    with pytest.raises(ValueError):
        reg.add(A.Source("curated", A.table))
    assert {n for n, s in reg.sources.items() if s.reconciles} == {"season_calendar", "season_programme", "calendars"}


def _rows(spark):
    names = [x.split()[0] for x in EVENT.split(", ")]
    base = {"title": "Bal <b>", "start": day(20), "town": "Nice", "source": "s", "category": "danse", "time": "20:30", "note": None, "free": True, "outdoor": False, "online": False, "approved": True}
    return resolve.normalize_events(spark.createDataFrame([tuple((base | x).get(n) for n in names) for x in ({}, {"title": "Nuit", "start": day(25), "end": day(27), "time": None, "online": True})], EVENT))


def test_sinks(spark):
    e = _rows(spark).withColumns({"slug": F.lit("bal"), "cancelled": F.col("title") == "Nuit"})
    ld = json.loads(sinks.structured_data(e, F.lit(AS_OF), "https://x", "Region").first().json)
    assert ld[0]["name"] == "Bal <b>" and ld[0]["startDate"] == "2026-07-20T20:30:00+02:00" and ld[0]["location"]["address"]["addressRegion"] == "Region" and "endDate" not in ld[0] and ld[0]["isAccessibleForFree"] is True
    assert ld[1]["endDate"] == "2026-07-27" and ld[1]["eventStatus"].endswith("Cancelled") and ld[1]["location"]["@type"] == "VirtualLocation"
    feed = json.loads(sinks.feed_document(e.select("title", "start", "note"), F.lit("2026-07-15").cast("timestamp_ntz"), ["start", "title"]).first().json)
    assert feed == {"generated": "2026-07-15T00:00:00Z", "count": 2, "events": [{"title": "Bal <b>", "start": "2026-07-20"}, {"title": "Nuit", "start": "2026-07-25"}]}
    assert "<" not in sinks.page_json(e, ["start", "title"]).first().json
    text = e.select(sinks.ics_event(F.col("fingerprint"), F.col("title"), F.col("start"), F.col("end"), F.col("time"), F.lit("a, b")).alias("i")).orderBy("i").collect()
    assert any("DTSTART:20260720T203000\r\nDTEND:20260720T223000\r\nLOCATION:a\\, b" in r.i for r in text) and any("DTEND;VALUE=DATE:20260728" in r.i for r in text)
    assert "  Bal <b> · 20:30 · Nice · free" in sinks.digest_text(e.select("title", "start", "time", "town", "free")).first().text
    assert sinks.sitemap_lines(spark.createDataFrame([("a&b/",)], "path string"), "https://x", F.lit(AS_OF)).first().line == "  <url><loc>https://x/a&amp;b/</loc><lastmod>2026-07-15</lastmod></url>"


def test_stream_merges_batches(spark, tmp_path):
    rows = _rows(spark).drop("fingerprint").withColumns({"seq": F.monotonically_increasing_id(), "seen": F.lit(dt.datetime(2026, 7, 15))})
    landed, out = str(tmp_path / "landed"), f"file://{tmp_path}/snap"
    for n in range(2):
        rows.withColumn("title", F.concat("title", F.lit(f" {n}"))).coalesce(1).write.mode("append").parquet(landed)
        incremental.merge_stream(spark.readStream.schema(rows.schema).parquet(landed), out, str(tmp_path / "cp"), AS_OF, ["s"]).awaitTermination()
    assert incremental.latest(spark, out).count() == 4 and incremental.latest(spark, out, before=1).count() == 2
    assert incremental.latest(spark, f"file://{tmp_path}/none").count() == 0
