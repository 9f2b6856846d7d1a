"""Expectations that earlier versions of the engine missed."""

import datetime as dt
import html
import json
import unicodedata

from pyspark.sql import functions as F

from agendula.functions import text as T
from agendula.operators import sequences
from agendula.sources import adapters as A
from agendula.sources import jsonld

from .test_operators import AS_OF, _published


def _each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_references_of_every_kind(spark):
    texts = ["L&#8217;&#233;t&#xE9; &ocirc;t&eacute; &oelig;uvre &Eacute;cole", "a &amp;eacute; b", "&#146;x&#150;", "no & reference &zzzz; &#0;", "&lt;b&gt; &nbsp;x", "😀 &#128512;", "plain", ""]
    assert _each(spark, texts, T.unescape) == [html.unescape(t) for t in texts]
    assert _each(spark, [None], T.unescape) == [None]


def test_accents_of_every_script(spark):
    texts = ["й Ά ㎏ ½ ﬁ … № ℃ ①", "Ǆ ĳ été ÀÉÎ", "ộ ṩ ὰ", "𝒅𝒊𝒎 Ｆｕｌｌ", "ł ø đ ß", "日本 x"]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert _each(spark, texts[:1] + texts[2:], T.strip_accents) == [bare(t) for t in texts[:1] + texts[2:]]
    assert _each(spark, texts[:1] + texts[2:], T.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts[:1] + texts[2:]]


def test_a_lone_far_event_is_not_recurring(spark):
    far = AS_OF + dt.timedelta(80)
    rows = [{"title": "Alone", "venue": "V", "start": far, "url": "a"}] + [{"title": "Twice", "venue": "V", "start": far + dt.timedelta(7 * i), "url": f"u{i}"} for i in range(2)]
    got = sequences.fold_recurring(_published(spark, *rows), F.lit(AS_OF)).collect()
    assert sorted((r.title, r.recurring) for r in got) == [("Alone", False), ("Twice", True)]


def test_online_events_have_no_town(spark):
    state = [
        {"name": "Zoom talk", "startTime": "2026-07-20T18:00", "isOnline": True},
        {"title": "Virtual", "dateTime": "2026-07-20T19:00", "eventType": "VIRTUAL", "venue": {"name": "Room", "city": "Lyon"}},
        {"title": "Here", "dateTime": "2026-07-21T19:00"},
        {"name": "Not an event", "city": "Nice"},
    ]
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'
    raw = spark.createDataFrame([(1, page)], "doc long, body string")
    got = A.state_objects(raw, AS_OF, town="Nice").collect()
    assert sorted((r.title, r.town, r.venue, r.online) for r in got) == [("Here", "Nice", None, False), ("Virtual", "Online", "Room", True), ("Zoom talk", "Online", "Online event", True)]


def test_objects_at_any_depth(spark):
    deep = {"title": "deep", "dateTime": "2026-07-20"}
    for _ in range(30):
        deep = {"x": [deep]}
    got = jsonld.objects(spark.createDataFrame([(1, json.dumps(deep))], "doc long, json string")).where("variant_get(node, '$.title', 'string') = 'deep'")
    assert got.count() == 1


def test_days_of_a_span_have_places_of_their_own(spark):
    page = "<article><h2>Piece</h2><p>8 au 12 octobre a 20 h</p></article>"
    raw = spark.createDataFrame([(300_000_000, page), (2, page.replace("Piece", "Other"))], "doc long, body string")
    got = A.season_calendar(raw, AS_OF, 2026, town="Antibes")
    assert len({(r.doc, r.pos) for r in got.collect()}) == got.count() == 10
