"""Steps whose cost was found to grow too fast: what they give, and what they shuffle."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from agendula.functions import dates as D
from agendula.functions import fixed as X
from agendula.functions import text as T
from agendula.operators import resolve
from agendula.plans import source_queries
from agendula.schema import EVENT, SNAPSHOT
from agendula.sources import adapters as A
from agendula.sources import html as H
from agendula.sources import ics

from .test_sources import AS_OF, raw

TOKENS = ["<div>", "</div>", '<p class="a\t b">', "</p>", '<a href="/x?a=1">', '<a href="/y">', "</a>", "<br/>", "<br>", '<img alt="q"/>', "text", "a &amp; b", "&eacute", "<!-- c -->", "<template>", "</template>", "\n", "\xa0", "<h2 >", "</h2>", "<p/>", ">", '"', '<div class="x" class="a">']
ODD = ["<li id=a>", "</li>", "<script>", "</script>", "<A HREF='u'>", "<title>", "</title>", "<", "<?x>", "</ p>", "<!", "<3", "\x00", '<td x="&lt;">']


def _pages(odd: bool, n: int, seed: int = 7) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice(TOKENS + ODD if odd else TOKENS) for _ in range(pick.randint(0, 14))) for _ in range(n)]


def test_plain_markup_is_walked_as_the_standard_parser_walks_it():
    pages, plain = _pages(False, 3000) + _pages(True, 3000), 0
    for page in pages:
        standard, own = H._Tree(), H._Tree()
        standard.feed(page)
        standard.close()
        if own.plain(page):
            plain += 1
            own.close()
            assert own.rows == standard.rows, page
    assert plain > 2000


def test_blocks_are_those_of_within(spark):
    pages = spark.createDataFrame(list(enumerate(_pages(True, 600))), "doc long, html string")
    e = H.elements(pages)
    for begins, asked in ((H.has_class("a"), {"class_": "a"}), ((F.col("tag") == "a") & F.col("href").startswith("/x"), {"tag": "a", "href": "/x"})):
        want = H.within(e, begins).where("block is not null").select("doc", "block", "tag", "href", "alt", "text")
        b = H.blocks(pages, **asked)
        got = b.select("doc", "block", F.explode("inside").alias("x")).select("doc", "block", "x.tag", "x.href", "x.alt", "x.text")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 200
        assert b.select("inside").where(F.exists("inside", H.says_class("a"))).count() == H.within(e, begins).where("block is not null").where(H.has_class("a")).select("doc", "block").distinct().count()


def test_elements_of_blocks_are_not_shuffled(spark):
    for adapter in (A.place_cards, A.genre_cards):
        plan = adapter(raw(spark, "<p>"), AS_OF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def _merge_rows(spark, n: int = 600):
    pick = random.Random(3)
    one = lambda i: {"title": pick.choice(["Big night", "BIG NIGHT", "Big night (Free)", "Cancelled big night", None]), "source": f"s{pick.randrange(3)}", "town": "Nice", "venue": pick.choice(["V", "Venue", None]), "url": pick.choice([f"u{i}", None]), "note": pick.choice(["n", "no", None]), "end": pick.choice([dt.date(2026, 7, 22), None]), "start": dt.date(2026, 7, 20), "free": pick.random() < 0.3, "outdoor": pick.random() < 0.1, "approved": True, "category": "autre"}
    names = [x.split()[0] for x in EVENT.split(", ")]
    # One event has half of all rows.
    rows = [tuple(r.get(c) for c in names) + ("hot" if i % 2 else f"f{pick.randrange(40)}", i) for i in range(n) for r in [one(i)]]
    return spark.createDataFrame(rows, EVENT + ", fingerprint string, seq long")


def test_events_of_very_many_rows_merge_as_others_do(spark):
    rows, now = _merge_rows(spark), F.lit(dt.datetime(2026, 7, 1)).cast("timestamp_ntz")
    none = spark.createDataFrame([], SNAPSHOT)
    merge = lambda crowd: sorted(map(str, resolve.merge_snapshot(resolve.merge_snapshot(none, rows.where("seq < 200"), now, crowd).drop("added", "merged"), rows.where("seq >= 200"), now, crowd).collect()))
    assert len(resolve.crowded(rows, 100)) == 1 and resolve.crowded(rows) == []
    usual = merge(resolve.CROWD)
    assert usual == merge(100) == merge(0) and len(usual) > 30


def test_rows_are_dealt_once_by_a_merge(spark):
    out = resolve.merge_snapshot(spark.createDataFrame([], SNAPSHOT), _merge_rows(spark), F.lit(dt.datetime(2026, 7, 1)).cast("timestamp_ntz"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan, plan


def test_the_store_merges_a_batch_once(spark, monkeypatch):
    calls, whole = [], resolve.merge_snapshot
    monkeypatch.setattr(resolve, "merge_snapshot", lambda *a: calls.append(1) or whole(*a))
    assert source_queries.stored_merge(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 2


BREAKS = ["\r\n", "\r\n", "\n", "\r", "\r\r\n", "\r\n ", "\n\t", "\n\n \t", "\r\r\n \n"]
NAMES = ["SUMMARY", "summary", "ſummary", "DTSTART", "dtﬆart", "DTEND", "locatıon", "EXDATE", "Exdate", "XSUMMARY", "SUMMARYX", "", " SUMMARY"]
VALUES = ["", "Gala", "Bal \\, x\\; y\\n z", "a:b;c", "20260716T210000", "20260723,20260724", "Casita 06300 Nice\\, x", "END:VEVENT"]


def _calendar(pick: random.Random) -> str:
    out = ""
    for _ in range(pick.randint(0, 3)):
        lines = (pick.choice(NAMES) + pick.choice(["", ";A=1", ";A=\"x:y\"", "; "]) + pick.choice([":", ":", ""]) + pick.choice(VALUES) + pick.choice(BREAKS) for _ in range(pick.randint(0, 6)))
        out += pick.choice(["BEGIN:VEVENT", "begin:vevent"]) + pick.choice(BREAKS) + "".join(lines) + pick.choice(["END:VEVENT", "end:VEvent", ""]) + pick.choice(BREAKS)
    return out


def _plainly_read(body: str) -> list[dict]:
    out = []
    for block in re.findall(r"(?is)BEGIN:VEVENT\r?\n(.*?)END:VEVENT", re.sub(r"\r?\n[ \t]", "", body)):
        pairs = [(x.split(":", 1)[0].split(";", 1)[0].upper(), x.split(":", 1)[1]) for x in re.split(r"\r?\n", block) if ":" in x]
        first = lambda k: next((v for n, v in pairs if n == k), "").replace("\\,", ",").replace("\\;", ";").replace("\\n", " ").replace("\\N", " ") or None  # noqa: B023, E731
        out.append({k.lower(): first(k) for k in ("SUMMARY", "DTSTART", "DTEND", "LOCATION")} | {"exdate": ",".join(v for n, v in pairs if n == "EXDATE") or None})
    return out


def test_entries_are_read_as_lines_and_pairs_are(spark):
    pick = random.Random(11)
    bodies = [_calendar(pick) for _ in range(800)]
    want = [(i, n, *e.values()) for i, b in enumerate(bodies) for n, e in enumerate(_plainly_read(b))]
    got = ics.read(spark.createDataFrame(list(enumerate(bodies)), "feed long, body string")).select("feed", "seq", "summary", "dtstart", "dtend", "location", "exdate").orderBy("feed", "seq")
    assert [tuple(r) for r in got.collect()] == want and all(sum(w[c] is not None for w in want) > 50 for c in range(2, 7))


def test_calendar_rows_are_shuffled_once_and_no_filter_reads_days(spark):
    plan = A.calendar(raw(spark, "x"), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert not [x for x in plan.splitlines() if re.match(r"[\s:+*()\d-]*Filter", x) and r"\d{" in x], plan


def test_one_order_serves_feeds_of_their_own_rank(spark):
    pick = random.Random(2)
    entry = lambda: f"BEGIN:VEVENT\nSUMMARY:Gala {pick.randrange(4)}\nDTSTART:2026071{pick.randint(6, 9)}\nLOCATION:Hall {pick.randrange(99)}\n{pick.choice(['', 'RECURRENCE-ID:1', 'RRULE:FREQ=DAILY;COUNT=3'])}\nEND:VEVENT\n"
    feeds = [(i, pick.random(), "s", None, "Nice", None, "".join(entry() for _ in range(pick.randint(0, 5)))) for i in range(60)]
    feeds = spark.createDataFrame(feeds, "feed long, feed_rank double, source string, category string, town string, url string, body string")
    both = [sorted(map(str, ics.events(feeds, AS_OF, ranked=ranked).collect())) for ranked in (False, True)]
    assert both[0] == both[1] and len(both[0]) > 10


def test_slugs_and_keys_of_plain_texts_are_those_of_all_texts(spark):
    pick = random.Random(4)
    words = ["Gala", "le", "Free", "sold out", "SoldOut", "l'été", "annulé", "Cancelled", "Œuvre", "the", "of", "_x_", "--", "\t", "\n", "é", "Привет", "İ", "ß", "K", "new", "newer", "-", "\xa0", "가", "St-Jean"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", "", "-", "_"]) for _ in range(pick.randint(0, 6))) for _ in range(2000)] + [None]
    lower = F.lower(T.strip_accents(F.coalesce("t", F.lit(""))))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, r"(?U)[^\w\s-]", " "), r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    key = F.regexp_replace(F.regexp_replace(F.replace(slug, F.lit("-"), F.lit(" ")), "(?U)" + X.BADGES, " "), "(?U)" + X.ARTICLES, " ")
    key = F.regexp_replace(F.regexp_replace(key, r"[\s-]+", "-"), "^-+|-+$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", slug.alias("a"), T.slugify(F.col("t")).alias("b"), key.alias("c"), T.title_key(F.col("t")).alias("d"))
    assert rows.where("a <> b or c <> d").collect() == [] and rows.where("c = d").count() == len(texts)


def test_a_calendars_moment_is_of_no_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        # Half past two was left out on this day in Nice, not in UTC.
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        rows = spark.createDataFrame([("20260329T023000Z",), ("20260230T1000",), ("20260329T250000",), ("2026",), (None,)], "v string")
        got = [tuple(r) for r in rows.select(*D.ics_datetime(F.col("v"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(dt.date(2026, 3, 29), "04:30"), *[(None, None)] * 4]


def test_a_location_is_stripped_to_its_very_ends(spark):
    rows = spark.createDataFrame([("Hall,\u2028 06000 - Nice., x",), ("Hall,\u202806000 .Nice- \nx",), ("12345",), (" Bar ",), ("",), (None,)], "v string")
    want = [("Hall,\u2028", "Nice", "06000"), ("Hall,\u2028", "Nice", "06000"), (None, None, "12345"), ("Bar", None, None), (None, None, None), (None, None, None)]
    assert [tuple(r) for r in rows.select(*T.split_location(F.col("v"))).collect()] == want
