"""Registered queries of sources: orders become payloads as a source sends them, are landed, read back through filters and given to an adapter.

A payload holds the orders of one customer (or some hundred of one nation and month), so none grows with the table.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, shared_dir
from ..operators import resolve
from ..sources import adapters, landed
from ..streaming.store import Store
from .core_queries import EARLY, NOW, part_events
from .queries import AS_OF, SQL, _read, query

#: Before all orders: adapters that take the day of the run keep them all.
LONG_AGO = dt.date(1990, 1, 1)


def _orders(spark, folder) -> DataFrame:
    o, c = _read(spark, folder, "orders"), _read(spark, folder, "customer")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"))


def _landed(spark, source: str, payloads: DataFrame) -> DataFrame:
    """Payloads (doc, body and any keys) landed in the shared folder and read back."""
    path = f"{shared_dir(spark)}/agendula/landed-{uuid.uuid4().hex}"
    landed.land(payloads.withColumns({"source": F.lit(source), "status": F.lit(200), "url": F.concat(F.lit("https://x/"), F.col("doc").cast("string"))}), path)
    return landed.read(spark, path).where(F.col("source") == source)


def _by_customer(spark, folder, item: Column, begin: str = "", end: str = "", between: str = "") -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("id", item.alias("item"))))["item"]
    body = F.concat(F.lit(begin), F.array_join(items, between), F.lit(end))
    return _orders(spark, folder).groupBy(F.col("cust").alias("doc")).agg(body.alias("body"))


def _day() -> Column:
    return F.col("day").cast("string")


def _id() -> Column:
    return F.col("id").cast("string")


@query("""select o_orderkey as id, o_orderdate::date as start, '19:30' as time, 'Hall ' || c_mktsegment as venue from orders join customer on c_custkey = o_custkey
where c_nationkey = 6 and o_orderdate >= date '1996-01-01'""")
def landed_open_data(spark, folder):
    """Pages of an open-data listing; the department and the month are chosen before anything is read."""
    item = F.struct(F.concat(F.lit("Order "), _id()).alias("title_fr"), F.concat(_day(), F.lit("T19:30:00+02:00")).alias("firstdate_begin"), F.concat(F.lit("Hall "), "segment").alias("location_name"), F.concat(F.lit("Ville "), F.col("nation").cast("string")).alias("location_city"), (F.col("nation") * 1000 + 100).alias("location_postalcode"), F.concat(F.lit("https://x/"), _id()).alias("canonicalurl"))
    pages = _orders(spark, folder).groupBy("nation", F.trunc("day", "month").alias("day"), F.floor(F.col("id") / 400).alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("results"))).alias("body"))
    pages = pages.select("day", F.lpad(F.col("nation").cast("string"), 2, "0").alias("department"), (F.col("page") * 100_000 + F.datediff("day", F.lit(LONG_AGO)) * 100 + F.col("nation")).alias("doc"), "body")
    raw = _landed(spark, "open_data", pages).where((F.col("department") == "06") & (F.col("day") >= F.lit(dt.date(1996, 1, 1))))
    out = adapters.open_data(raw, LONG_AGO)
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("id"), "start", "time", "venue")


@query("select o_orderkey::varchar as id, o_orderdate::date as start, 'Order ' || o_orderkey as title from orders where o_orderstatus = 'F'")
def landed_submissions(spark, folder):
    """Approved submissions of a table's answer."""
    item = F.to_json(F.struct(_id().alias("id"), F.concat(F.lit("Order "), _id()).alias("title"), _day().alias("start_date"), F.lit("Nice").alias("town"), (F.col("status") == "F").alias("approved"), F.lit("a@b.fr").alias("email")))
    raw = _landed(spark, "submissions", _by_customer(spark, folder, item, "[", "]", ","))
    return adapters.submissions(raw, LONG_AGO).select(F.col("submitted_by").alias("id"), "start", "title")


@query("""select 'Gala ' || o_orderkey as title, o_orderdate::date as start, 'Hall ' || c_mktsegment as venue, 'Nice' as town from orders join customer on c_custkey = o_custkey where o_orderdate >= :as_of""")
def landed_calendars(spark, folder):
    """Calendars of customers: entries that are not over."""
    entry = F.concat(F.lit("BEGIN:VEVENT\r\nSUMMARY:Gala "), _id(), F.lit("\r\nDTSTART;VALUE=DATE:"), F.date_format("day", "yyyyMMdd"), F.lit("\r\nLOCATION:Hall "), "segment", F.lit("\\, 06000 Nice\r\nEND:VEVENT\r\n"))
    raw = _landed(spark, "calendars", _by_customer(spark, folder, entry, "BEGIN:VCALENDAR\r\n", "END:VCALENDAR"))
    return adapters.calendar(raw, AS_OF).select("title", "start", "venue", "town")


@query("""select 'Gala ' || o_orderkey as title, o_orderdate::date as start, 'Hall ' || c_mktsegment as venue, 'Nice' as town from orders join customer on c_custkey = o_custkey""")
def landed_structured_pages(spark, folder):
    """Pages with JSON-LD: a list of events each."""
    place = F.struct(F.lit("Place").alias("@type"), F.concat(F.lit("Hall "), "segment").alias("name"), F.struct(F.lit("Nice").alias("addressLocality")).alias("address"))
    item = F.to_json(F.struct(F.lit("Event").alias("@type"), F.concat(F.lit("Gala "), _id()).alias("name"), _day().alias("startDate"), place.alias("location")))
    raw = _landed(spark, "structured_pages", _by_customer(spark, folder, item, '<html><script type="application/ld+json">[', "]</script></html>", ","))
    return adapters.structured_pages(raw, LONG_AGO).select("title", "start", "venue", "town")


@query("""select 'Gala ' || o_orderkey as title, o_orderdate::date as start, case when o_orderkey % 3 > 0 then o_orderdate::date + (o_orderkey % 3)::int end as "end", '21:00' as time, '/e/' || o_orderkey as url from orders""")
def landed_place_cards(spark, folder):
    """Cards with places, their days machine-readable."""
    last = F.date_add("day", (F.col("id") % 3).cast("int")).cast("string")
    card = F.concat(F.lit('<div class="event-item__wrap"><div><a class="event-item__title-link" href="/e/'), _id(), F.lit('">Gala '), _id(), F.lit('</a></div><ul><li><time datetime="'), _day(), F.lit('">a</time></li><li><time datetime="'), last, F.lit('">b</time><time datetime="21:00">c</time></li></ul><div class="time-place__item is-place">Lieu : Nice</div><a class="event-item__category">Jazz</a></div>'))
    raw = _landed(spark, "place_cards", _by_customer(spark, folder, card))
    return adapters.place_cards(raw, LONG_AGO).select("title", "start", "end", "time", "url")


@query("""select 'Gala ' || o_orderkey as title, o_orderdate::date as start, c_mktsegment as venue, case o_orderkey % 3 when 0 then 'concert' when 1 then 'scene' else 'danse' end as category, '/evenement/' || o_orderkey as url
from orders join customer on c_custkey = o_custkey""")
def landed_genre_cards(spark, folder):
    """Cards with genres."""
    genre = F.get(F.array(F.lit("Jazz"), F.lit("Théâtre"), F.lit("Danse")), (F.col("id") % 3).cast("int"))
    link = F.concat(F.lit('<a href="/evenement/'), _id(), F.lit('/"><div class="info-container"><img alt="Gala '), _id(), F.lit('"><h2>Head</h2><span class="date">'), F.date_format("day", "dd/MM/yyyy"), F.lit('</span><p class="lieu">'), "segment", F.lit('</p><p class="genre">'), genre, F.lit("</p></div></a>"))
    raw = _landed(spark, "genre_cards", _by_customer(spark, folder, link))
    return adapters.genre_cards(raw, LONG_AGO).select("title", "start", "venue", "category", "url")


@query(SQL["merge_snapshot"])
def stored_merge(spark, folder):
    """The merge of lines into events through the bucketed store: early lines are one version, later ones the next."""
    rows = part_events(_read(spark, folder, "lineitem"))
    early, now = F.col("start") < F.lit(EARLY), F.lit(NOW).cast("timestamp_ntz")
    # A part's event has one day, so that its bucket stays.
    rows = rows.withColumn("early", early).withColumn("start", F.date_add(F.lit(LONG_AGO), (F.col("fingerprint").cast("long") % 2000).cast("int")))
    store = Store(spark, f"{shared_dir(spark)}/agendula/store-{uuid.uuid4().hex}", 16)
    counts = []
    for first in (True, False):
        batch = rows.where("early" if first else "not early").drop("early")
        touched = {r["b"] for r in batch.select(store.bucket().alias("b")).distinct().collect()}

        def change(stored: DataFrame, batch=batch) -> DataFrame:
            # Merged once: the store takes the events, the result what became of them.
            merged = cut(resolve.merge_snapshot(stored, batch, now), "merged")
            counts[:] = [merged.select("fingerprint", "added", "merged")]
            return merged.drop("added", "merged")

        store.rewrite(touched, change)
    # Events in buckets that the last batch left alone were met by nothing.
    out = store.read().join(counts[0], "fingerprint", "left").fillna({"added": False, "merged": 0})
    return out.select(F.col("fingerprint").cast("long").alias("id"), "title", "source", "end", "url", "venue", "note", "free", "outdoor", "sources", "added", "merged")
