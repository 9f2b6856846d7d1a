"""Registered queries that run the engine's own operators on the benchmark tables, each with SQL written from what the operator must do."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..lineage import cut
from ..operators import gazetteer, resolve, rules, sequences
from ..operators.ranking import numbered
from ..sources import jsonld, sinks
from . import listing as L
from . import quality as Q
from .queries import _LISTINGS, _LIVE, AS_OF, _read, listings, query

NOW = dt.datetime(1998, 6, 1, 12)

_NULLS = {"time": "string", "image": "string", "price": "string", "url": "string", "note": "string", "submitted_by": "string"}


def _filled(rows: DataFrame) -> DataFrame:
    """Rows with the event fields that they lack."""
    rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in _NULLS.items() if c not in rows.columns})
    rows = rows.withColumns({c: F.lit(False) for c in ("free", "outdoor", "online") if c not in rows.columns})
    return rows.withColumns({c: v for c, v in {"approved": F.lit(True), "category": F.lit("autre"), "end": F.lit(None).cast("date")}.items() if c not in rows.columns})


# --- the merge: lines of one part are one event, by (ship date, order, line); lines of early orders are stored already

_MERGE_BASE = """
with l as (select *, row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey) as seq from lineitem),
r as (select l_partkey as id, seq, 's' || (l_suppkey % 3) as source, 'Venue ' || repeat('x', (l_quantity::bigint % 7)::int) as venue,
  case when l_linenumber % 2 = 0 then l_shipdate::date end as "end", case when l_linenumber % 3 <> 0 then 'u' || l_orderkey end as url,
  l_shipdate::date < date '1995-06-01' as early, l_discount < 0.02 as free, l_tax > 0.07 as outdoor, case when l_quantity > 25 then 'n' || l_quantity::bigint end as note,
  case l_linenumber % 4 when 0 then 'BIG NIGHT' when 1 then 'Big night' when 2 then 'Big night (Free)' else 'Cancelled big night' end as title from l),
"""


@query(
    _MERGE_BASE
    + """
o as (select *, first_value(source) over (partition by id order by seq) as owner from r),
p as (select *, source = owner as owns, title like 'Cancelled%' as off, case when title = 'BIG NIGHT' then 10 when title like '%(Free)' then 5 else 0 end as bad from o),
t as (select id, list_reduce(list({'title': title, 'off': off, 'bad': bad} order by seq), lambda a, b: case when (b.off and not a.off) or b.bad < a.bad then b else a end).title as title from p group by id),
m as (select id, max(seq) filter (where owns and "end" is null) as cleared, max(seq) filter (where "end" is not null) as ended, arg_max("end", seq) filter (where "end" is not null) as last_end,
  arg_max(url, seq) filter (where owns and url is not null) as own_url, arg_min(url, seq) filter (where not owns and url is not null) as other_url,
  arg_max(free, seq) filter (where owns) as own_free, max(seq) filter (where owns) as own_at, max(seq) filter (where not owns and free) as other_free_at,
  arg_min(venue, (-length(venue), seq)) as venue, arg_min(note, (-length(note), seq)) filter (where note is not null) as note,
  bool_or(outdoor) as outdoor, list_sort(list(distinct source)) as sources, any_value(owner) as source,
  not bool_or(early) as added, count(*) filter (not early) - case when bool_or(early) then 0 else 1 end as merged from p group by id)
select m.id, t.title, source, case when ended is not null and (cleared is null or ended > cleared) then last_end end as "end", coalesce(own_url, other_url) as url, venue, note,
  own_free or coalesce(other_free_at > own_at, false) as free, outdoor, sources, added, merged from m join t on m.id = t.id"""
)
def merge_snapshot(spark, folder):
    """Lines of a part: early ones are merged into an empty snapshot and written, later ones are the batch that meets them."""
    rows = part_events(_read(spark, folder, "lineitem"))
    now = F.lit(NOW).cast("timestamp_ntz")
    early = F.col("start") < F.lit(EARLY)
    none = rows.where("false").drop("seq").withColumns({"sources": F.array("source"), "first_seen": now, "last_seen": now})
    stored = cut(resolve.merge_snapshot(none, rows.where(early), now).drop("added", "merged"), "stored")
    out = resolve.merge_snapshot(stored, rows.where(~early), now)
    return out.select(F.col("fingerprint").cast("long").alias("id"), "title", "source", "end", "url", "venue", "note", "free", "outdoor", "sources", "added", "merged")


EARLY = dt.date(1995, 6, 1)


def part_events(lines: DataFrame) -> DataFrame:
    """A line as an adapter row of the event that its part is, in the order of its ship date."""
    order = F.format_string("%s%012d%04d%012d", F.date_format("l_shipdate", "yyyyMMdd"), "l_orderkey", "l_linenumber", "l_suppkey").cast("decimal(38,0)")
    line = F.col("l_linenumber")
    title = F.when(line % 4 == 0, "BIG NIGHT").when(line % 4 == 1, "Big night").when(line % 4 == 2, "Big night (Free)").otherwise("Cancelled big night")
    return _filled(
        lines.select(
            F.col("l_partkey").cast("string").alias("fingerprint"), order.alias("seq"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), F.concat(F.lit("Venue "), F.repeat(F.lit("x"), (F.col("l_quantity").cast("long") % 7).cast("int"))).alias("venue"),
            F.when(line % 2 == 0, F.to_date("l_shipdate")).alias("end"), F.when(line % 3 != 0, F.concat(F.lit("u"), F.col("l_orderkey").cast("string"))).alias("url"), (F.col("l_discount") < 0.02).alias("free"), (F.col("l_tax") > 0.07).alias("outdoor"),
            F.when(F.col("l_quantity") > 25, F.concat(F.lit("n"), F.col("l_quantity").cast("long").cast("string"))).alias("note"), title.alias("title"), F.lit("Nice").alias("town"), F.to_date("l_shipdate").alias("start"))
    )


# --- the listing

_KIND = "case when category = '5-LOW' then 'expo' else category end"
_ASKED = _LISTINGS + f""", b as (select *, {_KIND} as kind from ev where start <= :as_of + 60 and {_LIVE} and town in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6') and price < 400000)"""
_TOWNS = frozenset(f"NATION_{i}" for i in range(1, 7))


def _asked(spark, folder, **more) -> tuple[DataFrame, L.ListingQuery]:
    kind = F.when(F.col("category") == "5-LOW", "expo").otherwise(F.col("category"))
    e = _filled(listings(spark, folder)).withColumns({"category": kind, "title": F.col("venue"), "fingerprint": F.col("id"), "online": F.col("price") >= 400_000})
    return e, L.ListingQuery(AS_OF, last=AS_OF + dt.timedelta(60), towns=_TOWNS, **more)


@query(
    _ASKED
    + """ select id, (greatest(start, :as_of) + i::int)::date as day from b, range(0, 61) t(i) where kind in ('1-URGENT', 'expo') and not (kind = 'expo' and "end" is not null)
  and (i = 0 or ("end" is not null and greatest(start, :as_of) + i::int <= least(:as_of + 31, "end")))"""
)
def listing_feed(spark, folder):
    e, q = _asked(spark, folder, categories=frozenset({"1-URGENT", "expo"}))
    return L.listing(e, q).feed.select("id", "day")


@query(_ASKED + """ select id, "end" from b where kind = 'expo' and "end" is not null""")
def listing_standing(spark, folder):
    e, q = _asked(spark, folder)
    return L.listing(e, q).standing.select("id", "end")


@query(_ASKED + " select kind as category, count(*) as n from b group by kind")
def listing_facets(spark, folder):
    e, q = _asked(spark, folder, categories=frozenset({"1-URGENT"}))
    return L.listing(e, q).facets


@query(_ASKED + """, w as (select count(*) as week from ev where start <= :as_of + 7 and """ + _LIVE + """ and price < 400000)
select count(*) filter (where kind = '1-URGENT') as listings, count(*) filter (where kind = 'expo' and "end" is not null) as standing, any_value(week) as week from b, w""")
def listing_tallies(spark, folder):
    e, q = _asked(spark, folder, categories=frozenset({"1-URGENT"}))
    return L.tallies(e, q)


@query(_LISTINGS + """ select id, category = '5-LOW' and "end" is not null and "end" - :as_of between 0 and 10 as ends, :as_of - start <= 7 as new from ev where """ + _LIVE)
def listing_badges(spark, folder):
    e, _ = _asked(spark, folder)
    marks = L.badges(F.lit(AS_OF))
    # A listing was first seen on the day it begins.
    return e.where(L.live(F.lit(AS_OF))).withColumn("first_seen", F.col("start")).select("id", F.coalesce(marks["ends"], F.lit(False)).alias("ends"), marks["new"].alias("new"))


@query(_LISTINGS + f"""select id, 'until ' || strftime("end", '%-d %b') as until, row_number() over (order by "end", venue, id) as position from ev where {_LIVE} and start < :as_of""")
def ongoing_rows(spark, folder):
    e = listings(spark, folder).where(L.live(F.lit(AS_OF))).withColumns({"title": F.col("venue"), "fingerprint": F.col("id")})
    ongoing, _ = L.split_ongoing(e, AS_OF)
    return numbered(ongoing, [], ["end", "title", "fingerprint"]).select("id", "until", "position")


_PAGES = _LISTINGS + f""", soon as (select * from ev where {_LIVE} and start <= :as_of + 90),
n as (select 'town' as kind, town as key, least(count(*), 250) as shown, count(*) as page_rows from soon group by town having count(*) >= 5
  union all select 'category', category, least(count(*), 250), count(*) from soon group by category),
i as (select *, case when kind = 'town' then 'in/' || replace(lower(key), '_', '-') || '/' else trim(regexp_replace(lower(key), '[^a-z0-9]+', '-', 'g'), '-') || '/' end as path from n)"""


def _index(spark, folder) -> DataFrame:
    e = listings(spark, folder).withColumns({"time": F.lit(None).cast("string"), "title": F.col("venue"), "fingerprint": F.col("id")})
    return L.page_index(e, AS_OF)


@query(_PAGES + " select kind, key, page_rows, path from i")
def page_index(spark, folder):
    return _index(spark, folder)


@query(_PAGES + " select kind, key, page_rows, path, (row_number() over (partition by kind order by page_rows desc, key))::int as position from i qualify kind = 'category' or position <= 12")
def nav_links(spark, folder):
    return L.nav_links(_index(spark, folder))


@query("select count(distinct split_part(coalesce(source, ''), ':', 1)) as source_count from documents")
def source_count(spark, folder):
    return L.source_count(_read(spark, folder, "documents").withColumn("source", F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))))


@query(_LISTINGS + f"""select count(*) filter (where {_LIVE} and cust % 3 > 0) as live, count(distinct town) filter (where {_LIVE} and cust % 3 > 0) as towns, count(*) filter (where cust % 3 = 0) as pending from ev""")
def snapshot_stats(spark, folder):
    return L.stats(listings(spark, folder).withColumn("approved", F.col("cust") % 3 > 0), AS_OF)


@query("""with e as (select 'f' || p_partkey as f, 's' || p_partkey as s from part), a as (select case when c_custkey % 3 = 0 then 'f' else 's' end || c_custkey as id from customer)
select a.id, e.f as fingerprint from a left join e on a.id = e.f or a.id = e.s""")
def shared_links(spark, folder):
    e = _read(spark, folder, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("fingerprint"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"))
    key = F.col("c_custkey")
    return L.resolve_share(e, _read(spark, folder, "customer").select(F.concat(F.when(key % 3 == 0, "f").otherwise("s"), key.cast("string")).alias("id")))


@query("""with s as (select c_custkey as id, c_nationkey as town, date '2024-01-01' + (c_custkey % 50)::int as day, p_name as t from customer join part on p_partkey = c_custkey),
e as (select p_partkey as fingerprint, p_size % 25 as town, date '2024-01-01' + (p_partkey % 50)::int as first, date '2024-01-01' + (p_partkey % 50 + p_partkey % 4)::int as last, p_name as t from part)
select id, fingerprint from s join e on s.town = e.town and s.day between e.first and e.last where s.t = e.t or contains(s.t, e.t) or contains(e.t, s.t)
 or len(list_intersect(string_split(s.t, ' '), string_split(e.t, ' '))) / len(list_distinct(list_concat(string_split(s.t, ' '), string_split(e.t, ' ')))) >= 0.6""")
def submission_duplicates(spark, folder):
    c, p = _read(spark, folder, "customer"), _read(spark, folder, "part")
    base = F.lit(dt.date(2024, 1, 1))
    day = lambda k, n: F.date_add(base, (F.col(k) % n).cast("int"))
    s = c.join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.initcap("p_name").alias("title"), F.concat(F.lit("Town "), F.col("c_nationkey").cast("string")).alias("town"), day("c_custkey", 50).alias("start"))
    e = p.select(F.col("p_partkey").alias("fingerprint"), F.col("p_name").alias("title"), F.concat(F.lit("TOWN "), (F.col("p_size") % 25).cast("string")).alias("town"), day("p_partkey", 50).alias("start"), F.date_add(base, (F.col("p_partkey") % 50 + F.col("p_partkey") % 4).cast("int")).alias("end"))
    return L.find_duplicates(s, e)


# --- snapshot maintenance

@query(_LISTINGS + """select id from ev where "end" >= :as_of - 2 or ("end" is null and start >= :as_of - 2) or cust % 50 = 0""")
def prune_past(spark, folder):
    e = listings(spark, folder).withColumn("submitted_by", F.when(F.col("cust") % 50 == 0, "someone"))
    return resolve.prune_past(e, F.lit(AS_OF)).select("id")


@query("""select p_partkey from part where p_partkey % 6 > 2 or p_partkey % 7 = 0""")
def drop_nonevents(spark, folder):
    k = F.col("p_partkey")
    title = F.when(k % 6 == 0, F.concat(F.lit("Réunion "), "p_name")).when(k % 6 == 1, F.concat("p_name", F.lit(" : RÉINSCRIPTIONS"))).when(k % 6 == 2, F.concat(F.lit("Assemblée générale "), "p_name")).otherwise(F.concat(F.lit("Concert "), "p_name"))
    return resolve.drop_nonevents(_read(spark, folder, "part").select("p_partkey", title.alias("title"), F.when(k % 7 == 0, "someone").alias("submitted_by"))).select("p_partkey")


@query(
    _LISTINGS
    + """, r as (select *, cust % 9 = 0 as sent, 'v' || (cust % 4) as hall, case when id % 3 = 0 then 'u' || id end as url, repeat('n', (id % 6)::int) as note from ev),
g as (select *, count(*) over w > 1 and bool_or(sent) over w as merge from r window w as (partition by start, town, hall)),
m as (select arg_min(id, (sent, id)) as id, arg_min(url, (sent, id)) filter (where url is not null) as url, arg_min(note, (-length(note), sent, id)) as note, count(*) as n from g where merge group by start, town, hall)
select id, url, note from g where not merge union all select id, url, note from m"""
)
def venue_duplicates(spark, folder):
    e = listings(spark, folder).drop("venue", "price")
    e = e.withColumns({"fingerprint": F.col("id"), "venue": F.concat(F.lit("V"), (F.col("cust") % 4).cast("string"), F.lit(", floor 1")), "submitted_by": F.when(F.col("cust") % 9 == 0, "someone"), "url": F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), F.col("id").cast("string")))})
    e = _filled(e.withColumns({"note": F.repeat(F.lit("n"), (F.col("id") % 6).cast("int")), "sources": F.array(F.lit("s")), "first_seen": F.lit(NOW)}))
    return resolve.collapse_venue_duplicates(e).select("id", "url", "note")


_SENT = "with s as (select c_custkey as id, c_custkey % 4 = 0 as approved, 't' || (c_custkey % 300) as token, c_name as email from customer)"


def _sent(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, folder, "customer").select(key.alias("id"), (key % 4 == 0).alias("approved"), F.concat(F.lit("t"), (key % 300).cast("string")).alias("token"), F.upper("c_name").alias("email"), (key % 8 == 0).alias("published"), (key % 5 == 0).alias("email_verified"), key.cast("string").alias("fingerprint"), F.lit(NOW).alias("first_seen"))


@query(_SENT + " select id, approved or id = 7 as approved from s where id <> 9 or approved")
def review(spark, folder):
    """One pending row approved, one rejected."""
    return resolve.reject(resolve.approve(_sent(spark, folder), "7"), "9").select("id", "approved")


@query(_SENT + " select id, row_number() over (order by id::varchar) as position from s where not approved")
def pending_rows(spark, folder):
    return numbered(resolve.pending(_sent(spark, folder)), [], ["first_seen", "fingerprint"]).select("id", "position")


@query(_SENT + " select id, approved or id < 100 as approved from s")
def trusted_senders(spark, folder):
    s = _sent(spark, folder)
    return resolve.approve_trusted(s, s.where("id < 100").select(F.lower("email").alias("email")).unionByName(s.where("id < 5").select("email"))).select("id", "approved")


@query(_SENT + " select id, id % 8 = 0 or id in (select o_custkey from orders) as published, id % 5 = 0 or token = 't11' as email_verified from s")
def write_back(spark, folder):
    events = _read(spark, folder, "orders").select(F.col("o_custkey").alias("submitted_by"))
    return resolve.confirm_submission(resolve.mark_published(_sent(spark, folder), events), "t11").select("id", "published", "email_verified")


@query("""select c_custkey as id, case when c_custkey % 40 = 3 then timestamp '1997-01-01' when c_custkey % 20 = 3 and c_custkey % 3 = 0 then timestamp '1998-06-01 12:00:00' end as unsubscribed_at from customer""")
def unsubscribe(spark, folder):
    key = F.col("c_custkey")
    m = _read(spark, folder, "customer").select(key.alias("id"), F.concat(F.lit("t"), (key % 20).cast("string")).alias("token"), F.when(key % 3 == 0, "hello").otherwise("correction").alias("kind"), F.when(key % 40 == 3, F.lit(dt.datetime(1997, 1, 1)).cast("timestamp_ntz")).alias("unsubscribed_at"))
    return resolve.unsubscribe(m, "t3", F.lit(NOW).cast("timestamp_ntz")).select("id", "unsubscribed_at")


@query(
    """with e as (select p_partkey as id, p_name as name, p_brand as town, date '2024-01-01' + (p_partkey % 30)::int as day, p_partkey % 5 = 0 as own from part)
select id, name as title, own or hit as cancelled, case when note is not null then note when own then 'Annulé' end as cancel_note
from (select *, town = 'Brand#1' and day = date '2024-01-06' and name like '%red%' or town = 'Brand#2' and day = date '2024-01-08' as hit,
  case when town = 'Brand#2' and day = date '2024-01-08' then case when name like '%ring%' then 'storm' end when town = 'Brand#1' and day = date '2024-01-06' and name like '%red%' then 'rain' end as note from e)"""
)
def mark_cancelled(spark, folder):
    k = F.col("p_partkey")
    title = F.when((k % 5 == 0) & (k % 2 == 0), F.concat(F.lit("[ANNULÉ] - "), "p_name")).when(k % 5 == 0, F.concat(F.lit("Cancelled: "), "p_name")).otherwise(F.col("p_name"))
    e = _read(spark, folder, "part").select(k.alias("id"), k.cast("string").alias("fingerprint"), title.alias("title"), F.col("p_brand").alias("town"), F.date_add(F.lit(dt.date(2024, 1, 1)), (k % 30).cast("int")).alias("start"))
    told = [("Red", "Brand#1", dt.date(2024, 1, 6), "rain"), ("", "Brand#2", dt.date(2024, 1, 8), None), ("ring", "Brand#2", dt.date(2024, 1, 8), "storm")]
    return rules.mark_cancelled(e, spark.createDataFrame(told, "needle string, town string, date date, note string")).select("id", "title", "cancelled", "cancel_note")


# --- sequences

@query(
    """with recursive d as (select distinct user_id, event_type, ts::date as day from events),
r as (select *, case when extract(day from day)::int % 4 = 1 then null else 'u' || extract(day from day)::int // 3 end as url, row_number() over (partition by user_id, event_type order by day) as n from d),
f as (select user_id, event_type, n, day, 1 as block, day as reach, case when url is null then [] else [url] end as urls from r where n = 1
  union all select r.user_id, r.event_type, r.n, r.day, case when c.go then f.block else f.block + 1 end, r.day, case when c.go then list_distinct(list_concat(f.urls, case when r.url is null then [] else [r.url] end)) when r.url is null then [] else [r.url] end
  from f join r on r.user_id = f.user_id and r.event_type = f.event_type and r.n = f.n + 1, lateral (select r.day - f.reach <= 1 and (r.url is null or list_contains(f.urls, r.url)) as go) c)
select user_id, event_type, min(day) as first, max(day) as last, count(*) as nights from f group by user_id, event_type, block"""
)
def consecutive_blocks(spark, folder):
    """Nights in a row under one url."""
    d = _read(spark, folder, "events").select("user_id", "event_type", F.to_date("ts").alias("start")).distinct()
    n = F.dayofmonth("start")
    url = F.when(n % 4 != 1, F.concat(F.lit("u"), F.floor(n / 3).cast("string")))
    e = d.withColumns({"end": F.lit(None).cast("date"), "url": url, "fingerprint": F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("start").cast("string"))})
    b = sequences.consecutive_blocks(e, ["user_id", "event_type"])
    return b.groupBy("user_id", "event_type", "block").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count(F.lit(1)).alias("nights")).drop("block")


@query(
    _LISTINGS
    + """, m as (select *, coalesce("end", start) as last, cust % 60 as act from ev),
f as (select *, case when start > max(last) over w or max(last) over w is null then 1 else 0 end as new from m window w as (partition by act, town order by start, last, id::varchar rows between unbounded preceding and 1 preceding)),
g as (select *, sum(new) over (partition by act, town order by start, last, id::varchar rows unbounded preceding) as n from f),
k as (select arg_min(id, (start, last, id::varchar)) as id, min(start) as start, max(last) as last, arg_min(venue, (start, last, id::varchar)) as venue, bool_or(id % 10 = 0) as free from g group by act, town, n)
select id, start, case when last > start then last end as "end", venue, free from k"""
)
def merged_overlaps(spark, folder):
    e = _filled(listings(spark, folder).withColumns({"fingerprint": F.col("id").cast("string"), "free": F.col("id") % 10 == 0, "title": F.concat(F.lit("Show "), (F.col("cust") % 60).cast("string"))}))
    return sequences.collapse_overlaps(e).select("id", "start", "end", "venue", "free")


@query("""with s as (select c_custkey, 1 + c_custkey % 9 as a, 12 + c_custkey % 5 as b, 20 + c_custkey % 8 as z from customer)
select c_custkey, unnest(list_concat([a, b], case when z - b > 0 then range(b + 1, z + 1) else [] end))::int as day from s""")
def day_lists(spark, folder):
    k = F.col("c_custkey")
    line = F.format_string("%d et %d au %d", 1 + k % 9, 12 + k % 5, 20 + k % 8)
    return _read(spark, folder, "customer").select("c_custkey", F.explode(sequences.day_list(line)).alias("day"))


# --- data quality

@query(
    _LISTINGS
    + """, b as (select id, 'past' as rule from ev where coalesce("end", start) < :as_of union all select id, 'false_midnight' from ev where cust % 7 = 0 union all select id, 'empty_note' from ev where cust % 3 = 0
  union all select id, 'price_says_free' from ev where cust % 2 = 0 and cust % 5 > 0 union all select id, 'free_with_price' from ev where cust % 5 = 0 and cust % 3 = 1
  union all (select id, 'duplicate' from ev qualify row_number() over (partition by cust, start, venue order by id::varchar) > 1)),
n as (select *, row_number() over (partition by rule order by id::varchar) as k from b)
select rule, count(*) as n, list(id::varchar order by id::varchar) filter (where k <= 40) as examples from n group by rule"""
)
def quality_report(spark, folder):
    c = F.col("cust")
    e = listings(spark, folder).withColumns({"fingerprint": F.col("id").cast("string"), "title": c.cast("string"), "time": F.when(c % 7 == 0, "00:00"), "note": F.when(c % 3 == 0, " ").when(c % 3 == 1, "Tarif 12 euros").otherwise("x"), "free": c % 5 == 0, "price": F.when(c % 2 == 0, "Gratuit")})
    return Q.report(Q.event_violations(e, F.lit(AS_OF)))


@query(
    """with s as (select c_custkey as id, c_custkey % 7 as m from customer)
select id, case m when 0 then ['title_length'] when 1 then ['url_shape', 'time_shape'] when 2 then ['category_known'] when 3 then ['end_after_start'] when 4 then ['email_shape', 'not_approved'] when 5 then ['town_length', 'not_published'] else [] end as violations from s"""
)
def submission_rules(spark, folder):
    m = F.col("c_custkey") % 7
    day = F.lit(dt.date(2024, 5, 5))
    s = _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.when(m == 0, " ab ").otherwise("A title").alias("title"), F.when(m == 5, "N").otherwise("Nice").alias("town"), F.lit(None).cast("string").alias("venue"), F.lit("note").alias("note"), F.when(m == 1, "ftp://x").when(m == 2, "https://x").alias("url"),
        F.when(m == 1, "24:00").when(m == 2, "23:59").alias("time"), F.when(m == 2, "party").otherwise("danse").alias("category"), day.alias("start_date"), F.when(m == 3, F.date_sub(day, 1)).when(m == 4, day).alias("end_date"), F.when(m == 4, "a@b").otherwise("a@b.org").alias("email"), (m == 4).alias("approved"), (m == 5).alias("published"))
    return Q.with_violations(s, Q.submission_rules()).select("id", "violations")


@query("""select c_custkey as id, case c_custkey % 4 when 0 then ['kind_known'] when 1 then ['body_length'] when 2 then ['has_content'] else ['email_shape'] end as violations from customer""")
def message_rules(spark, folder):
    m = F.col("c_custkey") % 4
    s = _read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.when(m == 0, "praise").otherwise("removal").alias("kind"), F.when(m == 0, "b").when(m == 1, F.repeat(F.lit("x"), 4001)).alias("body"), F.when(m == 3, "nobody").alias("email"))
    return Q.with_violations(s, Q.message_rules()).select("id", "violations")


@query("""select 'in' || y as name, 0::bigint as filled from range(1985, 2010) t(y) where y not in (select year(l_shipdate) from lineitem where l_shipdate is not null)""")
def unused_columns(spark, folder):
    years = {f"in{y}": F.when(F.year("l_shipdate") == y, F.col("l_quantity")) for y in range(1985, 2010)}
    return Q.unused_columns(_read(spark, folder, "lineitem").select(*[c.alias(n) for n, c in years.items()]), list(years))


@query("select event_id, timestamp '2024-01-20 12:00:00' - ts > interval 48 hour as stale from events")
def stale_feeds(spark, folder):
    return _read(spark, folder, "events").select("event_id", Q.stale_feed(F.col("ts").cast("timestamp_ntz"), F.lit(dt.datetime(2024, 1, 20, 12)).cast("timestamp_ntz")).alias("stale"))


# --- columns

@query("""select p_partkey, 'hall-' || p_size as core, case when p_partkey % 2 = 0 then p_name || ' hall' else p_name || ' room' end as longer, p_partkey % 4 <> 1 as commune, p_partkey % 3 = 0 as free,
 'a &lt;' || p_name || '&gt; &amp; &quot;b&quot;' as escaped from part""")
def small_texts(spark, folder):
    k = F.col("p_partkey")
    old, new = F.concat("p_name", F.lit(" hall")), F.when(k % 2 == 0, F.concat("p_name", F.lit(" halL"))).otherwise(F.concat("p_name", F.lit(" room")))
    longer = F.when(k % 2 == 0, T.richer(new, old)).otherwise(T.richer(new, F.lit("")))
    free = F.when(k % 3 == 0, "Entrée libre").otherwise("Tarif : 12 €")
    town = F.when(k % 4 == 1, "Salle des fêtes").otherwise("Nice")
    return _read(spark, folder, "part").select("p_partkey", T.venue_core(F.concat(F.lit("HALL "), F.col("p_size").cast("string"), F.lit(", rue X"))).alias("core"), longer.alias("longer"), T.looks_like_commune(town).alias("commune"), T.says_free(free).alias("free"), T.html_escape(F.concat(F.lit("a <"), "p_name", F.lit('> & "b"'))).alias("escaped"))


@query("""select o_orderkey, strftime(o_orderdate, '%-d %b') as short_day, strftime(o_orderdate, '%A %-d %B') as long_day, 'until ' || strftime(o_orderdate, '%-d %b') as until,
 (o_orderdate::date + (13 - isodow(o_orderdate)::int) % 7)::date as saturday,
 case when month(o_orderdate) >= 9 then 2025 else 2026 end as season, o_orderdate::date as iso_day, '20:30' as iso_time from orders""")
def day_columns(spark, folder):
    d = F.to_date("o_orderdate")
    saturday, _ = D.weekend(d)
    day, clock = D.iso_parts(F.concat(d.cast("string"), F.lit("T20:30:00")))
    return _read(spark, folder, "orders").select("o_orderkey", D.short_day(d).alias("short_day"), D.long_day(d).alias("long_day"), D.until(d).alias("until"), saturday.alias("saturday"), D.season_year(F.month(d), F.lit(2025)).cast("int").alias("season"), day.alias("iso_day"), clock.alias("iso_time"))


# --- documents

@query(_LISTINGS + f"""select '{{"id":' || id || ',"start":"' || start || '"' || case when "end" is null then '' else ',"end":"' || "end" || '"' end || ',"town":"' || town || '"}}' as json, id from ev where {_LIVE}""")
def feed_lines(spark, folder):
    e = listings(spark, folder).where(L.live(F.lit(AS_OF))).select("id", "start", "end", "town")
    return sinks.feed_lines(e, ["id"])


@query(_PAGES + """ select '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10)
 || string_agg('  <url><loc>https://x/' || path || '</loc><lastmod>1998-06-01</lastmod></url>', chr(10) order by path) || chr(10) || '</urlset>' || chr(10) as xml from i""")
def sitemap(spark, folder):
    return sinks.sitemap_document(sinks.sitemap_lines(_index(spark, folder), "https://x", F.lit(AS_OF)))


@query("""with n as (select event_id, event_type, ts::date as day from events where ts::date between date '2024-01-20' and date '2024-01-25'),
s as (select * from n order by day, event_type, event_id limit 24), t as (select count(*) as total from n)
select total || ' new events' as subject, '<div>' || string_agg(b, '' order by day) || '<p>' || (any_value(total) - 24) || ' more on the site</p><p><a href="https://x">All events</a> · <a href="https://x/u">Unsubscribe</a></p></div>' as html
from (select day, '<h2>' || strftime(day, '%A %-d %B') || '</h2><ul>' || string_agg('<li><b>' || event_id || '</b> ' || event_type || '</li>', '' order by event_id::varchar) || '</ul>' as b from s group by day), t group by total""")
def digest_mail(spark, folder):
    e = _read(spark, folder, "events").select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("title"), F.to_date("ts").alias("start"), F.lit(None).cast("date").alias("end"), F.col("ts").alias("first_seen"), F.col("event_type").alias("town"), F.lit(True).alias("approved"), F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("venue"), F.lit(False).alias("free"), F.col("event_id").alias("fingerprint"))
    shown, total = L.digest(e.where(F.col("start") <= F.lit(dt.date(2024, 1, 25))), dt.datetime(2024, 1, 1), dt.date(2024, 1, 20))
    plain = shown.withColumn("title", F.col("title").cast("long").cast("string"))
    return sinks.digest_message(plain, total, "https://x", "https://x/u").select("subject", "html")


@query("""select event_id, (props->>'$.k')::int as k, 'deep' as name from events""")
def nested_objects(spark, folder):
    """Objects at the fourth level of a document, by the walk that finds them at any depth."""
    text = F.concat(F.lit('{"a":[{"b":{"name":"deep","p":'), "props", F.lit("}}]}"))
    found = jsonld.objects(_read(spark, folder, "events").select("event_id", text.alias("json")))
    return found.where(jsonld.get("$.name") == "deep").select("event_id", jsonld.get("$.p.k", "int").alias("k"), jsonld.get("$.name").alias("name"))


@query("""with n as (select distinct p_name as name from part union select distinct split_part(p_name, ' ', 2) from part), t as (select p_partkey as id, 'au ' || lower(p_type) || ' ' || case when p_size % 3 = 0 then split_part(p_name, ' ', 1) else p_name end as text from part)
select id, (select name from n where contains(' ' || text || ' ', ' ' || name || ' ') order by length(name) - length(replace(name, ' ', '')) desc, position(' ' || name || ' ' in ' ' || text || ' ') limit 1) as place from t""")
def named_places(spark, folder):
    """Names of parts, and their second words, in texts: the longest that a text names."""
    p = _read(spark, folder, "part")
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    names = p.select(F.col("p_name").alias("name")).union(p.select(second)).distinct()
    shown = F.when(F.col("p_size") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    texts = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Au "), F.initcap("p_type"), F.lit(", "), F.upper(shown)).alias("text"))
    return gazetteer.named_places(texts, names.withColumn("place", F.col("name"))).select("id", "place")
