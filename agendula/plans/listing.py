"""Listing queries over events: what is on, facets, standing runs, towns, pages, digest, source report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed as X
from ..functions import text as T
from ..operators import similarity as S
from ..operators.sequences import occurrences

FOREVER = dt.date(2099, 12, 31)


def live(as_of: Column) -> Column:
    """Not over yet. Written so that both branches reach the scan as pushed filters."""
    return (F.col("end") >= as_of) | (F.col("end").isNull() & (F.col("start") >= as_of))


def published(events: DataFrame, as_of: dt.date, days: int | None = None, approved_only: bool = True) -> DataFrame:
    out = events.where(live(F.lit(as_of)))
    if days:
        out = out.where(F.col("start") <= F.lit(as_of + dt.timedelta(days)))
    return out.where("approved") if approved_only else out


def upcoming(events: DataFrame, as_of: dt.date, days: int | None = None, approved_only: bool = True) -> DataFrame:
    return published(events, as_of, days, approved_only).orderBy("start", "town", "title", "fingerprint")


def new_since(events: DataFrame, moment, as_of: dt.date) -> DataFrame:
    return events.where(live(F.lit(as_of)) & (F.col("first_seen") > F.lit(moment)) & F.col("approved")).orderBy("start", "town", "title", "fingerprint")


@dataclass(frozen=True)
class ListingQuery:
    """What a visitor asks for; empty sets mean everything. ``first`` and ``last`` default to today and forever."""

    as_of: dt.date
    first: dt.date | None = None
    last: dt.date = FOREVER
    towns: frozenset[str] = field(default_factory=frozenset)
    categories: frozenset[str] = field(default_factory=frozenset)
    online: bool = False
    free: bool = False
    text: str = ""


@dataclass(frozen=True)
class Listing:
    feed: DataFrame
    standing: DataFrame
    facets: DataFrame


def is_standing() -> Column:
    return (F.col("category") == "expo") & F.col("end").isNotNull() & (F.col("end") != F.col("start"))


def search(events: DataFrame, q: ListingQuery) -> DataFrame:
    """The events that all filters but the category's let pass."""
    first, last = F.lit(q.first or q.as_of), F.lit(q.last)
    out = events.where((F.col("start") <= last) & ((F.col("end") >= first) | (F.col("end").isNull() & (F.col("start") >= first))))
    if q.towns:
        out = out.where(F.col("town").isin(sorted(q.towns)))
    if not q.online:
        out = out.where(~F.col("online"))
    if q.free:
        out = out.where("free")
    if q.text.strip():
        out = out.where(F.lower(F.concat_ws(" ", "title", "town", F.coalesce("venue", F.lit("")), F.coalesce("note", F.lit("")))).contains(q.text.strip().lower()))
    return out


def listing(events: DataFrame, q: ListingQuery) -> Listing:
    """Day by day feed, standing exhibitions, and counts by category of all that the other filters let pass."""
    base = search(events, q)
    chosen = base.where(F.col("category").isin(sorted(q.categories))) if q.categories else base
    days = occurrences(F.col("start"), F.col("end"), F.lit(q.first or q.as_of), F.lit(q.last), F.lit(q.as_of), F.lit(bool(q.categories)))
    feed = chosen.where(~is_standing()).withColumn("day", F.explode(days))
    slot = F.coalesce(F.nullif(F.nullif(F.col("time"), F.lit("00:00")), F.lit("")), F.lit("99:99"))
    feed = feed.orderBy("day", slot, F.collate("town", "fr"), "title", "fingerprint")
    show = not q.categories or "expo" in q.categories
    standing = base.where(is_standing() if show else F.lit(False)).orderBy("end", F.collate("town", "fr"), "title", "fingerprint")
    return Listing(feed, standing, base.groupBy("category").agg(F.count(F.lit(1)).alias("n")))


def tallies(events: DataFrame, q: ListingQuery) -> DataFrame:
    """Numbers above the list: listings, standing runs, and what is on within a week."""
    base = search(events, q)
    chosen = F.col("category").isin(sorted(q.categories)) if q.categories else F.lit(True)
    week = search(events, ListingQuery(q.as_of, last=q.as_of + dt.timedelta(7), online=q.online, free=q.free)).agg(F.count(F.lit(1)).alias("week"))
    return base.agg(F.count_if(chosen & ~is_standing()).alias("listings"), F.count_if(is_standing()).alias("standing")).crossJoin(week)


def badges(as_of: Column) -> dict[str, Column]:
    """ends: over within 10 days; new: first seen within 7."""
    return {"ends": is_standing() & F.datediff("end", as_of).between(0, 10), "new": F.datediff(as_of, F.to_date("first_seen")) <= 7}


def preview_size(n: int, closing: int) -> int:
    return min(n, max(3, min(8, closing)))


def town_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("town").agg(F.count(F.lit(1)).alias("n"))


def top_towns(events: DataFrame, k: int = 5) -> DataFrame:
    return town_counts(events).orderBy(F.desc("n"), "town").limit(k)


def rest_towns(events: DataFrame, k: int = 5) -> DataFrame:
    """Every other town, by name."""
    return town_counts(events).join(top_towns(events, k).select("town"), "town", "left_anti").orderBy("town")


def find_duplicates(submitted: DataFrame, events: DataFrame, least: float = 0.6) -> DataFrame:
    """(submission id, fingerprint): events on the day and in the town of a submission whose title is as similar."""
    month = lambda d: F.trunc(d, "month")
    place = T.fold(F.col("town"), True).alias("key")
    s = submitted.select("id", S.folded(F.col("title")).alias("text"), place, "start").where("start is not null")
    e = events.select("fingerprint", S.folded(F.col("title")).alias("like"), place, "start", F.coalesce("end", "start").alias("last")).where("start <= last")
    months = F.sequence(month("start"), month("last"), F.expr("interval 1 month"))
    # Titles are compared once a town and month, however many rows bear them; folded texts hold no control character.
    titles = lambda d, c, m: d.select("key", m.alias("month"), F.col(c).alias("text")).distinct().withColumn("id", F.concat_ws("\x1f", "key", F.col("month").cast("string"), "text"))
    alike = S.similar(titles(s, "text", month("start")), titles(e, "like", F.explode(months)), ["key", "month"], least)
    alike = alike.select(F.col("a.key").alias("key"), F.col("a.month").alias("month"), F.col("a.text").alias("text"), F.col("b.text").alias("like"))
    # Rows meet by title and day; a run of more than a month stands in each of its months instead.
    long = F.datediff("last", "start") > 31
    short = e.where(~long).select("*", F.explode(F.sequence("start", "last")).alias("at"))
    long = e.where(long).select("*", F.explode(months).alias("at"))
    s = s.withColumn("month", month("start")).join(alike, ["key", "month", "text"]).select("id", "key", "like", "start")
    by_day = s.withColumn("at", F.col("start")).join(short.drop("start", "last"), ["key", "like", "at"]).select("id", "fingerprint")
    by_month = s.withColumn("at", month("start")).join(long.withColumnsRenamed({"start": "first"}), ["key", "like", "at"]).where(F.col("start").between(F.col("first"), F.col("last")))
    return by_day.unionByName(by_month.select("id", "fingerprint"))


def pages(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows of landing pages (kind, key, page_rows, position): towns that are communes with enough events, and categories; capped each."""
    soon = events.where(live(F.lit(as_of)) & (F.col("start") <= F.lit(as_of + dt.timedelta(X.PAGE_DAYS))))
    both = soon.select("*", F.explode(F.array(F.struct(F.lit("town").alias("kind"), F.col("town").alias("key")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("key")))).alias("p"))
    both = both.select("p.*", *events.columns)
    n = both.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("page_rows"))
    n = n.where((F.col("kind") == "category") | ((F.col("page_rows") >= X.PAGE_MIN) & T.looks_like_commune(F.col("key"))))
    order = Window.partitionBy("kind", "key").orderBy("start", F.asc_nulls_last(F.nullif(F.col("time"), F.lit("00:00"))), "title", "fingerprint")
    return both.join(n, ["kind", "key"]).withColumn("position", F.row_number().over(order)).where(F.col("position") <= X.PAGE_ROWS)


def page_index(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Pages, the biggest first within a kind, with their paths."""
    slug = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in X.CATEGORY_SLUGS.items() for x in kv]), F.col("key")), T.slugify(F.col("key")))
    path = F.when(F.col("kind") == "town", F.concat(F.lit("in/"), T.slugify(F.col("key")), F.lit("/"))).otherwise(F.concat(slug, F.lit("/")))
    return pages(events, as_of).where("position = 1").select("kind", "key", "page_rows", path.alias("path")).orderBy(F.desc("kind"), F.desc("page_rows"), "key")


def split_ongoing(events: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """What has begun already, the soonest to close first, with ``until``; and what begins today or later."""
    begun = events.where(F.col("start") < F.lit(as_of)).withColumn("until", D.until(F.col("end")))
    return begun.orderBy(F.coalesce("end", "start"), "title", "fingerprint"), events.where(F.col("start") >= F.lit(as_of))


def nav_links(index: DataFrame, towns: int = X.NAV_TOWNS) -> DataFrame:
    """Links between pages, from their index: the busiest towns, and every category (kind, key, page_rows, path, position)."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("page_rows"), "key"))
    return index.withColumn("position", place).where((F.col("kind") == "category") | (F.col("position") <= towns))


def source_count(events: DataFrame) -> DataFrame:
    """How many sources, by the name before the colon, brought the rows; counted before rows are merged."""
    return events.agg(F.count_distinct(_base_name(F.coalesce("source", F.lit("")))).alias("source_count"))


def _base_name(source: Column) -> Column:
    return F.split_part(source, F.lit(":"), F.lit(1))


def digest(events: DataFrame, since, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """What is new: the first rows to show (no submitter among the columns), and (total, more)."""
    new = new_since(events, since, as_of).where(F.col("start").between(F.lit(as_of), F.lit(as_of + dt.timedelta(X.DIGEST_DAYS))))
    shown = new.select("title", "start", "time", "town", "venue", "free").orderBy("start", "town", "title").limit(X.DIGEST_ROWS)
    total = new.agg(F.count(F.lit(1)).alias("total")).withColumn("more", F.greatest(F.lit(0), F.col("total") - X.DIGEST_ROWS))
    return shown, total


def recipients(subscribers: DataFrame) -> DataFrame:
    """One row an address, the first; without token nobody."""
    s = subscribers.where("token is not null").withColumn("email", F.lower(F.trim("email"))).where("email != ''")
    return s.withColumn("__n", F.row_number().over(Window.partitionBy("email").orderBy("created_at", "token"))).where("__n = 1").drop("__n")


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source, by one aggregation."""
    return runs.groupBy("scraper").agg(F.max_by(F.struct("started_at", "ok", "found", "added", "error"), "id").alias("r")).select("scraper", "r.*")


def source_report(events: DataFrame, runs: DataFrame, registry: list[str]) -> DataFrame:
    """Every registered, published or run source with its health; one that produced nothing shows as such."""
    spark = events.sparkSession
    known = spark.createDataFrame([(n,) for n in registry], "name string").withColumn("registered", F.lit(True))
    published = events.groupBy(_base_name(F.coalesce("source", F.lit("unknown"))).alias("name")).agg(F.count(F.lit(1)).alias("published"))
    out = known.join(published, "name", "full_outer").join(last_runs(runs).withColumnRenamed("scraper", "name"), "name", "full_outer")
    n = F.coalesce("published", F.lit(0))
    status = F.when(F.col("started_at").isNotNull() & ~F.col("ok"), "failed").when(n > 0, "ok").when(F.col("found") > 0, "stale").otherwise("empty")
    return out.select("name", status.alias("status"), n.alias("published"), "found", "added", F.col("started_at").alias("last_run"), F.nullif(F.col("error"), F.lit("")).alias("error"), F.coalesce("registered", F.lit(False)).alias("registered")).orderBy("name")


def stats(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Live approved rows, their towns, and what is pending."""
    return events.agg(F.count_if(live(F.lit(as_of)) & F.col("approved")).alias("live"), F.count_distinct(F.when(live(F.lit(as_of)) & F.col("approved"), F.col("town"))).alias("towns"), F.count_if(~F.col("approved")).alias("pending"))


def resolve_share(events: DataFrame, shared: DataFrame) -> DataFrame:
    """Shared ids (id) with the fingerprint they name: their own, else that of their slug."""
    own = events.select(F.col("fingerprint").alias("id"), F.col("fingerprint").alias("__own"))
    slug = events.select(F.col("slug").alias("id"), F.col("fingerprint").alias("__slug"))
    return shared.join(own, "id", "left").join(slug, "id", "left").select("id", F.coalesce("__own", "__slug").alias("fingerprint"))


def town_rows(texts: DataFrame, town: str = "town") -> DataFrame:
    """Rows that name no town get the one their location's text names."""
    from ..functions.cards import town_in_text

    return texts.withColumn(town, F.coalesce(F.nullif(F.col(town), F.lit("")), town_in_text(F.col("location"))))
