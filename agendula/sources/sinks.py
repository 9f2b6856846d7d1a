"""What is published: feed and source report as JSON, structured data, sitemap, calendar entries, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed as X
from ..functions import text as T

CRLF = "\r\n"


def event_json(columns: list[str]) -> Column:
    """An event without nulls, false flags and empty texts."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def feed_lines(events: DataFrame, order: list[str]) -> DataFrame:
    """(order columns, json): the feed's events as lines in a global order of ranges, for a writer that adds the frame around them."""
    return events.select(*order, event_json(events.columns).alias("json")).orderBy(*order)


def feed_document(events: DataFrame, generated: Column, order: list[str]) -> DataFrame:
    """One row (json): generated, count and the events. For a published feed, whose size is bounded by the build."""
    body = F.struct(*[F.col(c) for c in events.columns])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, body.alias("e")))), lambda x: x["e"])
    return events.agg(listed.alias("events")).select(F.to_json(F.struct(F.date_format(generated, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated"), F.size("events").alias("count"), "events")).alias("json"))


def page_json(events: DataFrame, order: list[str]) -> DataFrame:
    """The feed as it stands inside a page: without source and recurring, safe in a script element."""
    e = events.drop("source", "recurring")
    return feed_document(e, F.lit("1970-01-01").cast("timestamp_ntz"), order).select(T.script_escape(F.get_json_object("json", "$.events")).alias("json"))


def event_ld(base: str, region: str) -> Column:
    """A schema.org Event of a published row; only what the row holds."""
    venue = F.coalesce(F.nullif(F.col("venue"), F.lit("")), "town")
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.col("town").alias("addressLocality"), F.lit(region).alias("addressRegion"), F.lit("FR").alias("addressCountry"))
    place = F.struct(F.when(F.col("online"), "VirtualLocation").otherwise("Place").alias("@type"), F.when(F.col("online"), F.coalesce("url", F.lit(base + "/"))).alias("url"), F.when(~F.col("online"), venue).alias("name"), F.when(~F.col("online"), address).alias("address"))
    mode = F.when(F.col("online"), "Online").otherwise("Offline")
    return F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), D.ld_datetime(F.col("start"), F.col("time")).alias("startDate"),
        F.concat(F.lit("https://schema.org/Event"), F.when(F.col("cancelled"), "Cancelled").otherwise("Scheduled")).alias("eventStatus"), F.when(F.col("end") > F.col("start"), F.col("end").cast("string")).alias("endDate"),
        F.concat(F.lit("https://schema.org/"), mode, F.lit("EventAttendanceMode")).alias("eventAttendanceMode"), place.alias("location"), F.col("note").alias("description"), F.concat(F.lit(f"{base}/?e="), "slug").alias("url"),
        F.when(F.col("image").startswith("http"), F.col("image")).alias("image"), F.when(F.col("free"), F.lit(True)).alias("isAccessibleForFree"))


def structured_data(events: DataFrame, as_of: Column, base: str, region: str, days: int = X.LD_DAYS, rows: int = X.LD_ROWS) -> DataFrame:
    """One row (json): the soonest events as an array, safe in a script element."""
    soon = events.where((F.col("start") >= as_of) & (F.col("start") <= F.date_add(as_of, days))).orderBy("start", "title", "fingerprint").limit(rows)
    item = F.struct("start", "title", "fingerprint", event_ld(base, region).alias("ld"))
    return soon.agg(F.array_sort(F.collect_list(item)).alias("x")).select(T.script_escape(F.to_json(F.transform("x", lambda i: i["ld"]))).alias("json"))


def item_list(rows: DataFrame, base: str, region: str, most: int = X.PAGE_LD_ROWS) -> DataFrame:
    """(kind, key, json): each page's first events as a list with positions from 1."""
    item = F.struct("position", F.struct(F.lit("ListItem").alias("@type"), "position", event_ld(base, region).alias("item")).alias("li"))
    listed = rows.where(F.col("position") <= most).groupBy("kind", "key").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select("kind", "key", T.script_escape(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.transform("x", lambda i: i["li"]).alias("itemListElement")))).alias("json"))


def sitemap_lines(paths: DataFrame, base: str, day: Column) -> DataFrame:
    """One line an address."""
    return paths.select(F.concat(F.lit(f"  <url><loc>{base}/"), T.html_escape(F.col("path")), F.lit("</loc><lastmod>"), day.cast("string"), F.lit("</lastmod></url>")).alias("line"))


def sitemap_document(lines: DataFrame) -> DataFrame:
    """One row (xml): the lines of all addresses in a frame. For a site, whose pages are bounded by its towns and categories."""
    body = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("b"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n')
    return body.select(F.concat(head, "b", F.lit("\n</urlset>\n")).alias("xml"))


def sources_document(report: DataFrame) -> DataFrame:
    """One row (json): the report of sources as an array, by name. It has a row a registered source."""
    item = F.struct("name", *[c for c in report.columns if c != "name"])
    return report.agg(F.to_json(F.array_sort(F.collect_list(item)), {"ignoreNullFields": "false"}).alias("json"))


def digest_message(shown: DataFrame, total: DataFrame, site: str, unsubscribe: str) -> DataFrame:
    """One row (subject, text, html): the mail of what is new, for one recipient's address to unsubscribe at. The digest holds a bounded number of rows."""
    esc = lambda c: T.html_escape(F.col(c))
    free = F.when(F.col("free"), "free")
    row = F.concat(F.lit("<li><b>"), esc("title"), F.lit("</b> "), F.concat_ws(" · ", esc("venue"), esc("town"), esc("time"), free), F.lit("</li>"))
    days = shown.groupBy("start").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("start", F.concat(F.lit("<h2>"), D.long_day(F.col("start")), F.lit("</h2><ul>"), "rows", F.lit("</ul>")).alias("b")))), lambda x: x["b"])
    out = days.agg(F.array_join(blocks, "").alias("body")).crossJoin(digest_text(shown)).crossJoin(total)
    more = F.when(F.col("more") > 0, F.format_string("%d more on the site", "more"))
    subject = F.when(F.col("total") == 1, "One new event").otherwise(F.format_string("%d new events", "total"))
    text = F.concat_ws("\n\n", "text", more, F.lit(site), F.lit(f"Unsubscribe: {unsubscribe}"))
    page = F.concat(F.lit("<div>"), "body", F.coalesce(F.concat(F.lit("<p>"), more, F.lit("</p>")), F.lit("")), F.lit(f'<p><a href="{site}">All events</a> · <a href="{unsubscribe}">Unsubscribe</a></p></div>'))
    return out.select(subject.alias("subject"), text.alias("text"), page.alias("html"))


def ics_event(uid: Column, title: Column, start: Column, end: Column, time: Column, place: Column) -> Column:
    """A calendar entry: timed ones last two hours, others to the day after their last."""
    escape = lambda c: F.regexp_replace(F.regexp_replace(c, r"([\\,;])", r"\\$1"), r"\r?\n", r"\\n")
    begin = F.try_to_timestamp(F.concat_ws(" ", start.cast("string"), time), F.lit("yyyy-MM-dd HH:mm"))
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    whole = [F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(start, "yyyyMMdd")), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(F.coalesce(end, start), 1), "yyyyMMdd"))]
    timed = [F.concat(F.lit("DTSTART:"), stamp(begin)), F.concat(F.lit("DTEND:"), stamp(begin + F.expr("interval 2 hours")))]
    pick = lambda i: F.when(time.isNotNull() & begin.isNotNull(), timed[i]).otherwise(whole[i])
    return F.concat_ws(CRLF, F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("SUMMARY:"), escape(title)), pick(0), pick(1), F.concat(F.lit("LOCATION:"), escape(place)), F.lit("END:VEVENT"))


def digest_text(shown: DataFrame) -> DataFrame:
    """One row (text): what is new, day by day. The digest holds a bounded number of rows."""
    line = F.concat_ws(" · ", F.concat(F.lit("  "), "title"), "time", "town", F.when(F.col("free"), "free"))
    days = shown.groupBy("start").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    block = F.concat_ws("\n", D.long_day(F.col("start")), F.array_join("lines", "\n"))
    return days.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def write_pages(rows: DataFrame, folder: str) -> None:
    """Rows of landing pages, a folder a page."""
    rows.write.mode("overwrite").partitionBy("kind", "key").json(folder)


def write_snapshot(events: DataFrame, folder: str, version: int) -> str:
    """A new version of the snapshot in a folder of its own; readers take the last one that is whole."""
    path = f"{folder}/v{version:08d}"
    events.write.parquet(path)
    return path


def append_runs(runs: DataFrame, folder: str) -> None:
    runs.write.mode("append").parquet(folder)
