"""Calendar texts as rows, with functions on texts and arrays only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import recur

_KEYS = ("SUMMARY", "DTSTART", "DTEND", "LOCATION", "URL", "DESCRIPTION", "RRULE", "RECURRENCE-ID", "EXDATE", "STATUS")


#: Letters that have these as capitals.
_SMALL = {"I": "iı", "S": "sſ"}


def unfold(body: Column) -> Column:
    return F.when(body.contains("\n ") | body.contains("\n\t"), F.regexp_replace(body, r"\r?\n[ \t]", "")).otherwise(body)


def unescape(value: Column) -> Column:
    for old, new in (("\\,", ","), ("\\;", ";"), ("\\n", " "), ("\\N", " ")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def entries(body: Column) -> Column:
    """Array of entries, each a text of lines that a line feed begins."""
    return F.regexp_extract_all(F.replace(unfold(body), F.lit("\r\n"), F.lit("\n")), F.lit(r"(?is)BEGIN:VEVENT(\n.*?)END:VEVENT"), F.lit(1))


def _value(entry: Column, capitals: Column, key: str) -> Column:
    """The first value of a key (of EXDATE all), whose parameters are dropped; null if empty. A pattern is tried only where the capitals hold the key."""
    spelt = "".join(f"[{c}{_SMALL.get(c, c.lower())}]" if c.isalpha() else c for c in key).replace("[Ssſ][Tt]", "(?:[Ssſ][Tt]|[ﬅﬆ])")
    line = rf"\n{spelt}(?:;[^:\n]*)?:([^\n]*)"
    value = F.array_join(F.regexp_extract_all(entry, F.lit(line), F.lit(1)), ",") if key == "EXDATE" else unescape(F.regexp_extract(entry, line, 1))
    return F.nullif(F.when(capitals.contains(f"\n{key}"), value), F.lit(""))


def read(feeds: DataFrame) -> DataFrame:
    """Feeds (feed, body) to rows (feed, seq, summary, dtstart, ...): one an entry, in the file's order."""
    e = feeds.select(*[c for c in feeds.columns if c != "body"], F.posexplode(entries(F.col("body"))).alias("seq", "entry")).withColumn("capitals", F.upper("entry"))
    return e.select(*[c for c in e.columns if c not in ("entry", "capitals")], *[_value(F.col("entry"), F.col("capitals"), k).alias(k.lower().replace("-", "_")) for k in _KEYS])


def events(feeds: DataFrame, as_of: dt.date, expand: bool = True, coarse: bool = False, ranked: bool = False) -> DataFrame:
    """Feeds (feed, feed_rank, source, category, town, url, body) to adapter rows; nulls of category, town and url are defaults to fill.

    ``expand``: rules become one row a date, and the first overridden date replaces its series' row; else an entry is one row.
    ``ranked``: no two feeds have one rank.
    """
    today = F.lit(as_of)
    rows = read(feeds.withColumnRenamed("url", "feed_url"))
    starts = recur.occurrence_values(F.col("dtstart"), F.col("rrule"), recur.excluded_days(F.col("exdate")), today) if expand else F.when(F.col("dtstart").isNotNull(), F.array("dtstart")).otherwise(F.array().cast("array<string>"))
    end = F.when(F.col("rrule").isNull(), D.ics_end(F.col("dtstart"), F.col("dtend"), coarse=coarse))
    # Days are read as the rows are made, once: the filter on them would else carry their expressions along and read them again.
    rows = rows.select("*", F.explode(F.transform(starts, lambda v: F.struct(D.ics_moment(v).alias("at"), end.alias("end")))).alias("x"))
    rows = rows.where(F.col("summary").isNotNull() & (F.coalesce("x.end", "x.at.day") >= today)).withColumn("place", T.location_parts(F.col("location")))
    e = rows.select(
        "feed", "feed_rank", "seq", F.col("summary").alias("title"), F.col("x.at.day").alias("start"), F.col("x.end"),
        F.coalesce("x.at.clock", T.time_from_text(F.col("description"))).alias("time"), T.canon_town(F.coalesce("place.city", "town"), F.col("place.postcode")).alias("town"), F.col("place.venue"),
        F.coalesce("category", T.classify(F.col("summary"))).alias("category"), F.coalesce(F.col("url"), "feed_url").alias("url"), T.visible_note(F.col("description")).alias("note"), T.price_from_text(F.col("description")).alias("price"),
        F.col("source"), F.col("recurrence_id").isNotNull().alias("is_override"))
    return recur.resolve_overrides(e.withColumn("fingerprint", T.fingerprint(F.col("title"), F.col("start"), F.col("town"))), ranked)
