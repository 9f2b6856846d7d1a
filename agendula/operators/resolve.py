"""Entity resolution: normalised events, the merge with the stored snapshot, and the maintenance deletes.

A snapshot is a table with one row a fingerprint. Every delete is the complement filter or an anti-join; a new snapshot is written to
a new folder, so a lost executor or driver leaves the old one whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .titles import folded, kept_titles, titled

#: Buckets in which the rows of a batch are counted, and how many beyond twice the mean make one crowded.
BUCKETS, CROWD = 1 << 16, 1 << 17


def blank_to_null(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))


def normalize_events(raw: DataFrame) -> DataFrame:
    """Events as adapters give them to events that can be merged: canonical town, known category, no backward end, fingerprint."""
    e = raw.withColumns({c: blank_to_null(c) for c in ("title", "time", "venue", "url", "note", "price", "image", "submitted_by")})
    e = e.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("free", "outdoor", "online")}).withColumn("approved", F.coalesce("approved", F.lit(True)))
    known = F.col("category").isin(list(X.CATEGORIES))
    e = e.withColumns({"town": T.canon_town(F.col("town")), "end": F.when(F.col("end") >= F.col("start"), F.col("end")), "category": F.when(known, F.col("category")).otherwise(T.classify(F.col("title"), F.col("venue")))})
    e = e.where("title is not null and start is not null")
    return e.withColumn("fingerprint", T.fingerprint(F.col("title"), F.col("start"), F.col("town")))


def drop_nonevents(events: DataFrame) -> DataFrame:
    """Without administrative titles, unless a person submitted them."""
    return events.where(~T.is_nonevent(F.col("title")) | F.col("submitted_by").isNotNull())


def better_title(old: Column, new: Column) -> Column:
    turned = T.says_cancelled(new) & ~T.says_cancelled(old)
    return F.when(turned | (T.title_penalty(new) < T.title_penalty(old)), new).otherwise(old)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)).cast("int")


def crowded(batch: DataFrame, crowd: int = CROWD) -> list[int]:
    """Buckets of events with far more rows than the others, so that an event of very many rows lies in one of them."""
    sizes = batch.groupBy(_bucket().alias("bucket")).count()
    return sorted(r["bucket"] for r in sizes.crossJoin(F.broadcast(sizes.agg(F.sum("count").alias("all")))).where(F.col("count") > crowd + 2 * F.col("all") / BUCKETS).select("bucket").collect())


def merge_snapshot(stored: DataFrame, batch: DataFrame, now: Column, crowd: int = CROWD) -> DataFrame:
    """The stored snapshot with a batch (normalised events plus ``seq``, their order) merged in, field by field.

    Within a fingerprint the stored row comes first, then the batch by ``seq``. An event of the row's own source may clear its end
    and its free flag and replace its url; others only add. ``added`` and ``merged`` tell what became of the row.

    Rows are dealt by fingerprint once, and everything follows where they lie. Events in crowded buckets (the batch is counted first) are aggregated by
    fingerprint and source before they are shuffled, and their titles are dealt by ranges: no task holds such an event.
    """
    cols = [c for c in stored.columns if c not in ("fingerprint", "sources", "first_seen", "last_seen")]
    old = stored.select("fingerprint", *cols, "sources", "first_seen", F.col("last_seen"), F.lit(-1).cast(batch.schema["seq"].dataType).alias("seq"))
    new = batch.select("fingerprint", *cols, "seq")
    # What follows from a row is added where it has come.
    whole = lambda r: r.withColumns({c: F.when(F.col("seq") < 0, F.col(c)).otherwise(v) for c, v in {"sources": F.array("source"), "first_seen": now, "last_seen": now}.items()})
    rows, many = old.unionByName(new, allowMissingColumns=True), crowded(batch, crowd)
    few = rows.where(~_bucket().isin(many)) if many else rows
    few = whole(few.repartition("fingerprint")).withColumn("titled", titled(F.col("seq"), F.col("title")))
    out = _merged(few, [F.collect_list("titled").alias("titles")], {"title": folded(F.flatten(F.col("by")["titles"]))})
    if many:
        rows = whole(rows.where(_bucket().isin(many)))
        out = out.unionByName(_merged(rows, [], {}).join(kept_titles(rows), "fingerprint", "left").select(out.columns))
    return out.select(*stored.columns, "added", "merged")


def _merged(rows: DataFrame, more: list[Column], more_fields: dict[str, Column]) -> DataFrame:
    """One row a fingerprint, of one entry a source; ``more`` is aggregated by source too, and ``more_fields`` follow from the entries. The owner is the
    source that came first."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value")))
    long = lambda c: F.when(F.col(c).isNotNull(), F.struct((-F.length(c)).alias("size"), "seq", F.col(c).alias("value")))
    kept = ["source", "town", "category", "start", "online", "submitted_by", "approved", "first_seen"]
    by_source = rows.groupBy("fingerprint", "source").agg(
        F.min("seq").alias("from"), F.max("seq").alias("to"), F.min(F.struct("seq", *kept)).alias("first"), F.count(F.lit(1)).alias("n"), F.bool_or("outdoor").alias("outdoor"), F.max("last_seen").alias("last_seen"), F.collect_set("sources").alias("sources"),
        F.max(F.struct("seq", F.col("end").alias("value"))).alias("any_end"), F.max(at("end")).alias("some_end"), F.max(F.struct("seq", F.col("free").alias("value"))).alias("any_free"), F.max(F.when(F.col("free"), F.col("seq"))).alias("some_free"),
        F.max(at("url")).alias("last_url"), F.min(at("url")).alias("first_url"), *[F.max(at(c)).alias(c) for c in ("time", "price", "image")], *[F.min(long(c)).alias(c) for c in ("venue", "note")], *more,
    )
    # One entry a source, the owner's first.
    each = by_source.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct("from", *[c for c in by_source.columns if c not in ("fingerprint", "source", "from")]))).alias("by"))
    each = each.withColumns({"own": F.col("by")[0], "others": F.slice("by", F.lit(2), F.size("by"))})
    latest = lambda items: F.array_max(items)["value"]
    fields = {c: latest(F.col("by")[c]) for c in ("time", "price", "image")} | {c: F.array_min(F.col("by")[c])["value"] for c in ("venue", "note")} | {c: F.col("own.first")[c] for c in kept}
    fields |= {
        "end": latest(F.concat(F.array("own.any_end"), F.col("others")["some_end"])),
        "url": F.coalesce(F.col("own.last_url")["value"], F.array_min(F.col("others")["first_url"])["value"]),
        "free": F.col("own.any_free")["value"] | F.coalesce(F.array_max(F.col("others")["some_free"]) > F.col("own.to"), F.lit(False)),
        "outdoor": F.exists(F.col("by")["outdoor"], lambda x: x),
        "sources": F.array_sort(F.array_distinct(F.flatten(F.flatten(F.col("by")["sources"])))),
        "last_seen": F.array_max(F.col("by")["last_seen"]),
        "added": F.col("own.from") >= 0,
        "merged": F.aggregate(F.col("by")["n"], F.lit(0).cast("long"), lambda a, n: a + n) - 1,
    }
    return each.select("fingerprint", *[c.alias(name) for name, c in (fields | more_fields).items()])


def collapse_venue_duplicates(events: DataFrame) -> DataFrame:
    """Rows of one day, town and venue become one where a submitted row is among them; the first row not submitted stays."""
    key = ["start", "__town", "__venue"]
    e = events.withColumns({"__town": T.slugify(F.col("town")), "__venue": T.venue_core(F.col("venue"))})
    w = Window.partitionBy(*key)
    order = F.struct(F.col("submitted_by").isNotNull(), "first_seen", "fingerprint")
    grouped = (F.col("__venue") != "") & (F.count(F.lit(1)).over(w) > 1) & F.bool_or(F.col("submitted_by").isNotNull()).over(w)
    e = e.withColumns({"__merge": grouped, "__order": order})
    alone = e.where(~F.col("__merge")).select(*events.columns)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__order"))).alias(c)
    longest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.length(c), F.col("__order")))).alias(c)
    special = {"venue": longest("venue"), "note": longest("note"), **{c: first(c) for c in ("url", "time", "price", "image")}, **{c: F.bool_or(c).alias(c) for c in ("free", "outdoor")}}
    special["sources"] = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources")
    special["start"] = F.first("start").alias("start")
    merged = e.where("__merge").groupBy(*[F.col(k).alias(f"k_{k}") for k in key]).agg(*[special.get(c, F.min_by(c, "__order").alias(c)) for c in events.columns])
    return alone.unionByName(merged.select(*events.columns))


def moved(events: DataFrame, listed: DataFrame, source: str, as_of: Column) -> DataFrame:
    """Future rows of this source alone whose title and town it lists now (title, town, start), but not on their date."""
    keyed = lambda d: d.withColumns({"__k": T.title_key(F.col("title")), "__t": T.slugify(F.col("town"))})
    # Keys are computed once a row, on either side; what a source lists now is small beside the snapshot.
    now = keyed(listed).select("__k", "__t", F.col("start").alias("__d")).groupBy("__k", "__t").agg(F.collect_set("__d").alias("__days"))
    mine = (F.col("start") >= as_of) & F.col("submitted_by").isNull() & (F.col("source") == source) & (F.array_distinct("sources") == F.array(F.lit(source)))
    met = keyed(events.where(mine)).join(now, ["__k", "__t"])
    return met.where(~F.array_contains("__days", F.col("start"))).select(*events.columns)


def reconcile_dates(events: DataFrame, listed: DataFrame, source: str, as_of: Column) -> DataFrame:
    """Without rows that :func:`moved`. An empty listing deletes nothing."""
    return events.join(moved(events, listed, source, as_of).select("fingerprint"), "fingerprint", "left_anti")


def is_retired(active: list[str]) -> Column:
    """All sources of a row are retired, and nobody submitted it."""
    gone = (F.size("sources") > 0) & ~F.arrays_overlap("sources", F.array(*map(F.lit, active)))
    return F.coalesce(gone, F.lit(False)) & F.col("submitted_by").isNull()


def prune_retired(events: DataFrame, active: list[str]) -> DataFrame:
    """Without rows whose sources have all been retired; submitted rows stay."""
    return events.where(~is_retired(active))


def stays(as_of: Column, days: int = 2) -> Column:
    """A row that was submitted, or is not over for more than ``days`` days."""
    limit = F.date_sub(as_of, days)
    return F.coalesce(F.col("end") >= limit, F.lit(False)) | (F.col("end").isNull() & (F.col("start") >= limit)) | F.col("submitted_by").isNotNull()


def prune_past(events: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Without rows over for more than ``days`` days; submitted rows stay."""
    return events.where(stays(as_of, days))


def approve(events: DataFrame, fingerprint: str) -> DataFrame:
    return events.withColumn("approved", F.col("approved") | (F.col("fingerprint") == fingerprint))


def reject(events: DataFrame, fingerprint: str) -> DataFrame:
    """Without a pending row; an approved one stays."""
    return events.where((F.col("fingerprint") != fingerprint) | F.col("approved"))


def pending(events: DataFrame) -> DataFrame:
    return events.where(~F.col("approved")).orderBy("first_seen", "fingerprint")


def add_missing_columns(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of an older snapshot with the columns that later ones gained, as nulls."""
    want = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])


def unsubscribe(messages: DataFrame, token: str, now: Column) -> DataFrame:
    """Set once, and again changes nothing."""
    return messages.withColumn("unsubscribed_at", F.when((F.col("token") == token) & (F.col("kind") == "hello"), F.coalesce("unsubscribed_at", now)).otherwise(F.col("unsubscribed_at")))


def confirm_submission(submissions: DataFrame, token: str) -> DataFrame:
    return submissions.withColumn("email_verified", F.col("email_verified") | (F.col("token") == token))


def approve_trusted(submissions: DataFrame, trusted: DataFrame) -> DataFrame:
    """Submissions of trusted addresses are approved at once."""
    known = trusted.select(F.lower("email").alias("__mail")).distinct().withColumn("__known", F.lit(True))
    out = submissions.join(known, F.lower("email") == F.col("__mail"), "left")
    return out.withColumn("approved", F.col("approved") | F.col("__known").isNotNull()).drop("__mail", "__known")


def mark_published(submissions: DataFrame, events: DataFrame) -> DataFrame:
    """Write-back: submissions that are in the snapshot are published."""
    there = events.where("submitted_by is not null").select(F.col("submitted_by").alias("id")).distinct().withColumn("__in", F.lit(True))
    return submissions.join(there, "id", "left").withColumn("published", F.col("published") | F.col("__in").isNotNull()).drop("__in")
