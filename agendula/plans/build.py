"""The two whole plans: ingest a batch into the snapshot, and build what is published from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..lineage import cut
from ..operators import resolve as R
from ..operators import rules, sequences
from .listing import published


def tidy_rows(events: DataFrame, overrides: list[tuple] = ()) -> DataFrame:
    """Rows as published: no false midnight, tidy venue, display category, free flag and short note."""
    e = events.withColumns({"time": F.nullif(F.trim("time"), F.lit("00:00")), "venue": F.nullif(T.tidy_text(F.col("venue")), F.lit("")), "category": F.when(F.col("category") == "brocante", "marche").otherwise(F.col("category"))})
    e = e.withColumn("__guess", T.classify(F.col("title"), F.col("venue")))
    other = F.col("__guess") == X.DEFAULT_CATEGORY
    e = e.withColumn("category", F.when(F.col("source") == "meetup", F.when(other, "social").otherwise(F.col("__guess"))).when(F.col("category") == X.DEFAULT_CATEGORY, F.col("__guess")).otherwise(F.col("category")))
    e = e.withColumn("category", rules.override(F.col("category"), F.col("url"), F.col("title"), F.col("town"), list(overrides)))
    e = e.withColumn("__full", T.note_full(F.col("note")))
    e = e.withColumn("free", F.col("free") | T.says_free(F.concat_ws(" ", "title", "__full")))
    return e.withColumn("note", F.nullif(T.shorten(F.col("__full")), F.lit(""))).drop("__guess", "__full", "sources", "first_seen", "last_seen", "approved", "submitted_by")


def build(snapshot: DataFrame, as_of: dt.date, suppressed: DataFrame | None = None, cancelled: DataFrame | None = None, overrides: list[tuple] = ()) -> DataFrame:
    """Published events: live and approved rows, cleaned, suppressed, merged by overlap and recurrence, with slugs."""
    e = tidy_rows(published(snapshot, as_of), overrides)
    if suppressed is not None:
        e = rules.suppress(e, suppressed)
    e = cut(rules.mark_cancelled(e, cancelled), "tidy")
    off, on = e.where("cancelled"), e.where("not cancelled")
    on = sequences.fold_recurring(cut(sequences.collapse_overlaps(on), "collapsed"), F.lit(as_of))
    e = on.unionByName(off.withColumn("recurring", F.lit(False)))
    title, time = T.time_from_title(F.col("title"), F.col("time"))
    e = e.withColumns({"title": title, "time": time}).withColumn("title", T.clean_title(F.col("title")))
    return sequences.assign_slugs(e).orderBy("start", "title", "fingerprint")


def ingest(snapshot: DataFrame, raw: DataFrame, now: Column, as_of: dt.date, active: list[str], reconcile: list[str] = (), full: bool = True) -> DataFrame:
    """A new snapshot: the batch (adapter rows plus ``seq``) normalised, filtered and merged; moved, past and retired rows gone."""
    batch = R.drop_nonevents(R.normalize_events(raw))
    out = R.merge_snapshot(snapshot, batch, now).drop("added", "merged")
    today = F.lit(as_of)
    for source in reconcile:
        out = R.reconcile_dates(out, batch.where(F.col("source") == source), source, today)
    out = R.prune_past(out, today)
    return R.collapse_venue_duplicates(R.prune_retired(out, active) if full else out)


def run_log(batch: DataFrame, merged: DataFrame, now: Column) -> DataFrame:
    """Found and added rows by source, for the log of runs."""
    found = batch.groupBy(F.col("source").alias("scraper")).agg(F.count(F.lit(1)).cast("int").alias("found"))
    added = merged.where("added").groupBy(F.col("source").alias("scraper")).agg(F.count(F.lit(1)).cast("int").alias("added"))
    return found.join(added, "scraper", "left").select("scraper", now.alias("started_at"), F.lit(True).alias("ok"), "found", F.coalesce("added", F.lit(0)).alias("added"), F.lit(None).cast("string").alias("error"))
