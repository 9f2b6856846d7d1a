"""Landed batches merged into the bucketed snapshot as they arrive: each micro-batch publishes a version that rewrites what it touches.

A version names the batch it came from, so a batch that is tried again after a failure finds itself published or is merged anew.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, ingest


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The last version (before a batch), or an empty snapshot."""
    store = Store(spark, folder)
    found = [v for v in store.versions() if before is None or (store.manifest(v)["batch"] or 0) < before]
    return (store.read(found[-1]) if found else store.read(only=set())).drop("bucket")


def merge_stream(events: DataFrame, folder: str, checkpoint: str, as_of: dt.date, active: list[str], buckets: int = 64):
    """A started query that merges a stream of adapter rows (with ``seq`` and ``seen``, the time they were fetched)."""

    def batch(rows: DataFrame, n: int) -> None:
        moment = rows.agg(F.max("seen")).first()[0]
        if moment is not None:
            ingest(Store(rows.sparkSession, folder, buckets), rows.drop("seen"), F.lit(moment).cast("timestamp_ntz"), as_of, active, batch=n)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
