"""A snapshot in buckets: a batch rewrites only the buckets it touches, and a manifest names the files of each version.

An event's bucket is a hash of its day and town. Both are part of its fingerprint, so an event never changes its bucket, and rows that can become
one (of one day, town and venue) share one. A writer puts the changed buckets into a folder of its own and then moves a manifest, which
names for every bucket the folder that holds it, to the next version's name; the move fails where that name is taken. A reader takes the last
manifest. Until the move the old version is all there is, so a killed writer leaves nothing but files that no manifest names.

A manifest has a line a bucket and is read by the driver: choose buckets of some hundred MB.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from ..operators import resolve as R
from ..schema import SNAPSHOT


class Conflict(RuntimeError):
    """Another writer has published the version."""


class Store:
    """The snapshot in ``folder``; ``buckets`` counts only where nothing is published yet."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        last = self.manifest()
        self.buckets = last["buckets"] if last else buckets

    # --- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> None:
        jvm = self.spark._jvm
        hidden, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs().create(hidden, False)
        stream.write(text.encode())
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(hidden, final, self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._fs().delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    # --- versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        found = self.versions()
        at = found[-1] if version is None and found else version
        return json.loads(self._text(f"manifests/v{at:010d}.json")) if at is not None else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("start", T.slugify(F.col("town"))), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (the last), or of some of its buckets, with ``bucket``."""
        m = self.manifest(version)
        paths = [f"{self.folder}/{p}" for b, p in (m["paths"].items() if m else ()) if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], SNAPSHOT).withColumn("bucket", F.lit(0))
        # A bucket's number is in its rows, so that any set of folders can be read at once.
        return self.spark.read.schema(SNAPSHOT + ", bucket int").parquet(*paths)

    def rewrite(self, touched: set[int], change: Callable[[DataFrame], DataFrame], batch: int | None = None, base: dict | None = None) -> int:
        """Publish the version after ``base`` (a manifest, the last) whose touched buckets hold what ``change`` makes of their rows; its number."""
        base = base or self.manifest() or {"version": 0, "paths": {}, "batch": None}
        paths = dict(base["paths"])
        if touched:
            name = f"data/{uuid.uuid4().hex}"
            rows = change(self.read(base["version"] or None, touched).drop("bucket")).withColumn("bucket", self.bucket()).withColumn("folder", F.col("bucket"))
            rows.repartition("folder").write.partitionBy("folder").option("compression", "zstd").parquet(f"{self.folder}/{name}")
            paths = {b: p for b, p in paths.items() if int(b) not in touched}
            written = {n.partition("=")[2]: f"{name}/{n}" for n in self._names(name) if n.startswith("folder=")}
            if stray := {int(b) for b in written} - touched:
                raise ValueError(f"rows left their buckets: {sorted(stray)[:9]}")
            paths |= written
        version = base["version"] + 1
        self._fs().mkdirs(self._path("manifests"))
        self._publish(f"manifests/v{version:010d}.json", json.dumps({"version": version, "buckets": self.buckets, "batch": base["batch"] if batch is None else batch, "touched": sorted(touched), "paths": paths}))
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions and the data that none of these names; the number of folders deleted. Only while nobody writes."""
        found = self.versions()
        for v in found[:-keep]:
            self._fs().delete(self._path(f"manifests/v{v:010d}.json"), False)
        live = {p.split("/")[1] for v in found[-keep:] for p in self.manifest(v)["paths"].values()}
        stale = [n for n in self._names("data") if n not in live]
        for n in stale:
            self._fs().delete(self._path(f"data/{n}"), True)
        return len(stale)


def _buckets(rows: DataFrame) -> set[int]:
    return {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # no more than the store has buckets


def ingest(store: Store, raw: DataFrame, now: Column, as_of: dt.date, active: list[str], reconcile: list[str] = (), full: bool = True, batch: int | None = None) -> int | None:
    """A batch of adapter rows merged into the store, as :func:`agendula.plans.build.ingest` merges it into a whole snapshot.

    Besides the batch's buckets only those are rewritten that hold rows to go: past, retired or moved. These are found by a scan of
    the columns that tell. A ``batch`` that is already in does nothing (None).
    """
    last = store.manifest()
    if batch is not None and last and last["batch"] is not None and last["batch"] >= batch:
        return None
    rows = cut(R.drop_nonevents(R.normalize_events(raw)).withColumn("bucket", store.bucket()), "batch")
    today, there = F.lit(as_of), store.read(last and last["version"])
    gone = there.where(~R.stays(today))
    if full:
        gone = gone.unionByName(there.where(R.is_retired(active)))
    gone = gone.select("bucket", "fingerprint")
    for source in reconcile:
        gone = gone.unionByName(R.moved(there, rows.where(F.col("source") == source), source, today).select("bucket", "fingerprint"))
    gone = cut(gone.distinct(), "gone")

    def change(stored: DataFrame) -> DataFrame:
        out = R.merge_snapshot(stored.join(gone.join(rows.select("fingerprint"), "fingerprint", "left_anti"), "fingerprint", "left_anti"), rows.drop("bucket"), now).drop("added", "merged")
        out = R.prune_past(out, today)
        return R.collapse_venue_duplicates(R.prune_retired(out, active) if full else out)

    return store.rewrite(_buckets(rows) | _buckets(gone), change, batch, last)
