"""Landed payloads: what a filter reads, columns, failed payloads, commits."""

import datetime as dt
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agendula.sources import adapters, landed

DAY = dt.date(2026, 7, 15)


def _rows(spark):
    rows = [(s, DAY + dt.timedelta(d), dep, 10 * d + i, f"u{i}", 200, json.dumps({"s": s, "i": i})) for s in ("open_data", "submissions") for d in range(3) for dep in ("06", "83") for i in range(5)]
    rows += [("open_data", DAY, "06", 90, "x", 500, "an error page"), ("open_data", DAY, "06", 91, "x", 200, ""), ("open_data", DAY, "06", 92, "x", 200, None), ("open_data", None, None, 93, "x", None, "b")]
    return spark.createDataFrame(rows, landed.SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed"))
    landed.land(_rows(spark).coalesce(1), path)
    return path


def test_all_sound_payloads_come_back(spark, folder):
    got = sorted(map(str, landed.read(spark, folder).collect()))
    assert got == sorted(map(str, _rows(spark).where("coalesce(status, 200) < 400 and body <> ''").collect())) and len(got) == 61


@pytest.mark.parametrize(("cond", "files"), [
    ("source = 'open_data'", 7), ("source = 'open_data' and day = date'2026-07-16'", 2), ("day >= date'2026-07-16' and department = '06'", 4), ("day > date'2026-07-16' and day < date'2026-07-18'", 4),
    ("source in ('submissions', 'none') and department in ('83')", 3), ("department <=> null", 1), ("day is null", 1), ("day is not null", 12), ("source = 'none'", 0), ("source = 'open_data' or department = '06'", 13), ("doc = 3", 13)])
def test_a_filter_reads_only_its_files(spark, folder, cond, files):
    rows = landed.read(spark, folder).where(cond)
    want = landed.read(spark, folder).collect()
    assert rows.rdd.getNumPartitions() == max(1, files)
    assert sorted(map(str, rows.collect())) == sorted(map(str, spark.createDataFrame(want, landed.SCHEMA).where(cond).collect()))


def test_a_narrow_schema_reads_its_columns(spark, folder, monkeypatch):
    asked = []
    whole = pq.ParquetFile.iter_batches
    monkeypatch.setattr(pq.ParquetFile, "iter_batches", lambda self, n, columns: asked.append(columns) or whole(self, n, columns=columns))
    reader = landed.Reader(folder, spark.createDataFrame([], "source string, url string").schema)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 61 and asked and all("body" not in c and "doc" not in c for c in asked)
    assert landed.read(spark, folder, "url string, day date").where("day = date'2026-07-15'").count() == 20


def test_commits(spark, tmp_path):
    path = str(tmp_path)
    assert landed.read(spark, path).count() == 0
    rows = _rows(spark).where("doc = 1").select("source", "doc", "body")
    landed.land(rows, path)
    landed.land(rows, path)
    assert landed.read(spark, path).count() == 8 and landed.read(spark, path).where("department is null").count() == 8

    # A write whose tasks end, but which is never committed, shows nothing; the sweep deletes its parts alone.
    lost = landed.Writer(path, False)
    lost.write(iter(rows.toArrow().to_batches()))
    assert landed.read(spark, path).count() == 8
    assert landed.sweep(path) >= 1 and landed.read(spark, path).count() == 8

    landed.land(rows.limit(1), path, "overwrite")
    assert landed.read(spark, path).count() == 1
    landed.land(rows.limit(0), path)
    assert landed.read(spark, path).count() == 1


def test_a_failed_write_leaves_the_old_payloads(spark, tmp_path):
    path = str(tmp_path)
    landed.land(_rows(spark).where("doc = 1"), path)
    before = landed.read(spark, path).count()
    with pytest.raises(Exception):  # noqa: B017
        landed.land(_rows(spark).withColumn("body", F.raise_error(F.lit("stopped")).cast("string")), path, "overwrite")
    assert landed.read(spark, path).count() == before


def test_malformed_bodies_give_no_events(spark, tmp_path):
    good = json.dumps({"results": [{"title_fr": "Bal", "firstdate_begin": "2026-07-20T20:00:00+02:00", "location_city": "Nice", "location_postalcode": 6000, "canonicalurl": "u"}]})
    rows = [("open_data", DAY, "06", i, "u", 200, b) for i, b in enumerate([good, "{", "[]", "null", "<html>", '{"results": 5}'])]
    landed.land(spark.createDataFrame(rows, landed.SCHEMA), str(tmp_path))
    raw = landed.read(spark, str(tmp_path)).where("department = '06'")
    got = adapters.default_registry().extract(raw, DAY, ["open_data"]).collect()
    assert [(r.title, r.town, r.time) for r in got] == [("Bal", "Nice", "20:00")]


def test_unknown_columns_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no such columns"):
        landed.read(spark, str(tmp_path), "source string, colour string").collect()
