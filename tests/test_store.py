"""The bucketed snapshot: what a batch rewrites, equality with the whole merge, killed and competing writers, repeated batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agendula.operators import resolve
from agendula.plans import build
from agendula.schema import EVENT, SNAPSHOT
from agendula.streaming.store import Conflict, Store, ingest

AS_OF = dt.date(2026, 7, 15)
NAMES = [x.split()[0] for x in EVENT.split(", ")]


def _raw(spark, rows, first=0):
    base = {"title": "Bal", "start": dt.date(2026, 8, 1), "town": "Nice", "source": "a", "category": "danse", "free": False, "outdoor": False, "online": False, "approved": True}
    return spark.createDataFrame([tuple((base | r).get(n) for n in NAMES) + (first + i,) for i, r in enumerate(rows)], EVENT + ", seq long")


def _now(h):
    return F.lit(dt.datetime(2026, 7, 15, h)).cast("timestamp_ntz")


def _store(spark, tmp_path, buckets=16):
    return Store(spark, f"file://{tmp_path}/store", buckets)


def _some(r, n):
    out = []
    for _ in range(n):
        start = AS_OF + dt.timedelta(r.randrange(-6, 30))
        out.append({"title": r.choice(["Bal", "BAL", "Bal (free)", "Concert de jazz", "Vernissage", "Annulé: bal"]), "start": start, "end": r.choice([None, start + dt.timedelta(2)]), "town": r.choice(["Nice", "nice", "Cannes", "Antibes"]), "source": r.choice(["a", "b", "old"]), "venue": r.choice([None, "Salle X", "Salle X, rue 1", "Port"]), "note": r.choice([None, "n", "longer"]), "submitted_by": r.choice([None] * 6 + ["s1"]), "url": r.choice([None, "u1", "u2"])})
    return out


def test_equal_to_the_whole_merge(spark, tmp_path):
    r, store, whole = random.Random(3), _store(spark, tmp_path), spark.createDataFrame([], SNAPSHOT)
    for n in range(3):
        raw = _raw(spark, _some(r, 60))
        active, day = (["a", "b", "old"], ["a", "b"])[n > 1], AS_OF + dt.timedelta(2 * n)
        ingest(store, raw, _now(n), day, active, ["a"], batch=n)
        whole = spark.createDataFrame(build.ingest(whole, raw, _now(n), day, active, ["a"]).select(*whole.columns).collect(), SNAPSHOT)
        got = store.read().drop("bucket").select(*whole.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert store.versions() == [1, 2, 3]


def test_one_row_writes_one_bucket(spark, tmp_path):
    store = _store(spark, tmp_path)
    ingest(store, _raw(spark, [{"title": f"Bal {i}", "start": AS_OF + dt.timedelta(i)} for i in range(40)]), _now(1), AS_OF, ["a"])
    before = store.manifest()["paths"]
    ingest(store, _raw(spark, [{"title": "Bal 3", "start": AS_OF + dt.timedelta(3), "note": "new"}]), _now(2), AS_OF, ["a"])
    after = store.manifest()
    assert len(after["touched"]) == 1 and sum(after["paths"][b] != p for b, p in before.items()) == 1
    assert [x.note for x in store.read().where("title = 'Bal 3'").collect()] == ["new"] and store.read().count() == 40
    assert store.read(1).where("note = 'new'").count() == 0
    # A day later one row is over: its bucket alone is written.
    ingest(store, _raw(spark, []), _now(3), AS_OF + dt.timedelta(3), ["a"])
    assert len(store.manifest()["touched"]) == 1 and store.read().count() == 39


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path)
    ingest(store, _raw(spark, [{}]), _now(1), AS_OF, ["a"], batch=0)
    with pytest.raises(Exception):  # noqa: B017
        store.rewrite(set(range(16)), lambda d: d.withColumn("title", F.raise_error(F.lit("killed")).cast("string")))
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.rewrite(set(range(16)), lambda d: d.where("false").unionByName(d))
    again = _store(spark, tmp_path)
    assert again.versions() == [1] and again.read().count() == 1
    assert again.vacuum() >= 1 and again.read().count() == 1
    assert ingest(again, _raw(spark, [{"title": "other"}]), _now(2), AS_OF, ["a"], batch=0) is None and again.read().count() == 1


def test_of_two_writers_one_publishes(spark, tmp_path):
    store = _store(spark, tmp_path)
    ingest(store, _raw(spark, [{}]), _now(1), AS_OF, ["a"])

    def slow(rows):
        ingest(_store(spark, tmp_path), _raw(spark, [{"title": "other"}]), _now(2), AS_OF, ["a"])
        return rows

    with pytest.raises(Conflict):
        store.rewrite(set(range(16)), slow)
    assert sorted(x.title for x in store.read().collect()) == ["Bal", "other"]


def test_rows_may_not_leave_their_bucket(spark, tmp_path):
    store = _store(spark, tmp_path, 64)
    ingest(store, _raw(spark, [{}]), _now(1), AS_OF, ["a"])
    touched = {int(b) for b in store.manifest()["paths"]}
    with pytest.raises(ValueError, match="left their buckets"):
        store.rewrite(touched, lambda d: d.withColumn("start", F.date_add("start", 40)))
    assert store.vacuum(1) == 1 and store.read().count() == 1


def test_moved_rows(spark):
    e = resolve.normalize_events(_raw(spark, [{"title": "Bal"}, {"title": "Le Bal", "start": dt.date(2026, 8, 9)}, {"title": "Jazz"}])).drop("seq").withColumns({"sources": F.array("source")})
    listed = e.where("start = date'2026-08-09'")
    assert [(x.title, x.start.day) for x in resolve.moved(e, listed, "a", F.lit(AS_OF)).collect()] == [("Bal", 1)]
    assert resolve.moved(e, listed.where("false"), "a", F.lit(AS_OF)).count() == 0
