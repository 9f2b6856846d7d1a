"""Resolution, sequences, recurrence, rules and plans against expectations and row-by-row models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agendula.operators import recur, resolve, rules, sequences
from agendula.plans import build, listing, quality
from agendula.schema import EVENT, SNAPSHOT

AS_OF = dt.date(2026, 7, 1)
NOW = dt.datetime(2026, 7, 1, 12)
BASE = {"title": "Brocante du Cours Saleya", "start": dt.date(2026, 7, 20), "town": "Nice", "source": "a", "category": "brocante", "free": False, "outdoor": False, "online": False, "approved": True}
NAMES = [x.split()[0] for x in EVENT.split(", ")]


def events(spark, *rows):
    return spark.createDataFrame([tuple((BASE | r).get(n) for n in NAMES) for r in rows], EVENT)


def batch(spark, *rows):
    e = events(spark, *rows).withColumn("seq", F.monotonically_increasing_id())
    seqs = spark.createDataFrame([tuple((BASE | r).get(n) for n in NAMES) + (i,) for i, r in enumerate(rows)], EVENT + ", seq long")
    assert e.count() == seqs.count()
    return resolve.normalize_events(seqs)


def merged(spark, *rows, stored=()):
    old = spark.createDataFrame([], SNAPSHOT)
    for r in stored:
        old = resolve.merge_snapshot(old, batch(spark, r), F.lit(NOW).cast("timestamp_ntz")).drop("added", "merged")
    return resolve.merge_snapshot(old, batch(spark, *rows), F.lit(NOW).cast("timestamp_ntz")).collect()


def test_merge_prefers_and_keeps(spark):
    (r,) = merged(spark, {"source": "b", "title": "BROCANTE DU COURS SALEYA (Gratuit)", "venue": "Cours Saleya, Vieux Nice", "url": "http://b", "free": True}, {"source": "c", "venue": "Cours", "note": "n"}, stored=[{"venue": "Cours Saleya", "url": "http://a"}])
    assert (r.title, r.venue, r.url, r.sources, r.free, r.note, r.added, r.merged) == (BASE["title"], "Cours Saleya, Vieux Nice", "http://a", ["a", "b", "c"], True, "n", False, 2)
    (r,) = merged(spark, {"end": None}, stored=[{"end": dt.date(2026, 7, 22)}])
    assert r.end is None
    (r,) = merged(spark, {"source": "b"}, stored=[{"end": dt.date(2026, 7, 22)}])
    assert r.end == dt.date(2026, 7, 22)


def test_cancellation_wins_and_can_be_lifted(spark):
    (r,) = merged(spark, {"title": "(ANNULÉE) BROCANTE DU COURS SALEYA"}, stored=[{}])
    assert r.title.startswith("(ANNULÉE)")
    (r,) = merged(spark, {}, stored=[{}, {"title": "(ANNULÉE) BROCANTE DU COURS SALEYA"}])
    assert r.title == BASE["title"]


def _model(rows):
    """The sequential rules, one event after the other."""
    cur, src = dict(rows[0]), rows[0]["source"]
    sources = {src}
    for n in rows[1:]:
        owns = n["source"] == src
        sources.add(n["source"])
        cur["end"] = n["end"] if n["end"] or owns else cur["end"]
        for f in ("time", "price", "image"):
            cur[f] = n[f] or cur[f]
        for f in ("venue", "note"):
            if n[f] and (not cur[f] or len(n[f]) > len(cur[f])):
                cur[f] = n[f]
        cur["url"] = (n["url"] or cur["url"]) if owns else (cur["url"] or n["url"])
        cur["free"] = n["free"] if owns else cur["free"] or n["free"]
        cur["outdoor"] = cur["outdoor"] or n["outdoor"]
    return cur | {"sources": sorted(sources)}


def test_merge_equals_a_sequential_model(spark):
    r = random.Random(5)
    pick = lambda *v: r.choice(v)
    groups, rows = {}, []
    for g in range(60):
        for _ in range(r.randrange(1, 7)):
            row = {"title": f"Night number {g}", "start": dt.date(2026, 8, 1), "source": pick("a", "b", "c"), "end": pick(None, dt.date(2026, 8, 3), dt.date(2026, 8, 5)), "time": pick(None, "19:00", "20:00"), "price": pick(None, "1€", "2€"), "image": pick(None, "i", "j"), "venue": pick(None, "v", "vv", "ww"), "note": pick(None, "n", "nn"), "url": pick(None, "u1", "u2", "u3"), "free": pick(True, False), "outdoor": pick(True, False)}
            groups.setdefault(row["title"], []).append(row)
            rows.append(row)
    got = {x.title: x for x in merged(spark, *rows)}
    for t, rs in groups.items():
        want = _model(rs)
        assert {f: got[t][f] for f in ("end", "time", "price", "image", "venue", "note", "url", "free", "outdoor", "sources")} == {f: want[f] for f in ("end", "time", "price", "image", "venue", "note", "url", "free", "outdoor", "sources")}, t


def test_maintenance(spark):
    s = resolve.merge_snapshot(spark.createDataFrame([], SNAPSHOT), batch(spark, {}, {"title": "Old", "start": dt.date(2026, 6, 1)}, {"title": "Sent", "start": dt.date(2026, 6, 1), "submitted_by": "x", "source": "sub"}, {"title": "Bal", "start": dt.date(2026, 7, 9)}, {"title": "Bal", "start": dt.date(2026, 7, 10)}), F.lit(NOW).cast("timestamp_ntz")).drop("added", "merged")
    assert {r.title for r in resolve.prune_past(s, F.lit(AS_OF)).collect()} == {BASE["title"], "Sent", "Bal"}
    assert {r.title for r in resolve.prune_retired(s, ["z"]).collect()} == {"Sent"}
    left = resolve.reconcile_dates(s, events(spark, {"title": "Bal", "start": dt.date(2026, 7, 10)}), "a", F.lit(AS_OF)).collect()
    assert sorted(r.start for r in left if r.title == "Bal") == [dt.date(2026, 7, 10)] and len(left) == 4
    assert resolve.reconcile_dates(s, events(spark, {}).where("false"), "a", F.lit(AS_OF)).count() == 5


def test_duplicate_submission_collapses(spark):
    rows = [{"title": "Fete A", "venue": "Salle X, rue 1", "source": "sub", "submitted_by": "id1", "note": "a longer note"}, {"title": "Grande fete", "venue": "Salle X", "note": "short", "url": "u"}, {"title": "Other", "venue": "Salle Y"}]
    s = resolve.merge_snapshot(spark.createDataFrame([], SNAPSHOT), batch(spark, *rows), F.lit(NOW).cast("timestamp_ntz")).drop("added", "merged")
    got = {r.title: r for r in resolve.collapse_venue_duplicates(s).collect()}
    assert set(got) == {"Grande fete", "Other"} and got["Grande fete"].note == "a longer note" and got["Grande fete"].sources == ["a", "sub"] and got["Grande fete"].venue == "Salle X, rue 1"


def _published(spark, *rows):
    e = resolve.normalize_events(events(spark, *rows))
    return e.drop("approved", "submitted_by")


def day(n, m=7):
    return dt.date(2026, m, n)


def test_overlaps_collapse_whatever_the_order(spark):
    rows = [{"title": "Grand Festival de Jazz", "start": day(1), "end": day(5)}, {"title": "Grand Festival de Jazz Nuit", "start": day(4), "end": day(8), "venue": "Arenes"}, {"title": "Grand Festival de Jazz", "start": day(20)}, {"title": "Grand Festival de Jazz", "town": "Cannes", "start": day(4)}]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted((r.town, r.start, r.end, r.venue) for r in sequences.collapse_overlaps(_published(spark, *rows)).collect())
        want = want or got
        assert got == want
    assert [x[:3] for x in want] == [("Cannes", day(4), None), ("Nice", day(1), day(8)), ("Nice", day(20), None)]




def test_runs_need_one_url(spark):
    run = [{"title": "Piece", "venue": "TNN", "start": day(d), "url": "u"} for d in (9, 10, 11)]
    apart = [{"title": "Milonga", "venue": "Casita", "start": day(d), "url": f"u{d}"} for d in (9, 10)]
    got = sequences.fold_recurring(_published(spark, *run, *apart), F.lit(AS_OF)).collect()
    assert sorted((r.title, r.start, r.end) for r in got) == [("Milonga", day(9), None), ("Milonga", day(10), None), ("Piece", day(9), day(11))]


def test_far_dates_fold(spark):
    weekly = [{"title": "Milonga", "venue": "Casita", "start": AS_OF + dt.timedelta(7 * i), "note": "Bal", "url": f"u{i}"} for i in range(14)]
    got = sorted(sequences.fold_recurring(_published(spark, *weekly), F.lit(AS_OF)).collect(), key=lambda r: r.start)
    assert len(got) == 8 and not any(r.recurring for r in got[:7])
    assert (got[7].start, got[7].note, got[7].recurring) == (AS_OF + dt.timedelta(49), "Bal · Also on 26 Aug, 2 Sep, 9 Sep, 16 Sep +2 more", True)


def test_rules(spark):
    e = _published(spark, {"url": "u"}, {"title": "Fête de fin d'année", "start": day(9)}, {"title": "(Annulée) Milonga", "start": day(8)}, {"title": "MILONGA de l'Amitié", "start": day(25)})
    r = [(None, "fete de fin d annee", None, day(9)), ("u", None, "Cannes", None), (None, None, None, None)]
    assert {x.title for x in rules.suppress(e, spark.createDataFrame(r, "url string, needle string, town string, date date")).collect()} == {BASE["title"], "(Annulée) Milonga", "MILONGA de l'Amitié"}
    c = spark.createDataFrame([("milonga de l amitie", "Nice", day(25), "Annulée")], "needle string, town string, date date, note string")
    got = {x.title: (x.cancelled, x.cancel_note) for x in rules.mark_cancelled(e, c).collect()}
    assert got == {BASE["title"]: (False, None), "Fête de fin d'année": (False, None), "Milonga": (True, "Annulé"), "MILONGA de l'Amitié": (True, "Annulée")}


@pytest.mark.parametrize(("rule", "start", "first", "n"), [
    ("FREQ=WEEKLY;BYDAY=TU", "2024-01-02", dt.date(2026, 7, 21), None), ("FREQ=MONTHLY;BYDAY=-1TH", "2024-01-25", dt.date(2026, 7, 30), 4), ("FREQ=DAILY;INTERVAL=2", "2026-07-14", dt.date(2026, 7, 16), None),
    ("FREQ=WEEKLY;COUNT=3", "2026-07-08", dt.date(2026, 7, 15), 2), ("FREQ=MONTHLY", "2026-01-31", dt.date(2026, 7, 31), 3), ("FREQ=YEARLY", "2026-01-31", None, 0), ("FREQ=WEEKLY;UNTIL=20260723T000000Z", "2026-07-02", dt.date(2026, 7, 16), 2)])
def test_recurrence(spark, rule, start, first, n):
    today = dt.date(2026, 7, 15)
    days = recur.rule_dates(F.lit(start).cast("date"), F.lit(rule), F.lit(None).cast("array<date>"), F.lit(today), F.lit(today + dt.timedelta(120)))
    got = spark.range(1).select(days.alias("d")).first().d
    assert (got[0] if got else None) == first and (n is None or len(got) == n)


def test_count_is_used_by_excluded_days(spark):
    days = recur.rule_dates(F.lit("2026-07-15").cast("date"), F.lit("FREQ=DAILY;COUNT=3"), F.array(F.lit(dt.date(2026, 7, 16))), F.lit(dt.date(2026, 7, 15)), F.lit(dt.date(2026, 9, 1)))
    assert spark.range(1).select(days.alias("d")).first().d == [dt.date(2026, 7, 15), dt.date(2026, 7, 17)]
    v = recur.occurrence_values(F.lit("20260715T190000Z"), F.lit("FREQ=DAILY;COUNT=2"), F.array().cast("array<date>"), F.lit(AS_OF))
    assert spark.range(1).select(v.alias("d")).first().d == ["20260715T190000Z", "20260716T190000Z"]


def test_slugs(spark):
    got = {(r.title, r.start): r.slug for r in sequences.assign_slugs(_published(spark, {"title": "Vernissage Jasmine"}, {"title": "Jasmine", "start": day(25)}, {"title": "Concerts"}, {"title": "!!!", "start": day(3)})).collect()}
    assert got[("Vernissage Jasmine", day(20))] == "jasmine" and got[("Jasmine", day(25))] == "jasmine-2" and got[("Concerts", day(20))] == "concerts-2" and len(got[("!!!", day(3))]) == 8


def test_listing(spark):
    rows = [{"title": "Expo", "category": "expo", "start": day(1, 6), "end": day(30, 9)}, {"title": "Late", "start": day(2), "time": "22:00", "category": "danse"}, {"title": "Early", "start": day(2), "time": "09:00", "category": "danse"}, {"title": "Sometime", "start": day(2), "time": "00:00", "category": "danse"}, {"title": "Zoom", "start": day(2), "online": True}, {"title": "Past", "start": day(1, 6)}]
    e = resolve.normalize_events(events(spark, *rows))
    out = listing.listing(e, listing.ListingQuery(AS_OF))
    assert [r.title for r in out.feed.collect()] == ["Early", "Late", "Sometime"] and [r.title for r in out.standing.collect()] == ["Expo"]
    assert {r.category: r.n for r in out.facets.collect()} == {"expo": 1, "danse": 3}
    out = listing.listing(e, listing.ListingQuery(AS_OF, last=day(31), categories=frozenset({"danse"}), text="EAR"))
    assert [r.title for r in out.feed.collect()] == ["Early"] and out.standing.count() == 0
    t = listing.tallies(e, listing.ListingQuery(AS_OF)).first()
    assert (t.listings, t.standing, t.week) == (3, 1, 4)


def test_build_and_quality(spark):
    s = resolve.merge_snapshot(spark.createDataFrame([], SNAPSHOT), batch(spark, {"title": "YOGA SUR LA PLAGE 12H30", "note": "19:00 · Concert · Entrée libre", "category": "autre"}, {"title": "(ANNULÉE) Milonga"}, {"title": "Gone", "start": day(1, 6)}), F.lit(NOW).cast("timestamp_ntz")).drop("added", "merged")
    got = {r.title: r for r in build.build(s, AS_OF).collect()}
    assert set(got) == {"Yoga sur la Plage", "Milonga"}
    y = got["Yoga sur la Plage"]
    assert (y.time, y.note, y.free, y.category, y.slug) == ("12:30", "Entrée libre", True, "sport", "yoga-sur") and got["Milonga"].cancelled
    e = resolve.normalize_events(events(spark, {"time": "00:00", "note": "x", "venue": "v"}, {"venue": "v", "source": "b"}, {"start": day(1, 6), "note": "n", "price": "Gratuit"}))
    broken = sorted(r.rule for r in quality.event_violations(e, F.lit(AS_OF)).collect())
    assert broken == ["duplicate", "empty_note", "false_midnight", "past", "price_says_free"]
    assert quality.digest_allowed(0, 5) and quality.digest_allowed(5, 0) and quality.digest_allowed(500, 5) and not quality.digest_allowed(500, 5, True)


def test_ingest_whole(spark):
    raw = spark.createDataFrame([tuple((BASE | r).get(n) for n in NAMES) + (i,) for i, r in enumerate([{}, {"title": "Inscriptions 2026"}, {"title": "Bal", "start": day(9)}])], EVENT + ", seq long")
    out = build.ingest(spark.createDataFrame([], SNAPSHOT), raw, F.lit(NOW).cast("timestamp_ntz"), AS_OF, ["a"], ["a"])
    assert {r.title for r in out.collect()} == {BASE["title"], "Bal"}


def test_the_order_that_adapters_give_fits_the_merge(spark):
    """Sequences of the registry have more digits than a long holds."""
    from agendula.sources import adapters as A

    raw = spark.createDataFrame([("curated", 7, "u", '{"start":"2026-07-20","title":"Fete","town":"Nice"}\n{"start":"2026-07-20","title":"Fete","town":"Nice","venue":"Port"}')], "source string, doc long, url string, body string")
    rows = resolve.normalize_events(A.default_registry().extract(raw, AS_OF, ["curated"]))
    out = build.ingest(spark.createDataFrame([], SNAPSHOT), A.default_registry().extract(raw, AS_OF, ["curated"]), F.lit(NOW).cast("timestamp_ntz"), AS_OF, ["curated"])
    assert rows.count() == 2 and [(r.title, r.venue, r.sources) for r in out.collect()] == [("Fete", "Port", ["curated"])]
    log = build.run_log(rows, resolve.merge_snapshot(spark.createDataFrame([], SNAPSHOT), rows, F.lit(NOW).cast("timestamp_ntz")), F.lit(NOW))
    assert [(r.scraper, r.found, r.added) for r in log.collect()] == [("curated", 2, 1)]
