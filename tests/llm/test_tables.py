"""Mixing, sharding and the archive: contracts, brute force, nulls, ties, repeated rows and empty tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from agendula.llm import mix, queries, shard, warc

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size int, shard string"


def _docs(n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(60))), r.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"]), "en", 0, 1, "x") for i in range(n)]
    rows += [(None, "a b", "a", None, None, None, None), (5, None, "c", "en", 1, 1, "y"), (6, "", None, "en", 1, 1, "y"), rows[3], rows[3]]
    return rows


def _targets(sizes):
    """Fill by weight, cap, and share the excess again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(capped.values())
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return t | capped
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_contract(spark):
    rows = _docs()
    got = mix.mix_words(spark.createDataFrame(rows, DOCS)).collect()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = _targets(sizes)
    assert len(got) == len(rows) and sorted(r.source_size for r in got) == sorted(sizes[x[2]] for x in rows)
    assert sorted(round(r.target, 6) for r in got) == sorted(round(want[x[2]], 6) for x in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] * 2 >= r.taken >= 0 and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.target, r.source_size] += r.taken
    for (target, _), n in taken.items():
        assert abs(n - target) <= 0.1 * target + 30
    again = mix.mix_words(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_matches_sql(spark, tmp_path):
    spark.createDataFrame(_docs(), DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_source_mix(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"select doc_id, size, source_size, target, taken from ({queries.SQL['op4_source_mix']})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(key(r) for r in want) == sorted(key((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in got)


def test_emit_repeats_whole_rows(spark):
    df = spark.createDataFrame(_docs(), DOCS)
    took = {r.doc_id: r.taken // r["size"] for r in mix.mix_words(df).collect() if r["size"]}
    out = Counter(r.doc_id for r in mix.emit(df).collect())
    rows = Counter(x[0] for x in _docs())
    assert all(out.get(d, 0) == n * rows[d] for d, n in took.items() if d not in (5, 6))
    assert mix.emit(df).columns == df.columns


def test_mix_empty_and_wordless(spark):
    assert mix.mix_words(spark.createDataFrame([], DOCS)).collect() == []
    got = mix.mix_words(spark.createDataFrame([(1, None, "a", "", 0, 0, "")], DOCS)).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)]


def _greedy(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, k))
    return sorted(x for x, _ in heap)


def test_shards(spark):
    rows = _docs(800) + [(10_000 + i, "copy " * 40, "a", "en", 0, 0, "z") for i in range(90)] + [(20_000, "long " * 300_000, "a", "en", 0, 0, "z")]
    got = shard.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    raw = [((t or "").encode(), d) for d, t, *_ in rows]
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len(t) + 1, zlib.crc32(t)) for t, d in raw)
    by_text, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        by_text[r["size"], r.text_crc32].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for t, _ in raw:
        groups[t] += len(t) + 1
    assert sorted(loads[k] for k in range(16)) == _greedy(groups.values(), 16)


def test_runs_of_equal_sizes_are_poured_as_the_heap_deals_them():
    r = random.Random(3)
    for _ in range(60):
        shards, sizes = r.choice([1, 2, 5, 16]), {r.randrange(1, 60): r.choice([1, 2, 70, 300, 1000]) for _ in range(r.randrange(1, 9))}
        took = shard.lpt(list(sizes.items()), shards)
        assert all(sum(took[s]) == n for s, n in sizes.items())
        loads = sorted(sum(s * took[s][k] for s in sizes) for k in range(shards))
        assert loads == _greedy([s for s, n in sizes.items() for _ in range(n)], shards)


def test_shards_slots_over_many_cells(spark):
    df = spark.range(500).selectExpr("id as doc_id", "cast(id % 3 as int) as shard", "id as __row")
    got = shard.slots(df, "shard", df["doc_id"], per_cell=20).collect()
    for k in range(3):
        s = sorted(r.slot for r in got if r["shard"] == k)
        assert s == list(range(len(s)))


def test_schedule_is_written_in_chunks(spark):
    """Any size of chunk gives the same shards."""
    rows = spark.range(300).selectExpr("id as key", "id % 37 + 1 as size")
    want = {tuple(r) for r in shard.assign(rows, "key", "size", 5).collect()}
    assert {tuple(r) for r in shard.assign(rows, "key", "size", 5, chunk=4).collect()} == want
    loads = defaultdict(int)
    for r in want:
        loads[r[2]] += r[1]
    assert sorted(loads.values()) == _greedy([k % 37 + 1 for k in range(300)], 5)


def test_shards_empty(spark):
    assert shard.shard_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 2000
    rows = [(1, "http://a", big), (7, "http://b\r\nWARC-Type: forged", big), (3, None, big), (7, "http://b2", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", big), (9, "u", "y" * 1000), (10, "u", "\r\n\r\n" + "z" * 1000), (None, "n", "only" * 300)]
    df = spark.createDataFrame([(a, b, c, "e") for a, b, c in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(df).collect()
    top = {}
    for p, _, h in rows:
        h = (h or "").encode()
        top[h] = max(top.get(h, -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        last = top[raw] if top[raw] >= 0 else None
        revisit = len(raw) >= 1000 and p != last
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    folder = f"file://{tmp_path}/w"
    warc.write(df, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, _, h in rows})
    back = warc.records(warc.read(spark, folder)).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in back} == {(h or "").encode() for _, _, h in rows}
    whole = [bytes(r.record) for r in warc.read(spark, folder).collect()]
    assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") and b"\r\nWARC-Date: " in x for x in whole)
    ids = [re.search(rb"WARC-Record-ID: (<\S+>)", x)[1] for x in whole]
    assert len(set(ids)) == len(rows) and {x for r in whole for x in re.findall(rb"WARC-Refers-To: (<\S+>)", r)} <= set(ids)


def test_archive_of_a_very_long_page_among_clashing_columns(spark):
    big = "é" * 2_000_000
    rows = [(1, "u", big, "a", 0), (2, "u", big, "b", 1)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, address string, place int")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(1, 4_000_000, "revisit", 2), (2, 4_000_000, "response", None)]


def test_archive_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_addresses_come_back_as_they_were(spark, tmp_path):
    rows = [(1, "http://x/é", "a"), (2, "http://x/漢?q=😀", "é" * 1200), (3, "http://x/plain", "é" * 1200), (4, None, None)]
    folder = f"file://{tmp_path}/archive"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.page_id: (r.target_uri, r.record_type, bytes(r.payload).decode()) for r in warc.records(warc.read(spark, folder)).collect()}
    assert got == {1: ("http://x/é", "response", "a"), 2: ("http://x/漢?q=😀", "revisit", ""), 3: ("http://x/plain", "response", "é" * 1200), 4: ("", "response", "")}
