"""Vector codes, licence scans and fill-in-middle: contracts against brute force, nulls, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from agendula.llm import fim, license, vcode

VECTORS = "id long, vector array<float>, label int, code int, v string, __label string"


# --- vector codes


def _by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label) of every kept row, and the codebooks, with Python's integers alone."""
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v], label) for i, v, label, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return [], []
    width = max(parts, -(-max(len(v) for _, v, _ in kept) // parts) * parts)
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // parts
    part = lambda v, p: v[p * w : p * w + w]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = [(i, [near(part(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label) for i, f, label in found], books


def _vectors(n=150, width=16, seed=3):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(width)], r.choice([1, 1, 1, 2, None]), 0, "x", "y") for i in range(1, n)]
    return rows + [rows[4], rows[4], (None, [0.5] * width, 3, None, None, None), (-5, None, 1, 0, "", ""), (-4, [0.1, None], 1, 0, "", ""), (-3, [float("nan")] * width, 1, 0, "", ""), (-2, [float("inf")] * width, 1, 0, "", "")]


def test_codes_equal_a_full_comparison(spark):
    rows = _vectors()
    want, books = _by_hand(rows)
    totals = {}
    for _, _, e, label in want:
        totals[label] = totals.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    got = vcode.codes(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, c, e, totals[label], sha)) for i, c, e, label in want)


@pytest.mark.parametrize("rows", [_vectors(9), [(1, [0.25] * 16, None, 0, "", "")] * 40, [(i, [float(i)] * (i % 7), i % 2, 0, "", "") for i in range(30)], [(i, [3e30 * (-1) ** i, 1.5, 1e-9], 0, 0, "", "") for i in range(25)]], ids=["few", "equal", "unequal lengths", "huge"])
def test_odd_vectors(spark, rows):
    want, books = _by_hand(rows)
    coded, own = vcode.encode(spark.createDataFrame(rows, VECTORS))
    assert [b.tolist() for b in own] == books
    assert sorted(map(str, ((r["id"], r["code"], r["error"]) for r in coded.collect()))) == sorted(map(str, ((i, c, min(e, 2**63 - 1)) for i, c, e, _ in want)))
    assert vcode.codes(spark.createDataFrame(rows, VECTORS)).count() == len(want)


def test_no_vectors(spark):
    assert vcode.codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vcode.codes(spark.createDataFrame([(1, None, 2, 0, "", "")], VECTORS)).collect() == []


@pytest.mark.parametrize("spread", [1, 50, 40_000, 10**12])
def test_tree_finds_the_nearest_with_ties(spread):
    r = np.random.default_rng(spread)
    book = r.integers(-spread, spread + 1, (16, 3))
    book[7] = book[2]
    x = np.concatenate([r.integers(-spread, spread + 1, (400, 3)), book, (book[:8] + book[8:]) // 2])
    code, best, _ = vcode.nearest(vcode.tree(book), book, x)
    d2 = ((x.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(axis=2)
    assert [int(b) for b in best] == [min(row) for row in d2.tolist()]
    assert code.tolist() == [row.index(min(row)) for row in d2.tolist()]


def test_tree_leaves_distances_out():
    r = np.random.default_rng(0)
    book = np.concatenate([r.integers(0, 50, (4, 8)) + 10_000 * k for k in range(4)])
    x = np.repeat(book, 100, axis=0) + r.integers(-20, 21, (1600, 8))
    _, _, taken = vcode.nearest(vcode.tree(book), book, x)
    assert taken < 0.6 * 16 * len(x)


def test_decoding_is_near(spark):
    rows = [r for r in _vectors() if r[0] is not None and r[0] > 0]
    coded, books = vcode.encode(spark.createDataFrame(rows, VECTORS))
    by_id = {r[0]: np.array(r[1]) for r in rows}
    for r in coded.collect():
        apart = ((vcode.decode(r["code"], books) - by_id[r["id"]]) ** 2).sum()
        assert abs(apart - r["error"] / 4096**2) < 0.01


# --- licence scans

DOCS = "doc_id long, text string, row string, t int, label string"


def _scan(spark, texts, **more):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, DOCS), **more).collect()}


def test_phrases_are_counted_at_every_place(spark):
    r = random.Random(5)
    words = "cc by general public license all rights reserved GENERAL Cc-By é1".split()
    texts = [r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(60)]
    got = _scan(spark, texts)
    for i, text in enumerate(texts):
        w = re.findall(license.WORD, text.translate({c: c + 32 for c in range(65, 91)}))
        places = [(j, label) for p, label in license.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        starts = [j for j, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert got[i].base_labels == ",".join(sorted({label for _, label in places}))
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(",")) | {""}


def test_notices_with_edits(spark):
    mit = license.NOTICES[2][1].split()
    r = random.Random(1)
    changed = mit[:20] + ["new", "words"] + mit[20:40] + mit[42:]
    noise = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = [" ".join(noise(200) + changed + noise(300)), " ".join(noise(500)), " ".join(mit[:15]), " ".join(mit[::-1]), " ".join(noise(50) + mit + noise(50) + mit)]
    got = _scan(spark, texts)
    assert [got[i].labels for i in range(5)] == ["mit", "", "", "", "mit"]
    assert got[0].score > 0.85 and got[1].score == 0 and got[2].score < 0.5 and got[4].score == 1


def test_merged_diagonals_beat_single_ones(spark):
    notice = [f"w{i}" for i in range(40)]
    texts = [" ".join(notice[:20] + ["x"] + notice[20:]), " ".join(notice[:20] + ["x"] * 30 + notice[20:])]
    got = _scan(spark, texts, notices=[("own", " ".join(notice))])
    assert got[0].score == pytest.approx(40 / 41) and got[0].labels == "own"
    assert got[1].score == pytest.approx(0.5) and got[1].labels == ""
    assert _scan(spark, texts[:1], notices=[("own", " ".join(notice))], gap=0)[0].score == pytest.approx(0.5)


def test_scan_handles_odd_rows(spark):
    line = "All rights reserved. Released under the MIT License. "
    rows = [(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (None, line, None, None, None), (3, line, "x", 1, "y"), (3, line, "x", 1, "y"), (4, line * 20_000, "x", 1, "y"), (5, "\x00\t!", "x", 1, "y")]
    got = license.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.labels) for r in got) == sorted([("1", 0, 0, ""), ("2", 0, 0, ""), ("None", 8, 1, "mit,reserved"), ("3", 8, 1, "mit,reserved"), ("3", 8, 1, "mit,reserved"), ("4", 160_000, 20_000, "mit,reserved"), ("5", 0, 0, "")])
    assert license.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_scan_runs_no_python(spark):
    plan = license.scan(spark.createDataFrame([], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_too_many_template_runs_are_refused(spark):
    with pytest.raises(ValueError):
        license.scan(spark.createDataFrame([], DOCS), notices=[("x", " ".join(map(str, range(license.MOST_GRAMS + 9))))])


# --- fill in middle


def _expected(doc_id, text):
    text = text or ""
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


FIM = "doc_id long, text string, n string, form int, output string"


def _texts(n=400, seed=2):
    r = random.Random(seed)
    pool = ["a", "é", "漢", "😀", "<", ">", "P", "S", "M", "<P", "S>", "\n", "́", "\x00"]
    rows = [(i, "".join(r.choice(pool) for _ in range(r.randrange(0, 90))), "x", 1, "y") for i in range(n)]
    return rows + [(None, "abc", None, None, None), (7, None, "x", 1, "y"), (8, "", "x", 1, "y"), rows[3], rows[3], (9, "long é😀" * 200_000, "x", 1, "y"), (10, "a<M>b", "x", 1, "y")]


def test_cuts_and_round_trip(spark):
    rows = _texts()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, *_expected(i, t)[:4], sha(_expected(i, t)[4]), sha(t)) for i, t, *_ in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = fim.digests(spark.createDataFrame(rows, FIM).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_other_columns_pass_through(spark):
    rows = _texts(40)
    cut = fim.transform(spark.createDataFrame(rows, FIM))
    assert cut.schema["row"].dataType.names == ["doc_id", "n", "form", "output"]
    back = fim.restore(cut).select("row.doc_id", "row.output", "restored").collect()
    assert sorted(str((r.doc_id, bytes(r.restored).decode())) for r in back) == sorted(str((i, t or "")) for i, t, *_ in rows)
    assert fim.digests(spark.createDataFrame([], FIM)).collect() == []


def test_rank_and_select_agree_with_counting():
    r = np.random.default_rng(4)
    for share in (0.02, 0.5, 0.99):
        starts = r.random(5000) < share
        marks = fim.Boundaries(starts)
        assert marks.before[-1] == starts.sum()
        places = r.integers(0, 5001, 300)
        assert marks.rank(places).tolist() == [int(starts[:p].sum()) for p in places]
        assert marks.select(np.arange(starts.sum())).tolist() == np.flatnonzero(starts).tolist()
