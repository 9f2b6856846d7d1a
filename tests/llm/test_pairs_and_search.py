"""SimHash, winnowing and top-k against brute force, with nulls, empties, ties and repeated rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from agendula.llm import simhash, topk, winnow

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def _texts(n=150, seed=1):
    r = random.Random(seed)
    out = [None, "", " \t\n", "One", "one", "a b", "A  B", "é " * 30]
    while len(out) < n:
        if len(out) > 20 and r.random() < 0.5:
            w = out[r.randrange(10, len(out))].split()
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.choice([3, 40, 200]))))
    return out


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_components_match_brute_force(spark):
    texts = _texts()
    ids = [*range(len(texts) - 2), None, 3]
    rows = [(d, t, "x") for d, t in zip(ids, texts, strict=True)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [_fingerprint(t) for t in texts]
    want = sorted((str(d), f"{f:016x}", str(c)) for d, f, c in zip(ids, fps, _components(fps, ids), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash_hot_bucket_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    r = np.random.default_rng(3)
    base = int(r.integers(1 << 62))
    fps = list({base ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in range(120)})
    rows = [(i, f.to_bytes(8, "little")) for i, f in enumerate(fps)]
    got = simhash.cluster(spark.createDataFrame(rows, "doc_id long, fp binary"), 1, 3).collect()
    want = _components(fps, range(len(fps)))
    assert {bytes(x.fp): x.component_id for x in got} == {f.to_bytes(8, "little"): c for f, c in zip(fps, want, strict=True)}


def test_long_runs_give_the_components_of_all_pairs():
    r = np.random.default_rng(5)
    fps = r.integers(0, 1 << 12, (60, 1)).astype(np.uint64)
    label = simhash._star(fps, 2)
    i, j = simhash._links(fps, np.zeros(60, int), 2)
    assert len(i) == (label != np.arange(60)).sum()
    want = _components([int(x) << 60 | int(x) for x in range(0)], []) or label
    assert (label == want).all()


def test_keep_one_keeps_one_of_each_group(spark):
    r = random.Random(9)
    base = " ".join(f"w{r.randrange(9999)}" for _ in range(300))
    near = base.replace(base.split()[100], "changed")
    other = " ".join(f"v{r.randrange(9999)}" for _ in range(300))
    half = " ".join(base.split()[:150] + other.split()[150:])
    rows = [(5, base), (2, near), (2, near), (9, base), (7, other), (11, half), (12, None), (13, ""), (None, other)]
    got = simhash.keep_one(spark.createDataFrame([(d, t, i % 2) for i, (d, t) in enumerate(rows)], "doc_id long, text string, h int")).collect()
    assert sorted(x.doc_id for x in got) == [2, 7, 11, 12]


def test_near_copies_over_the_threshold_are_found(spark):
    r = random.Random(4)
    rows, pairs = [], 60
    for i in range(pairs):
        w = [f"w{r.randrange(10**6)}" for _ in range(400)]
        v = list(w)
        for p in r.sample(range(400), 6):
            v[p] += "x"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept <= pairs + 1


@pytest.mark.parametrize("empty", ["near_duplicates", "keep_one"])
def test_simhash_empty_table(spark, empty):
    assert getattr(simhash, empty)(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _plain_winnow(text, k, w):
    p = [ord(c) for c in text]
    if not p:
        return []
    k = min(k, len(p))
    grams = [winnow._grams(np.array(p[i : i + k], np.uint32), k)[0] for i in range(len(p) - k + 1)]
    w = max(1, min(w, len(grams) // winnow.LEAST))
    chosen = {max((i for i in range(s, s + w) if grams[i] == min(grams[s : s + w]))) for s in range(len(grams) - w + 1)}
    return [(int(grams[i]), i) for i in sorted(chosen)]


@pytest.mark.filterwarnings("ignore:overflow")
def test_winnow_matches_definition():
    r = random.Random(2)
    for text in ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", *["".join(r.choice("abé𝒳") for _ in range(n)) for n in (5, 31, 32, 33, 95, 200)]]:
        for k, w in ((32, 64), (5, 4), (7, 13)):
            h, at = winnow.winnow(text, k, w)
            assert list(zip(h.tolist(), at.tolist(), strict=True)) == _plain_winnow(text, k, w)


def test_shared_passage_shares_a_hash():
    r = random.Random(8)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = rand(winnow.K + winnow.W - 1)
        a, b = (winnow.winnow(rand(r.randrange(300)) + passage + rand(r.randrange(300)))[0] for _ in "ab")
        assert len(np.intersect1d(a, b))


def test_fingerprints_follow_the_order_of_ids(spark):
    texts = _texts(90, 6)
    ids = [*range(100, 186), None, None, 5, 5]
    got = winnow.fingerprints(spark.createDataFrame([(d, t, 1) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, part int")).collect()
    assert len(got) == len(ids)
    rows = sorted((d, t or "") for d, t in zip(ids, texts, strict=True) if d is not None and d >= 100)
    by = {r.doc_id: r for r in got}
    for (d, t), (_, after) in zip(rows, rows[1:], strict=False):
        new = winnow.edited(t, after)
        assert len(new) == len(t) - len(t) // 2 + min(len(after), len(t) // 2)
        assert (by[d].n_chars, by[d].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        low = min(winnow.width(len(t)), winnow.width(len(after)))
        assert by[d].near_next == winnow.likeness(winnow.winnow(t, w=low)[0], winnow.winnow(after, w=low)[0])
    one = winnow.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]
    assert winnow.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _top(rows, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    ints = [(i, [int(np.floor(x * 64)) for x in v]) for i, v in good]
    out = []
    for q, a in ints:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ints if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 1e4, 1e6])
def test_top_k_matches_brute_force(spark, scale):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=8) * scale).tolist()) for i in range(150)]
    rows += [(200, None), (220, [1.0, None] * 4), (240, [float("nan")] * 8), (260, [float("inf")] * 8), (None, [1.0] * 8), (280, []), (300, [scale]), (301, rows[0][1]), rows[7]]
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<double>"), group=64, queries_a_task=4)
    assert sorted(map(tuple, got.collect())) == _top(rows, 20)


def test_top_k_bounds_over_many_blocks(monkeypatch):
    r = np.random.default_rng(2)
    x, q = r.integers(-30, 30, (900, 16)), r.integers(-30, 30, (25, 16))
    ids = r.permutation(900)
    got = topk.search(q, np.full(25, -1), x, ids, 10, block=100)
    s = q @ x.T
    for i in range(25):
        want = sorted((-int(v), int(c)) for v, c in zip(s[i], ids, strict=True))[:10]
        assert sorted((-v, c) for j, c, v in got if j == i) == want


def test_bounds_work_from_the_first_block_on(monkeypatch):
    """Few of the pairs of one small block get a final score."""
    resolved = []
    plain = topk._resolve
    monkeypatch.setattr(topk, "_resolve", lambda q, x, rows, columns: resolved.append(len(rows)) or plain(q, x, rows, columns))
    r = np.random.default_rng(4)
    x = np.floor(64 * r.normal(size=(500, 64)) / 8).astype(np.int64)
    got = topk.search(x[:25], np.arange(25), x, np.arange(500), 20)
    assert resolved[0] < 0.25 * 25 * 499
    s = x[:25] @ x.T
    for i in range(25):
        want = sorted((-int(v), c) for c, v in enumerate(s[i]) if c != i)[:20]
        assert sorted((-v, c) for j, c, v in got if j == i) == want


@pytest.mark.parametrize("big", [30, 10**30])
def test_bounds_hold_the_scores_at_every_depth(big):
    """Entries come in order, once each, and the bounds that they give enclose the scores."""
    r = np.random.default_rng(8)
    x, q = r.integers(-30, 30, (70, 5)), r.integers(-30, 30, (6, 5))
    if big > 30:
        x, q = x.astype(object) * big, q.astype(object)
    s, w = q @ x.T, np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    lists = topk.Lists(x)
    low, n = np.repeat((w @ lists.end)[:, None], 70, axis=1), 0
    for depth in topk.DEPTHS:
        fresh, gap = lists.read(depth)
        assert lists.seen.sum() == 10 * lists.place and lists.place > n
        n = lists.place
        low += w @ fresh.T
        high = low + (w @ gap)[:, None] - (w * gap) @ lists.seen.T
        assert (low <= s).all() and (s <= high).all()
    assert (low == s).all()


def test_clustered_vectors_leave_a_part_of_the_lists_unread(monkeypatch):
    read = []
    plain = topk.Lists.read
    monkeypatch.setattr(topk.Lists, "read", lambda self, depth: read.append(-self.place) or (plain(self, depth), read.append(read.pop() + self.place))[0])
    r = np.random.default_rng(9)
    centres = r.integers(-40, 40, (100, 32))
    x = centres[np.arange(4000) % 100] + r.integers(-2, 3, (4000, 32))
    got = topk.search(x[:40], np.arange(40), x, np.arange(4000), 20)
    assert sum(read) <= 0.75 * 4000
    s = x[:40] @ x.T
    for i in range(40):
        want = sorted((-int(v), c) for c, v in enumerate(s[i]) if c != i)[:20]
        assert sorted((-v, c) for j, c, v in got if j == i) == want


def test_top_k_among_clashing_columns(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=4).tolist(), i, 1.0, 2, 3) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<double>, g long, score double, rank int, v int"))
    assert sorted(map(tuple, got.collect())) == _top([x[:2] for x in rows], 20)


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "id long, vector array<float>")).collect() == []
