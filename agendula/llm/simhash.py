"""Near-duplicates by SimHash: fingerprints, blocks by the pigeonhole principle, verified Hamming distance, components.

A fingerprint bit is 1 if it is set in over half of the shingles' hashes. Two schemes of blocks are used:

* ``combinations``: 64-bit fingerprints are split into ``blocks`` blocks; pairs within ``distance`` bits leave at least
  ``blocks - distance`` of them untouched, so joining on every choice of that many blocks finds all such pairs, exactly.
* ``long``: for a wide distance (a similarity of 0.8 lets 15 % of the bits differ) 512-bit fingerprints are split into blocks again
  and again, each time in another order of the bits. Blocks have 16 bits, and more for more rows, so that a bucket holds a bounded
  number of chance meetings; there are as many as leave a pair at the wanted similarity apart with probability ``MISS``. They find
  candidates, within ``MARGIN`` standard deviations of the expected distance.

``keep_one`` decides by the exact Jaccard similarity of shingle sets. Candidate links make candidate components, and inside each of
these every pair that is not yet connected is held against the sets themselves, through an index from shingle to texts; so a text
meets all texts of its candidate component, whichever pairs the blocks found. Texts of up to ``BRIEF`` distinct shingles say too
little in a fingerprint: they meet by the least shingles of each (alike sets share one of those, exactly; shingles of more than
``FREQUENT`` texts come last in the order).

Rows meet by block key; each bucket is compared with vector operations and passes on edges that connect it, not its pairs:
a star around the least member of each component that its links make. A bucket above
``HOT`` rows is cut into chunks, and every two chunks meet in a group of their own, so no task holds a bucket. A candidate component
above ``HOT`` rows is connected chunk by chunk, then by one text of every part found, and only the texts still outside its largest
part meet all others. Components come from alternating large and small stars over edges, each round written to the shared folder.

Defined results: null and wordless texts have fingerprint zero and link like any other; repeated rows have one component; a
null doc_id is never a component's id unless the component has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, discard, lean, popcount, small, utf8

SHORT, HOT, CHUNK = 24, 4096, 1 << 20
BRIEF, MARGIN, MISS, FREQUENT = 64, 4.0, 0.002, 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by spaces, A-Z lowered; fewer words: of all of them."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((xxh64_intdigest(r, seed) for r in runs), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprint of ``words`` 64-bit words; those after the first use hashes derived from each shingle's hash."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros(64 * words, np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), 4096):
            part = hashes[a : a + 4096, None]
            if words > 1:
                part = part + _GOLDEN * np.arange(words, dtype=np.uint64)
                part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                part ^= part >> np.uint64(31)
            bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little")
            # Sums of up to 255 rows fit in a byte, which keeps the first step narrow.
            for b in range(0, len(bits), 255):
                ones += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def _fingerprint(batches: Batches, shingle: int, words: int, distinct: bool) -> Batches:
    for batch in batches:
        out = []
        for text in utf8(batch["text"]):
            h = shingle_hashes(text, shingle)
            out.append(majority(np.unique(h) if distinct else h, words).tobytes())
        yield batch.drop_columns(["text"]).append_column("fp", pa.array(out, type=pa.binary()))


def fingerprints(rows: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """``rows`` with fp (binary, little-endian) in place of text. ``distinct``: each shingle of a text counts once."""
    lean(rows.sparkSession)
    run = partial(_fingerprint, shingle=shingle, words=words, distinct=distinct)
    rest = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", fp binary"
    return rows.select(*[f.name for f in rest], "text").mapInArrow(run, schema)


class Scheme:
    """Block keys of fingerprints: an (n, keys) array of 64-bit values. ``rows`` and ``share`` (of differing bits) size the long scheme."""

    def __init__(self, words: int, distance: int, blocks: int = 5, rows: int = 0, share: float = 0.15):
        self.words, self.distance = words, distance
        if words == 1:
            edges = np.linspace(0, 64, blocks + 1).round().astype(int)
            parts = [sum(1 << b for b in range(a, z)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            self.masks = np.array([sum(c) for c in combinations(parts, blocks - distance)], dtype=np.uint64)
            self.n = len(self.masks)
        else:
            self.bits = bits = min(64, max(16, math.ceil(math.log2(max(rows, 2))) - 6))
            once = 64 * words // bits
            splits = math.ceil(math.log(1 / MISS) / (1 - share) ** bits / once)
            rng = np.random.default_rng(7)
            self.orders = [rng.permutation(64 * words)[: once * bits] for _ in range(splits)]
            self.n = once * splits

    def keys(self, fps: np.ndarray) -> np.ndarray:
        if self.words == 1:
            return (fps & self.masks).astype(np.uint64)
        bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
        out = np.zeros((len(fps), self.n, 8), np.uint8)
        blocks = np.concatenate([bits[:, o].reshape(len(fps), -1, self.bits) for o in self.orders], axis=1)
        out[:, :, : -(-self.bits // 8)] = np.packbits(blocks, axis=2, bitorder="little")
        return out.view(np.uint64)[:, :, 0]


def share_apart(similarity: float) -> float:
    """Share of bits expected to differ at a Jaccard similarity of sets of about one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_apart(similarity: float, bits: int, margin: float = 1.0) -> int:
    """Differing bits expected at a Jaccard similarity, plus ``margin`` standard deviations."""
    share = share_apart(similarity)
    return round(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def blocks_for(n: int, distance: int = 3) -> int:
    """Blocks whose joint key is so long that random meetings stay below a few a row; every choice is exact."""
    blocks = distance + 2
    while blocks < distance + 5 and 64 * (blocks - distance) / blocks < math.log2(max(n, 1)) + 4:
        blocks += 1
    return blocks


def _array(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _blocks(batches: Batches, scheme: Scheme) -> Batches:
    """A row a key, into which the block's number is mixed: a chance meeting of two blocks costs a comparison and no more."""
    band = np.arange(scheme.n, dtype=np.uint64) * _GOLDEN
    for batch in batches:
        step = max(1, 32_768 // scheme.n)
        for a in range(0, len(batch), step):
            part = batch.slice(a, step)
            with np.errstate(over="ignore"):
                keys = (scheme.keys(_array(part["fp"], scheme.words)) ^ band) * np.uint64(0xBF58476D1CE4E5B9)
            fp = part["fp"].take(pa.array(np.tile(np.arange(len(part)), scheme.n)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel().view(np.int64)), fp], ["key", "fp"])


def _star(fps: np.ndarray, distance: int, step: int = 512) -> np.ndarray:
    """Index of the first member of each row's component under links within ``distance`` bits."""
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        for a in range(0, len(fps), step):
            apart = popcount(fps[a : a + step, None, :] ^ fps[None, :, :]).sum(axis=2, dtype=np.uint16)
            new[a : a + step] = np.where(apart <= distance, label[None, :], len(fps)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _least(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' components."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        low, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(fps: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (row, least row) of the components within the groups, which are runs of equal numbers."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    brief = np.repeat(sizes <= SHORT, sizes)
    for s in range(1, min(int(sizes.max(initial=0)), SHORT)):
        i = np.flatnonzero((group[:-s] == group[s:]) & brief[:-s])
        if len(i):
            i = i[popcount(fps[i] ^ fps[i + s]).sum(axis=1) <= distance]
            left.append(i)
            right.append(i + s)
    label = _least(len(group), np.concatenate(left), np.concatenate(right))
    for a, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        label[a : a + n] = a + _star(fps[a : a + n], distance)
    at = np.flatnonzero(label != np.arange(len(group)))
    return at, label[at]


class _Index:
    """Sets of one group by element, for the sets as similar as a given one."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes, self.similarity = np.array([len(x) for x in sets]), similarity
        of = np.repeat(np.arange(len(sets)), self.sizes)
        _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[which] > 1
        which, of = which[shared], of[shared]
        self.own = np.split(which, np.searchsorted(of, np.arange(1, len(sets))))
        self.by = of[np.argsort(which, kind="stable")]
        self.n = np.where(count > 1, count, 0)
        self.at = np.cumsum(self.n) - self.n

    def alike(self, i: int) -> np.ndarray:
        """Whether each set is as similar to set ``i``."""
        n = self.n[self.own[i]]
        places = np.repeat(self.at[self.own[i]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.by[places], minlength=len(self.sizes))
        out = common >= self.similarity * (self.sizes + self.sizes[i] - common) - 1e-9
        out[i] = True
        return out


def _forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the components of sets that are as similar."""
    index, left, out = _Index(sets, similarity), np.ones(len(sets), bool), []
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            i = queue.pop()
            found = np.flatnonzero(left & index.alike(i)).tolist()
            left[found] = False
            queue += found
            out += [(i, j) for j in found]
    return out


def _outside(sets: list[np.ndarray], labels: np.ndarray, outside: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """An edge from each set that is ``outside`` to every other label that it is as similar to."""
    index, out = _Index(sets, similarity), []
    for i in np.flatnonzero(outside).tolist():
        found = np.flatnonzero(index.alike(i) & (labels != labels[i]))
        out += [(i, int(found[k])) for k in np.unique(labels[found], return_index=True)[1]]
    return out


def _whole_groups(batches: Batches, by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``by``, with the places where groups start and the last one ends.

    The last, perhaps unfinished group of a batch waits for the next batch.
    """
    held = None

    def groups(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        ids = np.stack([np.asarray(t[c]).astype(np.int64) for c in by])
        change = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
        return t, np.concatenate(([0], np.flatnonzero(change) + 1, [len(t)]))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held):
            same = np.logical_and.reduce([np.asarray(held[c]) == held[c][-1].as_py() for c in by])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield groups(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None and len(held):
        yield groups(held)


def _alike_sets(batches: Batches, similarity: float) -> Batches:
    """Rows (cand, part, node, shingles[, label, outside]) by group to edges."""
    for t, starts in _whole_groups(batches, ("cand", "part")):
        node, found = t["node"].combine_chunks(), []
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if z - a > 1:
                sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].slice(a, z - a).to_pylist()]
                if "label" in t.column_names:
                    labels = np.unique(np.array(t["label"].slice(a, z - a).to_pylist(), object), return_inverse=True)[1]
                    edges = _outside(sets, labels, np.asarray(t["outside"].slice(a, z - a)), similarity)
                else:
                    edges = _forest(sets, similarity)
                found += [(a + i, a + j) for i, j in edges]
        i, j = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([node.take(i), node.take(j)], ["u", "v"])


def alike(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (cand, node, shingles) to edges (u, v) that connect all nodes of a ``cand`` whose sets are as similar."""
    run = lambda r: r.repartition("cand", "part").sortWithinPartitions("cand", "part").mapInArrow(partial(_alike_sets, similarity=similarity), "u binary, v binary")
    chunk = lambda n, c: F.pmod(F.xxhash64(c), F.greatest(F.ceil(n / HOT), F.lit(1))).cast("int")
    hot = cut(rows.groupBy("cand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "simhash-hot")
    n_hot = hot.count()
    if not n_hot:
        return cut(run(rows.withColumn("part", F.lit(0))), "simhash-alike")
    hot = small(hot, n_hot)
    rows = cut(rows.join(hot, "cand", "left").withColumn("part", F.when(F.col("n").isNull(), 0).otherwise(chunk(F.col("n"), "node"))), "simhash-parts")
    edges = cut(run(rows.select("cand", "part", "node", "shingles")), "simhash-alike")
    big = rows.where("n is not null")

    def labelled() -> DataFrame:
        roots = components(edges)
        return cut(big.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")), "simhash-labelled")

    # One text of every part that a chunk fell into.
    now = labelled()
    heads = now.groupBy("cand", "part", "label").agg(F.min(F.struct("node", "shingles")).alias("head")).select("cand", "head.*")
    heads = cut(heads, "simhash-heads")
    counts = heads.groupBy("cand").agg(F.count(F.lit(1)).alias("n"))
    edges = cut(edges.union(run(heads.join(counts, "cand").select("cand", chunk(F.col("n"), "node").alias("part"), "node", "shingles"))), "simhash-alike")
    # Whatever stays outside the largest part meets every chunk.
    now = labelled()
    sizes = cut(now.groupBy("cand", "label").agg(F.count(F.lit(1)).alias("k")), "simhash-sizes")
    best = sizes.groupBy("cand").agg(F.max(F.struct("k", "label"))["label"].alias("most"), (F.sum("k") - F.max("k")).alias("out"))
    now = now.join(small(best, n_hot), "cand").where("out > 0").withColumn("outside", F.col("label") != F.col("most"))
    chunks, parts = F.ceil(F.col("n") / HOT).cast("int"), F.ceil(F.col("out") / HOT).cast("int")
    pick = ["cand", "node", "shingles", "label"]
    mine = now.where("outside").select(*pick, chunk(F.col("out"), "node").alias("o"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"), "outside", F.lit(-1).alias("own"), chunks.alias("w"))
    others = now.select(*pick, F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"), F.col("part").alias("c"), F.lit(False).alias("outside"), F.lit(1).alias("own"), chunks.alias("w"))
    met = mine.unionByName(others).withColumn("part", F.col("o") * F.col("w") + F.col("c")).select(*pick, "part", "outside")
    return cut(edges.union(run(met)), "simhash-alike")


def _verify(batches: Batches, words: int, distance: int, by: tuple[str, ...]) -> Batches:
    for t, starts in _whole_groups(batches, by):
        fps = t["fp"].combine_chunks()
        i, j = _links(_array(fps, words), np.repeat(np.arange(len(starts) - 1), np.diff(starts)), distance)
        yield pa.RecordBatch.from_arrays([fps.take(pa.array(i)), fps.take(pa.array(j))], ["u", "v"])


def links(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) whose components are those of all pairs within the scheme's distance.

    Rows meet by key; a hot key's rows in chunks by their hash, every two of which meet.
    """
    rows, by = fps.select("fp").mapInArrow(partial(_blocks, scheme=scheme), "key long, fp binary"), ("key",)
    hot = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "simhash-hot")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(small(hot, n_hot), "key", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows, by = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp"), ("key", "a", "b")
    met = rows.repartition(*by).sortWithinPartitions(*by, "fp")
    return met.mapInArrow(partial(_verify, words=scheme.words, distance=scheme.distance, by=by), "u binary, v binary")


def _stars(batches: Batches) -> Batches:
    """All edges of a task to a star around the least node of each of their components."""
    held = [b for b in batches if len(b)]
    if held:
        t = pa.Table.from_batches(held)
        both = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).combine_chunks().dictionary_encode()
        values = both.dictionary.to_pylist()
        order = np.array(sorted(range(len(values)), key=values.__getitem__))
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        ends = place[np.asarray(both.indices)]
        label = _least(len(order), ends[: len(t)], ends[len(t) :])
        at = np.flatnonzero(label != np.arange(len(order)))
        pick = lambda x: both.dictionary.take(pa.array(order[x]))
        yield pa.RecordBatch.from_arrays([pick(at), pick(label[at])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) to (node, root), root the least node of its component; nodes without an edge do not appear.

    The joins' sides are tables, so that adaptive execution can split a node with many edges.
    """
    out = lambda e: e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc")
    n, before = e.count(), None
    while n and (before is None or n < before / 2):
        tasks = -(-n // CHUNK)
        e, gone = cut(e.repartition(tasks).mapInArrow(_stars, e.schema).distinct(), "cc"), e
        discard(gone)
        if tasks == 1:
            return out(e)
        n, before = e.count(), n
    marks = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = marks(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "cc")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        new = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(new.where("u != v").distinct(), "cc")
        now = marks(new)
        for done in (e, least, large, low):
            discard(done)
        e, before, mark = new, mark, now
        if before == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return out(e)


def cluster(marked: DataFrame, scheme_words: int, distance: int) -> DataFrame:
    """Rows (doc_id, fp) to (fp, component_id): every distinct fingerprint with the smallest doc_id reachable from it."""
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    scheme = Scheme(scheme_words, distance, blocks_for(first.count(), distance))
    roots = components(links(first, scheme))
    # Both sides of the last join are tables, so that a component with many members can be split.
    rooted = cut(first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    return cut(rooted.select("fp", "root").join(least, "root"), "simhash-map")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    marked = cut(fingerprints(docs.select("doc_id", "text"), shingle), "simhash-rows")
    out = marked.join(cluster(marked, 1, distance), "fp")
    digits = F.lower(F.hex("fp"))  # the least significant byte first
    return out.select("doc_id", F.concat(*[F.substring(digits, a, 2) for a in range(15, 0, -2)]).alias("fingerprint"), "component_id")


def _classes(batches: Batches, shingle: int, words: int, most: int) -> Batches:
    """text to node (digest of its shingle set), fp, n (shingles) and, of brief texts, the shingles."""
    from xxhash import xxh128_digest

    for batch in batches:
        node, fp, n, brief = [], [], [], []
        for text in utf8(batch["text"]):
            h = np.unique(shingle_hashes(text, shingle))
            node.append(xxh128_digest(h.tobytes()))
            fp.append(majority(h, words).tobytes())
            n.append(len(h))
            brief.append(h.tobytes() if len(h) <= most else None)
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(node, pa.binary()), pa.array(fp, pa.binary()), pa.array(n, pa.int32()), pa.array(brief, pa.binary())], [*rest.schema.names, "node", "fp", "n", "shingles"])


def _elements(batches: Batches) -> Batches:
    """Sets (node, n, shingles) to a row an element."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([batch["node"].take(at), batch["n"].take(at), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["node", "n", "s"])


def _first_shingles(brief: DataFrame, similarity: float) -> DataFrame:
    """(cand, node): the first shingles of each set, so many that a set as similar has one of them among its own first.

    The order has shingles of many sets last, so that a line that many texts share brings together only texts that hold
    little else.
    """
    elements = brief.mapInArrow(_elements, "node binary, n int, s long")
    hot = cut(elements.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > FREQUENT).select("s", F.lit(1).alias("last")), "simhash-frequent")
    marked = elements.join(small(hot, hot.count()), "s", "left")
    ordered = marked.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("last", F.lit(0)).alias("last"), "s"))).alias("x"))
    first = F.slice("x", F.lit(1), (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).cast("int"))
    return ordered.select("node", F.explode(first).alias("x")).select(F.col("x.s").alias("cand"), "node")


def _sets(batches: Batches, shingle: int) -> Batches:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in utf8(batch["text"])]
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], [*rest.schema.names, "shingles"])


def alike_classes(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, text) to classes of equal shingle sets (node, best row, ...) and edges (u, v) that connect alike ones."""
    words = 8
    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = texts.mapInArrow(partial(_classes, shingle=shingle, words=words, most=int(BRIEF / similarity)), f"doc_id {kind}, h long, node binary, fp binary, n int, shingles binary")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best")
    nodes = cut(marked.groupBy("node").agg(best, F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("shingles").alias("shingles")), "simhash-nodes")
    brief = nodes.where("shingles is not null and n > 0").select("node", "n", "shingles")
    edges = alike(cut(_first_shingles(brief, similarity).join(brief.drop("n"), "node"), "simhash-brief"), similarity)

    long = nodes.where(F.col("n") > BRIEF).select("node", "fp", "best", F.xxhash64("fp").alias("cand"))
    fps = cut(long.select("fp").distinct(), "simhash-fingerprints")
    scheme = Scheme(words, bits_apart(similarity, 64 * words, MARGIN), rows=fps.count(), share=share_apart(similarity))
    # Two fingerprints under one 64-bit name only widen a candidate component.
    joined = components(links(fps, scheme).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")))
    long = long.join(joined, F.col("cand") == joined["node"], "left").select(long["node"], F.coalesce("root", "cand").alias("cand"), F.col("best.doc_id").alias("id"), F.col("best.h").alias("bh"))
    long = cut(long, "simhash-candidates")
    several = cut(long.groupBy("cand").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cand"), "simhash-several")
    wanted = cut(long.join(small(several, several.count()), "cand", "left_semi"), "simhash-wanted")
    found = texts.join(small(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("bh"))).select("cand", "node", "text")
    sets = cut(found.mapInArrow(partial(_sets, shingle=shingle), "cand long, node binary, shingles binary").dropDuplicates(["node"]), "simhash-sets")
    return nodes, edges.union(alike(sets, similarity))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every near-duplicate group, that of the smallest doc_id.

    Of rows that repeat that id, the one whose content hash is least stays, and one of wholly equal rows; a group without any
    id keeps one row likewise.
    """
    lean(docs.sparkSession)
    content = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    nodes, edges = alike_classes(docs.select("doc_id", content.alias("h"), "text"), shingle, similarity)
    rooted = nodes.select("node", "best").join(components(edges), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    best = cut(rooted.select(F.col("best.doc_id").alias("__id"), F.col("best.h").alias("__kept")), "simhash-kept")
    rows = docs.select(F.col("doc_id").alias("__d"), content.alias("__h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = rows.join(best, F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kept")), "left_semi")
    return found.dropDuplicates(["__d", "__h"]).select("__row.*")
