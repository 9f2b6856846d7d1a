"""Document fingerprints by winnowing.

The rolling hash of every ``k`` code points is taken, and of every window of ``w`` neighbouring hashes the smallest, the
rightmost of equals; each chosen hash is kept once with its position. Two texts that share a passage of ``w + k - 1`` code
points or more share a chosen hash, wherever the passage stands. A text of fewer than ``LEAST * w`` hashes has windows of a
``LEAST``-th of them instead, so that its likeness does not hang on a few hashes: what a window chooses, the smaller windows
inside it choose too, so the guarantee holds between texts of any lengths. A text with fewer than ``k`` points is one hash of
the whole; the empty text has the empty fingerprint.

The fingerprint is written as ``hash@step`` parts joined by ',': the hash in 8 hex digits, then the distance from the position
before. Likeness of two fingerprints is the share of distinct hashes they have in common (Jaccard), both taken with the smaller of
their two windows, so that texts of unlike length are sampled alike; two empty ones are alike (1.0).

The next document (ascending doc_id) is found without a global window. Quantiles of the ids alone cut the order into ranges;
texts are compressed, dealt by range and read in order there, and only a range's last text meets the first text of the next
range in a separate small join.

Defined results: null text counts as empty; null doc_ids come first in the order; among repeated ids a hash of the text decides; a table
of one document has itself as the next; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, lean, small, utf8

K, W, LEAST = 16, 64, 16
#: Bytes of text in a range of ids.
RANGE = 32_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of ``k`` points, by joining runs of doubling length: h(ab) = h(a) * B^|b| + h(b)."""
    one = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    one ^= one >> np.uint64(29)
    have, length, power, run, run_power, left = None, 0, None, one, _BASE, k
    size = 1
    while left:
        if left & 1:
            if have is None:
                have, length, power = run, size, run_power
            else:
                n = len(points) - length - size + 1
                have = have[:n] * run_power + run[length : length + n]
                length, power = length + size, power * run_power
        left >>= 1
        if left:
            n = len(points) - 2 * size + 1
            run = run[:n] * run_power + run[size : size + n]
            run_power = run_power * run_power
            size *= 2
    have = have * _MIX
    return (have ^ (have >> np.uint64(32))).astype(np.uint32)


def width(n: int, k: int = K, w: int = W) -> int:
    """The window of a text of ``n`` points."""
    return max(1, min(w, (n - min(k, n) + 1) // LEAST))


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen, by rising position."""
    points = _points(text)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = _grams(points, min(k, len(points)))
    # A smaller key is a smaller hash, or among equals one further right.
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w = width(len(points), k, w)
    size, low = 1, key
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(h) - w + 1], low[w - size : w - size + len(h) - w + 1])
    at = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return h[at], at


def write(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    h, at = chosen
    return ",".join(map("%08x@%d".__mod__, zip(h.tolist(), np.diff(at, prepend=0).tolist(), strict=True)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def alike(a: str, own_a: tuple, b: str, own_b: tuple, k: int = K, w: int = W) -> float:
    """Likeness of two texts with what was chosen of each, at the smaller of their windows."""
    low = min(width(len(a), k, w), width(len(b), k, w))
    at = lambda t, own: own if width(len(t), k, w) == low else winnow(t, k, low)
    return likeness(at(a, own_a)[0], at(b, own_b)[0])


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NULLS = 64  # ranges for rows without an id, by the top bits of the text's hash


def _row(doc_id, text: str, own: tuple, after: str, after_own: tuple, k: int, w: int) -> tuple:
    changed = edited(text, after)
    new = winnow(changed, k, w)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), write(own), write(new), alike(text, own, changed, new, k, w), alike(text, own, after, after_own, k, w)


def _table(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=schema.field(i).type) for i in range(len(names))], schema=schema)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _ranges(ids: pa.Array, ties: pa.Array, bounds: np.ndarray) -> pa.Array:
    null = np.asarray(ids.is_null())
    at = _NULLS + np.searchsorted(bounds, np.asarray(ids.fill_null(0)), side="right")
    return pa.array(np.where(null, (np.asarray(ties) >> 58) + _NULLS // 2, at).astype(np.int32))


def _number(batches: Batches, bounds: np.ndarray) -> Batches:
    for b in batches:
        yield pa.RecordBatch.from_arrays([_ranges(b["doc_id"], b["tie"], bounds), b["doc_id"], b["tie"]], ["part", "doc_id", "tie"])


def _pack(batches: Batches, bounds: np.ndarray) -> Batches:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        blobs = pa.array([squeeze(x) for x in utf8(b["text"])], type=pa.binary())
        yield pa.RecordBatch.from_arrays([_ranges(b["doc_id"], b["tie"], bounds), b["doc_id"], b["tie"], blobs], ["part", "doc_id", "tie", "blob"])


def _walk(batches: Batches, k: int, w: int) -> Batches:
    """Rows in order of range and id: a result for each whose next is in the same range."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    before, at, out, size = None, None, [], 0
    for batch in batches:
        for part, doc_id, blob in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            text = unpack(blob).decode("utf-8", "surrogatepass") if blob else ""
            own = winnow(text, k, w)
            if before is not None and part == at:
                out.append(_row(*before, text, own, k, w))
                size += len(out[-1][3]) + len(out[-1][4])
            before, at = (doc_id, text, own), part
            if len(out) >= 2000 or size > 8_000_000:
                yield _table(out, _SCHEMA.names, _SCHEMA)
                out, size = [], 0
    if out:
        yield _table(out, _SCHEMA.names, _SCHEMA)


def _pairs(batches: Batches, k: int, w: int) -> Batches:
    for batch in batches:
        for doc_id, text, after in zip(*[batch[c].to_pylist() for c in ("doc_id", "text", "after")], strict=True):
            yield _table([_row(doc_id, text, winnow(text, k, w), after, winnow(after, k, w), k, w)], _SCHEMA.names, _SCHEMA)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(2, min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE), count // 64))
    bounds = np.unique(np.array(rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], max(0.2 / n, 1e-6)), dtype=np.float64)).astype(np.int64)
    packed = rows.select("doc_id", "tie", "text").mapInArrow(partial(_pack, bounds=bounds), "part int, doc_id long, tie long, blob binary")
    inside = packed.repartition(n // 2, "part").sortWithinPartitions("part", "doc_id", "tie").mapInArrow(partial(_walk, k=k, w=w), _OUT)

    # The ends of each range, of which there are n + _NULLS at most: first their keys, then only their texts.
    key = F.struct(F.col("doc_id"), F.col("tie"))
    numbered = rows.select("doc_id", "tie").mapInArrow(partial(_number, bounds=bounds), "part int, doc_id long, tie long")
    ends = cut(numbered.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")), "winnow-ends")
    found = sorted((r["part"], tuple(r["first"]), tuple(r["last"])) for r in ends.collect())
    if not found:
        return inside
    joints = [(*last, *after[1]) for (_, _, last), after in zip(found, found[1:] + found[:1], strict=True)]
    joints = spark.createDataFrame(joints, "a_id long, a_tie long, b_id long, b_tie long")
    keys = list({x for r in found for x in r[1:]})
    wanted = small(spark.createDataFrame(keys, "w_id long, w_tie long"), len(keys))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tie") == F.col("w_tie")))
    texts = cut(texts.groupBy("doc_id", "tie").agg(F.first("text").alias("text")), "winnow-joints")
    a = texts.select(F.col("doc_id").alias("a_id"), F.col("tie").alias("a_tie"), "text")
    b = texts.select(F.col("doc_id").alias("b_id"), F.col("tie").alias("b_tie"), F.col("text").alias("after"))
    same = lambda x: F.col(f"j.{x}_id").eqNullSafe(F.col(f"{x}.{x}_id")) & (F.col(f"j.{x}_tie") == F.col(f"{x}.{x}_tie"))
    met = joints.alias("j").join(a.alias("a"), same("a")).join(b.alias("b"), same("b"))
    met = met.select(F.col("j.a_id").alias("doc_id"), "text", "after").mapInArrow(partial(_pairs, k=k, w=w), _OUT)
    return inside.unionByName(met)
