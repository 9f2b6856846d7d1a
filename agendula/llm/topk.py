"""Exact top-k inner products by aggregation without random access (NRA).

Candidates stand in blocks; a block has two lists a dimension, the candidates by falling and by rising value. A query with a positive
weight reads the falling list, with a negative weight the rising one, always in order and from its start. Lists are read to the same
depth in rounds. A query's lower bound of a candidate is a running sum: at first every component stands at its list's end, and a round adds what
the newly read entries lie above that. The upper bound puts unread components at the place read last. For all queries and candidates of a
block at once the sums are matrix products over what has been read. A candidate whose upper bound is below the query's k-th best
lower bound can no longer qualify; a query stops reading once few are left (twice ``k``, or a thirty-second of the block), and only these
get their final scores. The k-th best carries over from block to block, so later blocks stop early.

Queries and candidates are dealt into groups of bounded size; every query group meets every candidate group in one task, which
returns k rows a query, and a second step merges these. Nothing is broadcast and no pair of rows is formed.

Components become floor(scale * x); sums stay exact, in float32 where all fit 24 bits, float64 within 53, else Python integers.
Every query still meets every block, so the work grows as queries times candidates. A round costs two products of twice the width. The
bounds need deep lists: on vectors like normal noise (64 dimensions) nine tenths are read before few candidates are left, on clustered ones
half to three quarters; the rounds cost 6 to 20 times the one product that would give all scores.

Defined results: vectors null, or holding null or non-finite components, take no part, nor do rows without an id; wholly
repeated rows count once; a score beyond 64 bits is held at their end; vectors of unequal lengths meet as if the shorter ended in zeros; ties go to the smaller id; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, cut

#: Depths of the rounds: doubling up to a half, then by eighths.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
BLOCK = 2048


def _quantise(batches: Batches, scale: int) -> Batches:
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch["id"].to_pylist(), batch["vector"], strict=True):
            x = v.as_py()
            if i is None or x is None or any(c is None for c in x):
                continue
            x = np.asarray(x, np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                big = np.floor(x * scale)
                out.append(big.astype(np.int64).tobytes() if (np.abs(big) < 2.0**62).all() else b"".join(int(c).to_bytes(136, "little", signed=True) for c in big) + b"+")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Rows of exact integers, as float32, float64 or objects, whichever holds every inner product of two such rows."""
    wide = any(len(b) % 8 for b in blobs)
    if wide:
        rows = [[int.from_bytes(b[a : a + 136], "little", signed=True) for a in range(0, len(b) - 1, 136)] if len(b) % 8 else np.frombuffer(b, np.int64).tolist() for b in blobs]
    else:
        rows = [np.frombuffer(b, np.int64) for b in blobs]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), object if wide else np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact_type(a: np.ndarray, b: np.ndarray):
    if a.dtype == object or b.dtype == object:
        return object
    most = 4 * max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


class Lists:
    """The sorted lists of one block of candidates: column d falls and column width + d rises by component d."""

    def __init__(self, x: np.ndarray):
        rising = np.argsort(x, axis=0, kind="stable")
        self.order = np.hstack([rising[::-1], rising])
        self.value = np.take_along_axis(np.hstack([x, x]), self.order, axis=0)
        self.end = self.value[-1]
        self.seen = np.zeros(self.order.shape, x.dtype)
        self.place = 0

    def read(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Read on to ``depth``: what each newly read entry differs from its list's end by (a row a candidate), and the same of the places reached."""
        to = max(self.place, 1, math.ceil(len(self.order) * depth))
        rows, fresh = self.order[self.place : to], np.zeros_like(self.seen)
        np.put_along_axis(fresh, rows, self.value[self.place : to] - self.end, axis=0)
        np.put_along_axis(self.seen, rows, 1, axis=0)
        self.place = to
        return fresh, self.value[to - 1] - self.end


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.sort(scores, axis=1)[:, -k] if scores.dtype == object else -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def _resolve(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray, step: int = 65536) -> np.ndarray:
    """Final scores of pairs."""
    parts = [(q[rows[a : a + step]] * x[columns[a : a + step]]).sum(axis=1) for a in range(0, len(rows), step)]
    return np.concatenate([*parts, np.empty(0, q.dtype)])


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(query row, id, score): the k best candidates of every query, the query's own id left out."""
    width = max(queries.shape[1], x.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    queries, x = pad(queries), pad(x)
    kind = _exact_type(queries, x)
    q, x = queries.astype(kind), x.astype(kind)
    w = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    n_q, none = len(q), -np.inf
    best = np.full((n_q, k), none, object if kind is object else np.float64)
    best_id = np.full((n_q, k), np.iinfo(np.int64).max)
    for a in range(0, len(x), block):
        part, part_ids = x[a : a + block], ids[a : a + block]
        lists = Lists(part)
        alive = query_ids[:, None] != part_ids[None, :]
        low = np.repeat((w @ lists.end)[:, None], len(part), axis=1)
        reading, few = np.arange(n_q), max(2 * k, len(part) // 32)
        for depth in DEPTHS:
            reading = reading[alive[reading].sum(axis=1) > few]
            if not len(reading):
                break
            fresh, gap = lists.read(depth)
            weights, able = w[reading], alive[reading]
            low[reading] += weights @ fresh.T
            least = np.maximum(best[reading, -1], _best(np.where(able, low[reading], none), k))
            high = low[reading] + (weights @ gap)[:, None] - (weights * gap) @ lists.seen.T
            alive[reading] = able & (high >= least[:, None]).astype(bool)
        rows, columns = np.nonzero(alive)
        scores = _resolve(q, part, rows, columns)
        enough = np.flatnonzero(scores >= best[rows, -1])
        best, best_id = _merge(best, best_id, rows[enough], scores[enough].astype(best.dtype), part_ids[columns[enough]], k)
    got = np.nonzero(best > none)
    return list(zip(got[0].tolist(), best_id[got].tolist(), map(int, best[got].tolist()), strict=True))


def _merge(best: np.ndarray, best_id: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(best)
    rows = np.concatenate([np.repeat(np.arange(n), k), rows])
    scores, ids = np.concatenate([best.ravel(), scores]), np.concatenate([best_id.ravel(), ids])
    falling = -np.unique(scores, return_inverse=True)[1] if scores.dtype == object else -scores
    order = np.lexsort((ids, falling, rows))
    rank = np.arange(len(rows)) - np.searchsorted(rows[order], np.arange(n))[rows[order]]
    order = order[rank < k]
    return scores[order].reshape(n, k), ids[order].reshape(n, k)


def _meet(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(candidates):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="object")})
    ids = queries["id"].to_numpy(np.int64)
    found = search(_matrix(list(queries["v"])), ids, _matrix(list(candidates["v"])), candidates["id"].to_numpy(np.int64), k)
    return pd.DataFrame([(int(ids[i]), c, max(-(2**63), min(s, 2**63 - 1))) for i, c, s in found], columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, group: int = 8192, queries_a_task: int = 1024) -> DataFrame:
    """(id, vector) to (query_id, rank, vec_id, score): for each id divisible by ``every`` its ``k`` best other rows."""
    rows = cut(vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(partial(_quantise, scale=scale), "id long, v binary").distinct(), "topk-vectors")
    asked = rows.where(F.col("id") % every == 0)
    n, m = rows.count(), asked.count()
    cs, qs = max(1, -(-n // group)), max(1, -(-m // queries_a_task))
    deal = lambda g: F.pmod(F.xxhash64("id", "v"), F.lit(g)).cast("int")
    left = asked.withColumn("g", deal(qs)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cs - 1))))
    right = rows.withColumn("c", deal(cs)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    met = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(partial(_meet, k=k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
