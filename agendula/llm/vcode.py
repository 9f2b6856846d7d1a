"""Vector codes: a codebook for each part of a vector, and the nearest entry of every part found in a vantage-point tree.

Components become floor(scale * x), and all that follows is integer arithmetic. A vector is cut into equal consecutive parts; each part
position has a codebook that starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest
entry (squared distance, ties to the lower index) and replaces each entry by the componentwise floor of its parts' mean; an entry
without parts stays. Rounds read one written table of integers; a task returns sums for each entry, so the driver sees only codebooks.

Entries of a part position stand in a vantage-point tree: a node holds one entry and two halves of the rest by distance from it, each with
the range of these distances. A search descends for all parts of a batch at once, the nearer half first, and leaves a half out only where
the triangle inequality shows that every entry in it is farther than the best so far. Roots are rounded so that ranges only widen and
bounds only loosen, a half that could hold an equally near entry is visited, and entries compare by exact squared distances, so the code is
that of a full comparison.

Defined results: vectors null, or holding null or non-finite components, are dropped; a null id is kept, but sorts last for the first
codebook; among repeated ids the smaller vector comes first; with fewer vectors than entries the codebooks are shorter; vectors of
unequal lengths, or of a length that the parts do not divide, count as if zeros followed; an error beyond 64 bits is held at their end;
repeated rows each get their code; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, discard, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this are kept as ints; others, which no usual vector has, as decimal text.
NARROW = 1 << 30
_LIMB = 1 << 32


# --- integers


def _integers(batches: Batches, scale: int) -> Batches:
    for batch in batches:
        vectors = batch["vector"]
        if not pa.types.is_list(vectors.type):
            vectors = vectors.cast(pa.list_(vectors.type.value_type))
        ends = np.asarray(vectors.offsets, np.int64)
        x = np.asarray(vectors.values.cast(pa.float64()).fill_null(float("nan")), np.float64)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
        keep = np.asarray(vectors.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(x * scale)
        far = np.concatenate(([0], np.cumsum(~(np.abs(scaled) < NARROW))))
        wide = keep & (far[ends[1:]] > far[ends[:-1]])
        rows = np.flatnonzero(keep)
        lengths = np.where(wide, 0, np.diff(ends))[rows]
        take = np.repeat(ends[:-1][rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        ints = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(scaled[take].astype(np.int32)))
        # A double of 2^53 or more is a whole number.
        whole = lambda c: str(int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale))
        texts = [[whole(c) for c in x[ends[r] : ends[r + 1]].tolist()] if wide[r] else None for r in rows]
        at = pa.array(rows)
        columns = [batch["id"].take(at), batch["label"].take(at), ints, pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "wide"])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of integers, zeros after the shorter ones: int64, or Python integers if any row is wide."""
    v, texts = batch["v"], batch["wide"]
    ends, values = np.asarray(v.offsets, np.int64), np.asarray(v.values, np.int64)
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(ends[0], ends[-1]) - ends[row]] = values[ends[0] : ends[-1]]
    if texts.null_count < len(texts):
        out = out.astype(object)
        for i, t in enumerate(texts.to_pylist()):
            if t:
                out[i, : len(t)] = list(map(int, t))
    return out


def _same_type(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 where every squared distance and sum fits, else as Python integers."""
    if x.dtype != object and book.dtype != object:
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
        if 4 * most * most * max(1, x.shape[-1]) < 1 << 62:
            return x, book
    return x.astype(object), book.astype(object)


def _roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers not above and not below the roots of squared distances."""
    if d2.dtype == object:
        low = np.frompyfunc(math.isqrt, 1, 1)(d2)
        return low, low + 1
    root = np.sqrt(d2.astype(np.float64)).astype(np.int64)
    return np.maximum(root - 1, 0), root + 2


# --- the tree


def tree(book: np.ndarray) -> tuple | None:
    """(entry, ((least, most, node), ...)): distances of a child's entries from the node's entry lie between least and most, rounded outwards."""
    book = book.astype(object)

    def node(rows: list[int]) -> tuple | None:
        if not rows:
            return None
        d2 = {a: {b: ((book[a] - book[b]) ** 2).sum() for b in rows} for a in rows}
        top = max(rows, key=lambda a: (max(d2[a].values()) - min([d for b, d in d2[a].items() if b != a], default=0), -a))
        rest = sorted((b for b in rows if b != top), key=lambda b: (d2[top][b], b))
        halves = [h for h in (rest[: (len(rest) + 1) // 2], rest[(len(rest) + 1) // 2 :]) if h]
        return top, tuple((math.isqrt(d2[top][h[0]]), math.isqrt(d2[top][h[-1]]) + 1, node(h)) for h in halves)

    return node(list(range(len(book))))


def nearest(root: tuple, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of every row of ``x``, and how many distances that took."""
    x, book = _same_type(x, book)
    code = np.full(len(x), len(book), np.int64)
    best = np.full(len(x), (1 << 62) if x.dtype != object else 0, x.dtype)
    best_root, taken = np.full(len(x), (1 << 62) if x.dtype != object else 0, x.dtype), 0

    def visit(node: tuple, rows: np.ndarray) -> None:
        nonlocal taken
        if not len(rows):
            return
        entry, children = node
        apart = x[rows] - book[entry]
        d2 = (apart * apart).sum(axis=1)
        taken += len(rows)
        new = code[rows] == len(book)
        better = new | (d2 < best[rows]) | ((d2 == best[rows]) & (entry < code[rows]))
        low, high = _roots(d2)
        code[rows[better]], best[rows[better]], best_root[rows[better]] = entry, d2[better], high[better]
        gaps = [np.maximum(low - most, least - high) for least, most, _ in children]

        def into(child: int, those: np.ndarray) -> None:
            go = those[gaps[child][those] <= best_root[rows[those]]]
            visit(children[child][2], rows[go])

        if len(children) == 1:
            into(0, np.arange(len(rows)))
        elif children:
            inner = gaps[0] <= gaps[1]
            first, second = np.flatnonzero(inner), np.flatnonzero(~inner)
            into(0, first)
            into(1, second)
            into(1, first)
            into(0, second)

    visit(root, np.arange(len(x)))
    return code, best, taken


# --- rounds


def _sums(batches: Batches, books: list, trees: list, width: int) -> Batches:
    """Count (place -1) and sums of the parts of every entry, in limbs of 32 bits so that no sum overflows."""
    wide = width // len(books)
    totals: dict = defaultdict(int)
    for batch in batches:
        x = _matrix(batch, width)
        for p, (book, root) in enumerate(zip(books, trees, strict=True)):
            part = x[:, p * wide : (p + 1) * wide]
            code = nearest(root, book, part)[0]
            for e in np.unique(code).tolist():
                own = part[code == e]
                totals[p, e, -1] += len(own)
                for d, s in enumerate(own.sum(axis=0).tolist()):
                    totals[p, e, d] += s
    out = []
    for key, total in totals.items():
        sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
        while rest or not limb:
            out.append((*key, limb, sign * (rest % _LIMB)))
            rest, limb = rest // _LIMB, limb + 1
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["part", "entry", "place", "limb", "value"])


def _codes(batches: Batches, books: list, trees: list, width: int) -> Batches:
    wide = width // len(books)
    for batch in batches:
        x = _matrix(batch, width)
        found = [nearest(root, book, x[:, p * wide : (p + 1) * wide])[:2] for p, (book, root) in enumerate(zip(books, trees, strict=True))]
        digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
        text = digits.tobytes().hex()
        step = 2 * len(books)
        errors = sum(d.astype(object) for _, d in found)
        columns = [batch["id"], batch["label"], pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array([min(int(e), 2**63 - 1) for e in errors], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])


def _retrained(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    sums = rows.mapInArrow(partial(_sums, books=books, trees=[tree(b) for b in books], width=width), "part long, entry long, place long, limb long, value long")
    totals: dict = defaultdict(int)
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():  # a few numbers for each component of a codebook
        totals[r["part"], r["entry"], r["place"]] += r["value"] * _LIMB ** r["limb"]
    out = [b.astype(object) for b in books]
    for (p, e, d), total in totals.items():
        if d >= 0:
            out[p][e, d] = total // totals[p, e, -1]
    return [_settle(b) for b in out]


def _settle(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < NARROW for v in book.ravel()) else book


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, vector, label) to (id, label, code, error) of every kept row, written once, and the codebooks (entries x part width, one a part)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    label = vectors.schema["label"].dataType.simpleString()
    rows = cut(vectors.select(F.col("id").cast("long").alias("id"), "vector", "label").mapInArrow(partial(_integers, scale=scale), f"id long, label {label}, v array<int>, wide array<string>"), "vcode-integers")
    longest = rows.agg(F.max(F.coalesce(F.size("wide"), F.size("v")))).first()[0] or 0
    width = max(parts, -(-longest // parts) * parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "v", "wide").limit(entries).select("v", "wide").collect()
    seeds = np.zeros((len(first), width), object)
    for i, r in enumerate(first):
        own = list(map(int, r["wide"] if r["wide"] is not None else r["v"]))
        seeds[i, : len(own)] = own
    wide = width // parts
    books = [_settle(seeds[:, p * wide : (p + 1) * wide]) for p in range(parts)]
    if first:
        for _ in range(rounds):
            books = _retrained(rows, books, width)
    out = cut(rows.mapInArrow(partial(_codes, books=books, trees=[tree(b) for b in books], width=width), f"id long, label {label}, code string, error long"), "vcode-codes")
    discard(rows)
    return out, books


def codes(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of (id, vector, label)."""
    coded, books = encode(vectors, **parameters)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    totals = coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"))
    out = coded.join(small(totals, totals.count()), F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(code: str, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([np.asarray(b[i], np.float64) for b, i in zip(books, bytes.fromhex(code), strict=True)]) / scale
