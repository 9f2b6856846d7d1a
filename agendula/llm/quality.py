"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is described by its own measures and those of the lines before and after it; the field's two states are good
and bad. Forward-backward gives each line its marginal probability of being bad, and their mean weighted by line length is the
document's share of bad text, which a logistic regression turns into the score.

Labels speak of documents, so the field is fitted in rounds: first each line takes its document's label, then lines of bad
documents take the label that the field gives them, at least the worst staying bad. Fitting uses a bounded sample: at most
``SAMPLE`` labelled training rows a class, least hash first, with all their lines: a long text is fitted as chains of ``LINES`` lines
one after the other, which weigh as one document together. Every fourth row of the sample is kept aside for the calibration.
Scoring reads whole texts.

Defined results: null and empty texts are one empty line; a document with several labels is good if all say so; null labels teach
nothing; without labels of both classes every score is the smoothed share of good labels; repeated rows count as often as they
stand; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import fit_logistic, logistic
from .common import Batches, crc_mod, lean

SAMPLE, LINES, ROUNDS, STEPS = 2000, 200, 2, 80
_UPPER, _LOWER, _DIGIT, _SPACE, _PLAIN, _SYMBOL = range(6)
#: Punctuation of running text.
_PUNCTUATION = ".,;:'\"?-()’‘“”«»–—¿¡…"
OWN, AROUND = 18, 7


@lru_cache(1)
def _kinds() -> np.ndarray:
    def kind(c: str) -> int:
        if c.isspace():
            return _SPACE
        if c.isdigit():
            return _DIGIT
        if c.isalpha():
            return _UPPER if c.isupper() else _LOWER
        return _PLAIN if c in _PUNCTUATION else _SYMBOL

    return np.array([kind(chr(i)) for i in range(0x110000)], np.uint8)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x measures, line lengths)."""
    lines = (text or "").split("\n")
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = ends - starts
    kinds = _kinds()[codes]
    kinds[ends] = _SPACE
    sums = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(6)])
    sums[_SPACE] -= 1
    shout = np.add.reduceat(codes == 33, starts, dtype=np.int64)
    gap = kinds == _SPACE
    words = np.add.reduceat(~gap & np.concatenate(([True], gap[:-1])), starts, dtype=np.int64)
    long_run = _runs(codes, ends, starts)
    size, letters, wordy = np.maximum(n, 1), np.maximum(sums[_UPPER] + sums[_LOWER], 1), np.maximum(words, 1)
    count: dict[str, int] = {}
    for s in lines:
        count[s] = count.get(s, 0) + 1
    again = np.array([count[s] for s in lines]) * (n > 0)
    distinct = np.array([len(set(s.split())) for s in lines])
    own = np.empty((len(lines), OWN))
    upper, symbol, digit = sums[_UPPER] / letters, sums[_SYMBOL] / size, sums[_DIGIT] / size
    columns = [
        np.ones(len(n)), np.log1p(n) / 8, upper, upper > 0.4, digit, digit > 0.2, sums[_PLAIN] / size, symbol, symbol > 0.05, shout / size * 4,
        np.minimum((n - sums[_SPACE]) / wordy / 20, 2), again > 1, np.log1p(again) / 4, distinct / wordy, (distinct / wordy < 0.5) & (words > 5), words <= 3, letters / size, long_run > 4,
    ]
    for i, c in enumerate(columns):
        own[:, i] = c
    main = own[:, [2, 4, 7, 10, 11, 13, 15]]
    edge = np.zeros((1, AROUND))
    return np.hstack([own, np.vstack([edge, main[:-1]]), np.vstack([main[1:], edge])]), n


def _runs(codes: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Longest run of one character in each line."""
    change = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    length = np.diff(np.append(change, len(codes)))
    out = np.zeros(len(ends), np.int64)
    np.maximum.at(out, np.searchsorted(ends, change), length)
    return out


def marginals(score: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains as columns, the longest first: score (steps x chains) of bad over good, moves 2 x 2, each chain's number of steps.

    P(bad) at each step, and for each chain the expected number of moves between states. A step works on the chains that reach it.
    """
    steps, chains = score.shape
    reach = [int((lengths > t).sum()) for t in range(steps)]
    e = np.stack([np.zeros_like(score), np.clip(score, -30, 30)], axis=2)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    m = np.exp(moves)
    alpha, beta, scale = np.ones((steps, chains, 2)), np.ones((steps, chains, 2)), np.ones((steps, chains, 1))
    for t, k in enumerate(reach):
        a = e[t, :k] if t == 0 else (alpha[t - 1, :k] @ m) * e[t, :k]
        scale[t, :k] = a.sum(axis=1, keepdims=True)
        alpha[t, :k] = a / scale[t, :k]
    pairs = np.zeros((chains, 2, 2))
    for t in range(steps - 2, -1, -1):
        k = reach[t + 1]
        ahead = e[t + 1, :k] * beta[t + 1, :k] / scale[t + 1, :k]
        beta[t, :k] = ahead @ m.T
        pairs[:k] += alpha[t, :k, :, None] * m * ahead[:, None, :]
    p = alpha * beta
    return p[:, :, 1] / p.sum(axis=2), pairs


class Field:
    def __init__(self):
        self.w, self.moves, self.weights = np.zeros(OWN + 2 * AROUND), np.zeros((2, 2)), np.zeros(3)

    def _share(self, x: np.ndarray, n: np.ndarray) -> float:
        p, n = _chain((x @ self.w).tolist(), np.exp(self.moves).ravel().tolist()), np.maximum(n, 1)
        return float(p @ n / n.sum())

    def bad_share(self, text: str | None) -> float:
        """Length-weighted mean of the lines' P(bad)."""
        return self._share(*features(text))


def _chain(score: list[float], m: list[float]) -> np.ndarray:
    """:func:`marginals` of one chain, without arrays: most texts have a few lines."""
    from math import exp

    m00, m01, m10, m11 = m
    odds = [exp(max(-30.0, min(30.0, s))) for s in score]
    forward, g, b = [], 0.5, 0.5
    for t, o in enumerate(odds):
        if t:
            g, b = g * m00 + b * m10, (g * m01 + b * m11) * o
        else:
            b = o * b
        s = g + b
        g, b = g / s, b / s
        forward.append((g, b))
    out = np.empty(len(odds))
    bg = bb = 1.0
    for t in range(len(odds) - 1, -1, -1):
        g, b = forward[t]
        out[t] = b * bb / (g * bg + b * bb)
        o = odds[t] * bb
        bg, bb = m00 * bg + m01 * o, m10 * bg + m11 * o
        s = bg + bb
        bg, bb = bg / s, bb / s
    return out


def fit(xs: list[np.ndarray], bad: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, ridge: float = 1e-3) -> Field:
    """The field from line measures by document and the documents' labels."""
    field = Field()
    parts = [-(-len(x) // LINES) for x in xs]
    xs = [x[a : a + LINES] for x in xs for a in range(0, len(x), LINES)]
    bad, of = np.repeat(np.asarray(bad, np.float64), parts), 1 / np.repeat(parts, parts)
    order = np.argsort([-len(x) for x in xs], kind="stable")
    xs, bad, of = [xs[i] for i in order], bad[order], of[order]
    lengths = np.array([len(x) for x in xs])
    longest, chains = int(lengths.max()), len(xs)
    live = np.arange(longest)[:, None] < lengths[None, :]
    chain, step_of = np.nonzero(live.T)  # documents one after the other
    x = np.concatenate(xs)
    # Either class weighs half, and every document of a class alike.
    share = of * np.where(bad > 0, 0.5 / max(bad @ of, 1), 0.5 / max((1 - bad) @ of, 1))
    weight = (share / lengths)[chain]
    moved = (share / np.maximum(lengths - 1, 1))[:, None, None]

    def states(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.zeros((longest, chains))
        score[step_of, chain] = x @ params[:-4]
        return marginals(score, params[-4:].reshape(2, 2), lengths)

    y = live * bad[None, :]
    params = np.zeros(x.shape[1] + 4)
    for r in range(rounds):
        if r:
            p = np.where(live, states(params)[0], -1)
            y = np.where(bad[None, :] > 0, (p > 0.5) | (p == p.max(axis=0)), 0.0) * live
        flat = y[step_of, chain]
        seen = np.stack([np.stack([((y[:-1] == i) & (y[1:] == j) & live[1:]).sum(axis=0) for j in (0, 1)], axis=1) for i in (0, 1)], axis=1)
        m1, m2 = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            p, pairs = states(params)
            grad = np.concatenate([x.T @ (weight * (flat - p[step_of, chain])), (moved * (seen - pairs)).sum(axis=0).ravel()]) - ridge * params
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            params = params + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    field.w, field.moves = params[:-4].copy(), params[-4:].reshape(2, 2).copy()
    return field


def _evidence(shares: np.ndarray) -> np.ndarray:
    m = np.clip(shares, 1e-4, 1 - 1e-4)
    return np.column_stack([4 * shares, np.log(m / (1 - m)) / 4])


def _measure(batches: Batches) -> Batches:
    for batch in batches:
        found = [features(t) for t in batch["text"].to_pylist()]
        columns = [pa.array([v.astype(kind).tobytes() for v in c], pa.binary()) for c, kind in zip(zip(*found, strict=True), (np.float32, np.int64), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["aside"], batch["good"], *columns], ["aside", "good", "x", "n"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A fitted field with calibration weights. Rows that the contract holds out are left out here."""
    lean(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("__good"))
    known = known.where(crc_mod("doc_id", 3) != 1)
    pick = lambda g: known.where(F.col("__good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = pick(0).unionByName(pick(1))  # at most 2 * SAMPLE rows
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(4)) == 0
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    got = rows.select(aside.alias("aside"), F.col("__good").alias("good"), "text").mapInArrow(_measure, "aside boolean, good int, x binary, n binary").orderBy("x").toArrow()
    good, aside = np.asarray(got["good"], np.float64), np.asarray(got["aside"], bool)
    xs = [np.frombuffer(b, np.float32).reshape(-1, OWN + 2 * AROUND).astype(np.float64) for b in got["x"].to_pylist()]
    if not len(good) or good.min() == good.max():
        field = Field()
        field.weights[0] = np.log((good.sum() + 0.5) / (len(good) - good.sum() + 0.5))
        return field
    if any(len(set(good[x])) < 2 for x in (aside, ~aside)):  # too few rows to keep any aside
        fitted = judged = np.arange(len(good))
    else:
        fitted, judged = np.flatnonzero(~aside), np.flatnonzero(aside)
    field = fit([xs[i] for i in fitted], 1 - good[fitted])
    sizes = [np.frombuffer(b, np.int64) for b in got["n"].to_pylist()]
    shares = np.array([field._share(xs[i], sizes[i]) for i in judged])
    field.weights = fit_logistic(_evidence(shares), good[judged], ridge=1e-2)
    return field


def _score(batches: Batches, field) -> Batches:
    field = field.value
    for batch in batches:
        shares = np.array([field.bad_share(t) for t in batch["text"].to_pylist()], np.float64)
        yield batch.drop_columns(["text"]).append_column("score", pa.array(logistic(_evidence(shares), field.weights)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    out = rows.mapInArrow(partial(_score, field=field), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _keep(batches: Batches, field, least: float) -> Batches:
    field = field.value
    for batch in batches:
        shares = np.array([field.bad_share(t) for t in batch["text"].to_pylist()], np.float64)
        yield batch.filter(pa.array(logistic(_evidence(shares), field.weights) >= least))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(partial(_keep, field=field, least=least), docs.schema)


def lines(text: str | None, field: Field) -> list[tuple[str, float]]:
    """Every line of a text with its probability of being bad."""
    p = _chain((features(text)[0] @ field.w).tolist(), np.exp(field.moves).ravel().tolist())
    return list(zip((text or "").split("\n"), p.tolist(), strict=True))
