"""Fill-in-middle: whole texts cut at two code points into prefix, middle and suffix, and put together again.

The first bytes of code points stand as set bits in a vector packed in words of 64 bits, with a directory of the number of set bits
before each word. All texts of a batch share one vector. A text's total is the number of its code points; where a cut of so many code
points falls is found by select: the word from the directory, then the bit by halving inside the word. No text is decoded.

Cuts and form come from a hash of the id alone (``units`` of 8 hex digits of the SHA-256 of ``1:`` and the decimal id), so reruns agree. A
text that is empty or holds a sentinel stays plain. Reading back takes the first sentinels of an output; no text in it holds one whole,
and none can arise across a cut, since every sentinel begins with its only '<' and ends with its only '>'.

Defined results: null text counts as empty; a null id hashes as the empty text after ``1:``; repeated rows get equal results; an empty table
gives an empty table; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import Batches, lean

P, S, M = b"<P>", b"<S>", b"<M>"
#: Percent of texts cut, and among these the percent with the suffix first.
CUT, SUFFIX_FIRST = 90, 20

_ONE = np.uint64(1)
#: For select inside a word: after looking at the lower 32, 16, ... bits.
_STEPS = [(np.uint64(s), (_ONE << np.uint64(s)) - _ONE) for s in (32, 16, 8, 4, 2, 1)]


class Boundaries:
    """The set bits of a packed vector: how many before a place (rank), and the place of the n-th (select)."""

    def __init__(self, starts: np.ndarray):
        bits = np.packbits(starts, bitorder="little")
        self.words = np.frombuffer(bits.tobytes() + bytes(-len(bits) % 8 + 8), np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (_ONE << (place & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, n: np.ndarray) -> np.ndarray:
        """Places of the set bits with ``n`` set bits before them; each must be there."""
        word = np.searchsorted(self.before, n, side="right") - 1
        left, bits = (n - self.before[word]).astype(np.int64), self.words[word]
        at = np.zeros(len(n), np.uint64)
        for step, mask in _STEPS:
            low = np.bitwise_count(bits & mask).astype(np.int64)
            above = left >= low
            left = np.where(above, left - low, left)
            at += np.where(above, step, np.uint64(0))
            bits = np.where(above, bits >> step, bits & mask)
        return word * 64 + at.astype(np.int64)


def boundaries(data: np.ndarray) -> Boundaries:
    """Of UTF-8 bytes: those that begin a code point."""
    return Boundaries((data & 0xC0) != 0x80)


def _cut(batches: Batches) -> Batches:
    for batch in batches:
        texts = batch["text"].cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        begin, end = ends[:-1] - ends[0], ends[1:] - ends[0]
        marks = boundaries(data)
        first = marks.rank(begin)
        n = marks.rank(end) - first
        h = [np.asarray(batch[f"h{i}"], np.int64) for i in (1, 2, 3, 4)]
        one, two = h[0] % (n + 1), h[1] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        place = lambda k: np.where(k < n, marks.select(np.minimum(first + k, max(0, marks.before[-1] - 1))), end) if marks.before[-1] else end
        a, b = place(low), place(high)
        raw = data.tobytes()
        forms, outs = [], []
        for i in range(len(n)):
            text = raw[begin[i] : end[i]]
            if not text or h[2][i] % 100 >= CUT or P in text or S in text or M in text:
                forms.append("plain")
                outs.append(text)
                continue
            prefix, middle, suffix = raw[begin[i] : a[i]], raw[a[i] : b[i]], raw[b[i] : end[i]]
            spm = h[3][i] % 100 < SUFFIX_FIRST
            forms.append("spm" if spm else "psm")
            outs.append(S + suffix + P + prefix + M + middle if spm else P + prefix + S + suffix + M + middle)
        plain = np.array([f == "plain" for f in forms], bool)
        # As binary: what is not UTF-8 inside a string column stays as it is.
        columns = [*[c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in ("text", "h1", "h2", "h3", "h4")], pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(outs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n", "form", "prefix_chars", "middle_chars", "output"])


def whole(output: bytes, form: str) -> bytes:
    """The text that was cut."""
    if form == "psm":
        prefix, _, rest = output[len(P) :].partition(S)
        suffix, _, middle = rest.partition(M)
    elif form == "spm":
        suffix, _, rest = output[len(S) :].partition(P)
        prefix, _, middle = rest.partition(M)
    else:
        return output
    return prefix + middle + suffix


def _restore(batches: Batches) -> Batches:
    for batch in batches:
        texts = [whole(o, f) for o, f in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.binary())], ["row", "restored"])


def _schema(rows: DataFrame, **more) -> StructType:
    return StructType([rows.schema["row"], *[StructField(name, kind) for name, kind in more.items()]])


def transform(docs: DataFrame) -> DataFrame:
    """All columns but text, as ``row``, with n, form, prefix_chars, middle_chars (null if plain) and output (the UTF-8 bytes)."""
    lean(docs.sparkSession)
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), key.alias("key"))
    hashed = keyed.select("row", "text", *[F.conv(F.substring("key", 8 * i - 7, 8), 16, 10).cast("long").alias(f"h{i}") for i in (1, 2, 3, 4)])
    return hashed.mapInArrow(_cut, _schema(hashed, n=LongType(), form=StringType(), prefix_chars=LongType(), middle_chars=LongType(), output=BinaryType()))


def restore(rows: DataFrame) -> DataFrame:
    """``restored`` (UTF-8 bytes) of every (row, form, output); ``row`` passes through."""
    return rows.select("row", "form", "output").mapInArrow(_restore, _schema(rows, restored=BinaryType()))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; the restored text is read from output and form alone."""
    cut = transform(docs.select("doc_id", "text"))
    names = ["n", "form", "prefix_chars", "middle_chars"]
    hashed = cut.select(F.struct(F.col("row.doc_id").alias("doc_id"), *names, F.sha2("output", 256).alias("output_sha256")).alias("row"), "form", "output")
    return restore(hashed).select("row.*", F.sha2("restored", 256).alias("restored_sha256"))
