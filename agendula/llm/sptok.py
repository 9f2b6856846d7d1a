"""SentencePiece models on the Tokenizers library.

The model's protobuf is parsed here; from it come the normaliser (character map, runs of spaces, leading space), the metaspace
marker, a Unigram model with the pieces' scores or, for the BPE type, the merges that the scores order, and byte fallback.

Where no piece goes over the beginning of a word (no marker follows another character inside a piece, which the rebuilt model
checks), a text's ids are those of its words one after the other. Words are then encoded once: those a worker has not met are
encoded in one multithreaded batch, and a table bounded in bytes keeps their ids; chunks of more than ``LONG`` characters (text
without spaces) are encoded each time. Every task also holds the first texts it sees, whole, against SentencePiece itself and
stops on a difference.

Defined results: a null text has null ids, and counts as empty in digests; the empty text has no ids and decodes to itself; a text
that holds the marker character decodes to spaces there (round_trip false), as with SentencePiece; repeated rows encode alike; an
empty table gives an empty table; extra columns are kept by ``encode`` and ignored by ``digests``.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import Batches, lean

MARK = "▁"
LONG = 200
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes):
    """(number, value) of every field of a protobuf message; values are int, 4 or 8 raw bytes, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse(data: bytes) -> dict:
    """Pieces [(text, score, type)], model type (1 unigram, 2 BPE) and the normaliser's settings, with the format's defaults."""
    out = {"pieces": [], "type": 1, "byte_fallback": False, "suffix": False, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            out["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            out |= {"type": spec.get(3, 1), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(_fields(value))
            out |= {"charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All splits of normal pieces into two pieces, by falling score of the whole; of one whole by the ids of its parts."""
    rank = {p: i for i, (p, _, kind) in enumerate(pieces) if kind not in (CONTROL, UNKNOWN, BYTE, UNUSED)}
    found = []
    for text, score, kind in pieces:
        if kind == NORMAL:
            for i in range(1, len(text)):
                if text[:i] in rank and text[i:] in rank:
                    found.append((-score, rank[text], rank[text[:i]], rank[text[i:]], text[:i], text[i:]))
    return [x[4:] for x in sorted(found)]


class SentencePiece:
    """A SentencePiece model rebuilt on the Tokenizers library."""

    def __init__(self, data: bytes, threads: int = 2, room: int = 160_000_000):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

        self.spec = spec = parse(data)
        pieces = spec["pieces"]
        if spec["suffix"] or not spec["escape"]:
            raise ValueError("models that mark word ends, or leave spaces as they are, are not supported")
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
        if spec["type"] == 1:
            model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=spec["byte_fallback"])
        elif spec["type"] == 2:
            vocabulary = {p: i for i, (p, _, _) in enumerate(pieces)}
            model = models.BPE(vocabulary, _merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=spec["byte_fallback"])
        else:
            raise ValueError(f"model type {spec['type']} is neither unigram nor BPE")
        steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
        if spec["squeeze"]:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        self.backend = Tokenizer(model)
        own = [AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER]
        if own:
            self.backend.add_tokens(own)
        joins = re.compile(f"[^{MARK}]{MARK}")
        self.by_word = not own and not any(joins.search(p) for p, _, kind in pieces if kind == NORMAL)
        surface = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else surface.get(kind, p.replace(MARK, " ").encode()) for p, _, kind in pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        # Two generations of words: what is met again moves from the older to the newer before the older goes. ``held`` is about
        # the newer one's bytes.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held, self.room = 0, room

    def normalise(self, text: str) -> str:
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        marked = text.replace(" ", MARK)
        return MARK + marked if text and self.spec["prefix"] else marked

    def chunks(self, text: str) -> list[str]:
        s = self.normalise(text)
        if not self.by_word:
            return [s] if s else []
        return _CHUNK.findall(s)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        split = [self.chunks(t) for t in texts]
        if self.held > self.room:
            self.known, self.older, self.held = {}, self.known, 0
        new = set().union(*split).difference(self.known)
        again = new.intersection(self.older)
        met = {c: self.older[c] for c in again}
        new = list(new - again)
        brief = [c for c in new if len(c) <= LONG]
        for a in range(0, len(brief), 20_000):
            met.update(self._encode(brief[a : a + 20_000]))
        self.known.update(met)
        self.held += sum(200 + len(c) + len(i) for c, i in met.items())
        long = self._encode([c for c in new if len(c) > LONG])
        self.known.update(long)
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), np.int32) for c in split]
        for c in long:
            del self.known[c]
        return out

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        return {c: np.array(e.ids, np.int32).tobytes() for c, e in zip(chunks, self.backend.encode_batch_fast(chunks, add_special_tokens=False), strict=True)}

    def decode(self, ids) -> bytes:
        out = b"".join(map(self.bytes.__getitem__, np.asarray(ids).tolist()))
        return out[1:] if self.spec["prefix"] and out[:1] == b" " else out


def reference(data: bytes):
    """SentencePiece itself on the same model, for checks of parity."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def differing(data: bytes, texts: list[str]) -> list[str]:
    """The texts whose ids differ from those of SentencePiece."""
    return [t for t, ids, own in zip(texts, SentencePiece(data).encode(texts), reference(data).encode(texts), strict=True) if ids.tolist() != own]


def read_model(path: str | None = None) -> bytes:
    """A model's bytes, on the driver; without a path those of the installed public BPE model of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


_loaded: dict[str, SentencePiece] = {}


def _worker(data: bytes) -> SentencePiece:
    """One model, with the words it knows, for all tasks of a worker."""
    name = hashlib.sha1(data).hexdigest()
    if name not in _loaded:
        _loaded[name] = SentencePiece(data)
    return _loaded[name]


def _encoded(batches: Batches, data, check: int = 16, step: int = 128):
    """(batch, texts, ids) of slices; the first texts are held against SentencePiece."""
    data = data.value
    model, first = _worker(data), True
    for batch in batches:
        for a in range(0, len(batch), step):
            part = batch.slice(a, step)
            texts = [t or "" for t in part["text"].to_pylist()]
            ids = model.encode(texts)
            if first and check:
                if [i.tolist() for i in ids[:check]] != reference(data).encode(texts[:check]):
                    raise ValueError("ids differ from SentencePiece's")
                first = False
            yield part, texts, ids, model


def _with_ids(batches: Batches, data) -> Batches:
    for part, _, ids, _ in _encoded(batches, data):
        null = part["text"].is_null()
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)), mask=null if null.true_count else None)
        yield part.append_column("token_ids", lists)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with token_ids (array of int)."""
    lean(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(read_model(path))
    schema = docs.drop("token_ids").schema.add("token_ids", ArrayType(IntegerType()))
    return docs.drop("token_ids").mapInArrow(partial(_with_ids, data=data), schema)


def _decoded(batches: Batches, data) -> Batches:
    model = _worker(data.value)
    for batch in batches:
        texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace") for ids in batch["token_ids"].to_pylist()]
        yield batch.drop_columns(["token_ids"]).append_column("text", pa.array(texts, pa.string()))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with text in place of token_ids."""
    data = rows.sparkSession.sparkContext.broadcast(read_model(path))
    rest = [c for c in rows.columns if c not in ("token_ids", "text")]
    schema = rows.select(*rest).schema.add("text", "string")
    return rows.select(*rest, "token_ids").mapInArrow(partial(_decoded, data=data), schema)


def _digest(batches: Batches, data) -> Batches:
    for part, texts, ids, model in _encoded(batches, data):
        back = [model.decode(i) for i in ids]
        columns = [
            part["doc_id"], pa.array([len(i) for i in ids], pa.int64()), pa.array([int(model.is_byte[i].sum()) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            pa.array([b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts, strict=True)], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (ids as little-endian int32), decoded_sha256 (UTF-8), round_trip."""
    lean(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(read_model(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_digest, data=data), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
