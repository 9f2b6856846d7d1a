"""Content-addressed WARC archive.

``write`` stores two tables in the shared folder: ``payloads`` holds the bytes of every distinct payload once, compressed, under
its SHA-256; ``headers`` holds the exact header block of every record. ``read`` joins them back to whole records, and ``records``
parses those records as any WARC reader would. A digest names a payload only after all rows that share it were shown to agree
in SHA-1, length and a third hash; a disagreement stops the job. Payloads are compressed before they are dealt by their address,
so neither of the two shuffles that hold them, nor the store, holds them whole.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response; the others are
revisit records without payload, which name it. Smaller payloads are all responses. A record's id is made of its page_id and a
number that its row got when the digests were written; WARC-Date is ``date`` for all, as pages carry no time of their own.

Defined results: null html is the empty payload; rows that repeat the largest page_id of a payload are all responses; a null
page_id is never the largest unless no other is there (then its row is a response); null url is an empty target; an empty
table gives an empty archive; extra columns are ignored. A payload that a third of all rows share is grouped by partial
aggregation, and the join that restores it is one that adaptive execution splits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, scratch

CRLF = "\r\n"
_HEAD_END = CRLF + CRLF


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def _squeeze(batches: Batches) -> Batches:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["address"], pa.array([squeeze(x.as_buffer()) for x in b["raw"]], pa.binary())], ["address", "payload"])


def _restore(batches: Batches) -> Batches:
    """(header, address, payload) to whole records; every payload is held against its address again."""
    import zstandard

    unpack, end = zstandard.ZstdDecompressor().decompress, _HEAD_END.encode()
    for b in batches:
        for a in range(0, len(b), 256):
            part, out = b.slice(a, 256), []
            for header, address, blob in zip(*[part[c].to_pylist() for c in ("header", "address", "payload")], strict=True):
                raw = unpack(blob)
                if hashlib.sha256(raw).digest() != address:
                    raise ValueError("a stored payload fails its digest")
                out.append(b"".join((header, raw, end)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write(pages: DataFrame, folder: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    address = F.unhex(F.sha2(raw, 256))
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), address.alias("address"), F.sha1(raw).alias("sha1"), F.octet_length(raw).cast("long").alias("bytes"), F.xxhash64(raw).alias("check"),
        F.monotonically_increasing_id().alias("place"))
    rows.write.parquet(f"{folder}/digests")  # the numbers are given once
    rows = pages.sparkSession.read.schema(rows.schema).parquet(f"{folder}/digests")
    agree = [F.min(c) != F.max(c) for c in ("sha1", "bytes", "check")]
    stored = rows.groupBy("address").agg(
        F.max(F.struct("page_id", "place")).alias("last"), F.when(agree[0] | agree[1] | agree[2], F.raise_error(F.lit("payloads differ under one digest"))).cast("boolean").alias("verified"))
    stored.write.parquet(f"{folder}/index")
    index = pages.sparkSession.read.schema(stored.schema).parquet(f"{folder}/index")

    # Dealt by address; of equal payloads the partial aggregation passes on one a task.
    packed = pages.select(address.alias("address"), raw.alias("raw")).mapInArrow(_squeeze, "address binary, payload binary")
    packed.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "none").parquet(f"{folder}/payloads")

    both = rows.drop("check").join(index.select("address", "last"), "address")
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    ident = lambda c, n: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), n.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", ident(F.col("page_id"), F.col("place"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, _line("WARC-Refers-To", ident(F.col("last.page_id"), F.col("last.place")))).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    both.select(F.when(~revisit, F.col("address")).alias("address"), head.cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``record`` (binary): every record's bytes as a WARC file holds them. The payload's digest is checked again."""
    headers = spark.read.schema("address binary, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("address binary, payload binary").parquet(f"{folder}/payloads").withColumnRenamed("address", "stored")
    revisits = headers.where("address is null").select(F.concat("header", F.lit(_HEAD_END).cast("binary")).alias("record"))
    whole = headers.where("address is not null").join(payloads, F.col("address") == F.col("stored"))
    return whole.select("header", "address", "payload").mapInArrow(_restore, "record binary").unionByName(revisits)


def records(archive: DataFrame) -> DataFrame:
    """Parse whole records: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, payload."""
    # ISO-8859-1 keeps one character a byte, so positions in that text are positions in the record; what the header says is UTF-8.
    size = F.length(F.substring_index(F.decode("record", "ISO-8859-1"), _HEAD_END, 1))
    parsed = archive.select("record", size.alias("size")).select("record", "size", F.substring("record", F.lit(1), F.col("size")).cast("string").alias("head"))
    field = lambda name: F.regexp_extract("head", f"(?md)^{name}: (.*?)\\r?$", 1)
    ident = lambda name: F.regexp_extract("head", f"(?m)^{name}: <urn:page:(-?\\d+):\\d+>", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    body = F.substring("record", F.col("size") + len(_HEAD_END) + 1, field("Content-Length").cast("int"))
    out = parsed.select(
        number(ident("WARC-Record-ID")).alias("page_id"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_extract("head", "(?m)^WARC-Payload-Digest: sha1:([0-9a-f]{40})", 1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(ident("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        body.alias("payload"),
    )
    sound = (F.col("record_type") == "revisit") | (F.sha1("payload") == F.col("payload_digest"))
    return out.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload differs from its record"))))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and parse it back, without the payload bytes."""
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder)
    return records(read(pages.sparkSession, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
