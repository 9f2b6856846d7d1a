"""Helpers the training-data operators share: durable cuts of lineage, size-checked joins, Arrow access to texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir

#: Rows of an Arrow batch of texts; with whole texts Spark's default of 10,000 holds too much at once.
BATCH_ROWS = 2000

#: Rows a side may have to be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches from here on, unless the session chose a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/agendula/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there, and a lost executor costs one read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._agendula_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_agendula_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


Batches = Iterator[pa.RecordBatch]
