"""Landed payloads as a data source: ``spark.read.format("landed")`` and ``df.write.format("landed")``.

What was fetched lies in Parquet parts, each of one source, day and department, with a line in a manifest. A reader prunes by the manifest before it
plans: filters on these three columns choose the parts, one Spark partition each, and are not evaluated again; others go back to Spark. A
reader given a narrower schema reads only those columns of a part. A payload that failed (status of 400 or more) or is empty gives no row.

A write commits in two steps. A task writes its parts and a manifest of its own; only the commit, which lists these manifests under
a name of its own, makes them readable. A task that failed or ran twice leaves parts that no commit lists. The driver sees one name a task.

Folders are URIs or paths that pyarrow opens (a shared mount, an object store, HDFS where its library is installed).

Defined results: null keys are keys of their own, which only a null-safe filter asks for; an empty table lands nothing; a folder without commits has
no rows; an append adds a commit, an overwrite makes only its own readable.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

KEYS = ("source", "day", "department")
SCHEMA = "source string, day date, department string, doc long, url string, status int, body string"
#: Bytes of bodies in a part, and those that a task holds before it writes its largest part.
PART, HELD = 64_000_000, 128_000_000

_TYPES = {"source": pa.string(), "day": pa.date32(), "department": pa.string(), "doc": pa.int64(), "url": pa.string(), "status": pa.int32(), "body": pa.string()}
_TESTS = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def _files(folder: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pf.LocalFileSystem(), folder)


def _listed(fs: pf.FileSystem, folder: str) -> list[str]:
    return sorted(f.path for f in fs.get_file_info(pf.FileSelector(folder, allow_not_found=True)) if f.type == pf.FileType.File and not f.base_name.startswith("."))


def _text(fs: pf.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode()


def _put(fs: pf.FileSystem, path: str, text: str) -> None:
    """The file appears whole, under its name, or not at all."""
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/.{name}") as f:
        f.write(text.encode())
    fs.move(f"{folder}/.{name}", path)


@dataclass
class Part(ds.InputPartition):
    """One landed file and its keys."""

    path: str
    keys: dict


def parts(folder: str) -> list[Part]:
    """All parts that are committed."""
    fs, root = _files(folder)
    commits = [json.loads(_text(fs, c)) for c in _listed(fs, f"{root}/_commits")]
    begin = max((i for i, c in enumerate(commits) if c["overwrite"]), default=0)
    out = []
    for commit in commits[begin:]:
        for name in commit["manifests"]:
            for line in _text(fs, f"{root}/_manifests/{name}").splitlines():
                p = json.loads(line)
                out.append(Part(p["path"], {"source": p["source"], "day": p["day"] and dt.date.fromisoformat(p["day"]), "department": p["department"]}))
    return out


class Reader(ds.DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names, self.kept = folder, schema.names, []
        if unknown := set(self.names) - set(_TYPES):
            raise ValueError(f"no such columns of landed payloads: {sorted(unknown)}")

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(getattr(f, "attribute", None), tuple) and len(f.attribute) == 1 else None
            if column in KEYS and isinstance(f, (*_TESTS, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull)):
                self.kept.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _asked(self, keys: dict) -> bool:
        tests = {k.__name__: t for k, t in _TESTS.items()}
        for column, kind, value in self.kept:
            own = keys[column]
            if kind == "EqualNullSafe":
                ok = own == value
            elif kind == "IsNull":
                ok = own is None
            elif kind == "IsNotNull":
                ok = own is not None
            elif kind == "In":
                ok = own is not None and own in value
            else:
                ok = own is not None and value is not None and tests[kind](own, value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Part]:
        # An empty list would plan a partition that is none; a part without a path has no rows.
        return [p for p in parts(self.folder) if self._asked(p.keys)] or [Part("", {})]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, root = _files(self.folder)
        stored = [n for n in self.names if n not in KEYS]
        with fs.open_input_file(f"{root}/{partition.path}") as f:
            for batch in pq.ParquetFile(f).iter_batches(2000, columns=sorted({*stored, "status", "body"} if "body" in stored else {*stored, "status", "size"})):
                size = batch["size"] if "size" in batch.schema.names else pc.binary_length(batch["body"])
                sound = pc.and_(pc.less(pc.fill_null(batch["status"], 200), 400), pc.greater(pc.fill_null(size, 0), 0))
                rows = batch.filter(sound)
                columns = [pa.array([partition.keys[n]] * rows.num_rows, _TYPES[n]) if n in KEYS else rows[n].cast(_TYPES[n]) for n in self.names]
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays(columns, list(self.names))


@dataclass
class Done(ds.WriterCommitMessage):
    manifest: str | None


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, in_order: bool = False):
        self.folder, self.overwrite, self.in_order = folder, overwrite, in_order

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, root = _files(self.folder)
        held, sizes, lines = defaultdict(list), defaultdict(int), []

        def flush(key: tuple) -> None:
            table = pa.concat_tables(held.pop(key))
            sizes.pop(key)
            path = f"parts/{uuid.uuid4().hex}.parquet"
            fs.create_dir(f"{root}/parts", recursive=True)
            with fs.open_output_stream(f"{root}/{path}") as out:
                pq.write_table(table, out, compression="zstd")
            lines.append(json.dumps({"path": path, "rows": table.num_rows, "source": key[0], "day": key[1] and key[1].isoformat(), "department": key[2]}))

        for batch in iterator:
            table = pa.table({n: batch[n].cast(t) if n in batch.schema.names else pa.nulls(batch.num_rows, t) for n, t in _TYPES.items()})
            table = table.append_column("size", pc.fill_null(pc.binary_length(table["body"]), 0))
            codes = table.select(KEYS).append_column("row", pa.array(range(table.num_rows))).group_by(list(KEYS)).aggregate([("row", "list")])
            for g in codes.to_pylist():
                key, own = tuple(g[k] for k in KEYS), table.take(g["row_list"]).drop_columns(list(KEYS))
                held[key].append(own)
                sizes[key] += pc.sum(own["size"]).as_py() or 0
                if sizes[key] >= PART:
                    flush(key)
            # Of rows in the order of their keys, only the last key can go on.
            for key in [k for k in held if self.in_order and table.num_rows and k != tuple(table[n][-1].as_py() for n in KEYS)]:
                flush(key)
            while sum(sizes.values()) >= HELD:
                flush(max(sizes, key=sizes.get))
        for key in list(held):
            flush(key)
        if not lines:
            return Done(None)
        name = f"{uuid.uuid4().hex}.jsonl"
        _put(fs, f"{root}/_manifests/{name}", "\n".join(lines))
        return Done(name)

    def commit(self, messages: list[Done | None]) -> None:
        fs, root = _files(self.folder)
        number = len(_listed(fs, f"{root}/_commits"))
        names = [m.manifest for m in messages if m is not None and m.manifest]
        _put(fs, f"{root}/_commits/{number:08d}-{uuid.uuid4().hex}.json", json.dumps({"overwrite": self.overwrite, "manifests": names}))

    def abort(self, messages: list[Done | None]) -> None:
        """Nothing lists what was written; :func:`sweep` takes it away."""


class Landed(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, self.options.get("inorder") == "true")


def register(spark: SparkSession) -> None:
    """The source under its name, and Spark's switch for filters of Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)


def read(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("landed").schema(columns).load(folder)


def land(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Rows (any of the source's columns) as landed payloads. Rows of one key are brought together first, so that parts are few and full."""
    register(rows.sparkSession)
    keys = [k for k in KEYS if k in rows.columns]
    names = [n for n in _TYPES if n in rows.columns]
    rows.select(*names).sortWithinPartitions(*keys).write.format("landed").option("inorder", "true").mode(mode).save(folder)


def sweep(folder: str) -> int:
    """Delete the parts and manifests that no commit lists; the number of parts deleted. Only while nobody writes."""
    fs, root = _files(folder)
    live = {p.path for p in parts(folder)}
    stale = [f for f in _listed(fs, f"{root}/parts") if f.removeprefix(f"{root}/") not in live]
    for f in stale:
        fs.delete_file(f)
    known = {m for c in _listed(fs, f"{root}/_commits") for m in json.loads(_text(fs, c))["manifests"]}
    for f in _listed(fs, f"{root}/_manifests"):
        if f.rsplit("/", 1)[-1] not in known:
            fs.delete_file(f)
    return len(stale)
