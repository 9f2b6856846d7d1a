"""Published documents, written by all tasks at once: ``df.write.format("documents")``.

Rows (path, part, line) become files: of each path its lines in order of ``part``. A document is cut into as many framed parts as it has
``part`` numbers, and no row, task or driver holds it whole. Every task writes what it has to a folder of its own; the commit lists, for every
path, its parts in order in an index, and moves the index to its name. Until then the last index, and so all of the last documents, stay.

``frame`` gives each path what stands before its first line, between lines and after the last. A reader streams a document part by part
(:func:`stream`); :func:`export` joins parts into plain files for a site's host, a task a document.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import numbered
from .landed import _files, _listed, _put, _text

#: Lines of a part.
PART_LINES = 20_000


class Done(ds.WriterCommitMessage):
    def __init__(self, index: str | None):
        self.index = index


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, between: str):
        self.folder, self.between = folder, between

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, root = _files(self.folder)
        task, lines, stream, at = uuid.uuid4().hex, [], None, None
        try:
            for batch in iterator:
                for path, part, line in zip(*[batch[c].to_pylist() for c in ("path", "part", "line")], strict=True):
                    if at != (path, part):
                        if stream is not None:
                            stream.close()
                        name = f"parts/{task}-{len(lines):06d}"
                        fs.create_dir(f"{root}/parts", recursive=True)
                        stream, at = fs.open_output_stream(f"{root}/{name}"), (path, part)
                        lines.append(json.dumps({"path": path, "part": part, "file": name}))
                    else:
                        stream.write(self.between.encode())
                    stream.write(line.encode("utf-8", "surrogatepass"))
        finally:
            if stream is not None:
                stream.close()
        if not lines:
            return Done(None)
        _put(fs, f"{root}/_tasks/{task}.jsonl", "\n".join(lines))
        return Done(f"{task}.jsonl")

    def commit(self, messages: list[Done | None]) -> None:
        fs, root = _files(self.folder)
        number = len(_listed(fs, f"{root}/_versions"))
        _put(fs, f"{root}/_versions/{number:08d}-{uuid.uuid4().hex}.json", json.dumps({"between": self.between, "tasks": [m.index for m in messages if m is not None and m.index]}))

    def abort(self, messages: list[Done | None]) -> None:
        """No version lists what was written."""


class Documents(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, part long, line string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("between", "\n"))


def write(lines: DataFrame, folder: str, order: list[str], between: str = "\n", part_lines: int = PART_LINES) -> None:
    """Lines (path, line and ``order``) as documents, one a path: numbered by ranges, so that a path with most of the lines is dealt as well."""
    lines.sparkSession.dataSource.register(Documents)
    rows = numbered(lines, ["path"], order, "__n").select("path", F.floor((F.col("__n") - 1) / part_lines).alias("part"), "line", "__n")
    dealt = rows.repartition("path", "part").sortWithinPartitions("path", "part", "__n").select("path", "part", "line")
    dealt.write.format("documents").option("between", between).mode("append").save(folder)


def index(folder: str) -> tuple[dict[str, list[str]], str]:
    """The last version's documents: the files of each path in order, and what stands between lines."""
    fs, root = _files(folder)
    versions = _listed(fs, f"{root}/_versions")
    if not versions:
        return {}, ""
    last = json.loads(_text(fs, versions[-1]))
    parts = sorted((p["path"], p["part"], p["file"]) for t in last["tasks"] for p in map(json.loads, _text(fs, f"{root}/_tasks/{t}").splitlines()))
    out: dict[str, list[str]] = {}
    for path, _, file in parts:
        out.setdefault(path, []).append(file)
    return out, last["between"]


def stream(folder: str, path: str, head: str = "", tail: str = "") -> Iterator[bytes]:
    """A document's bytes, some at a time."""
    fs, root = _files(folder)
    files, between = index(folder)
    yield head.encode()
    for i, name in enumerate(files.get(path, ())):
        if i:
            yield between.encode()
        with fs.open_input_stream(f"{root}/{name}") as f:
            while chunk := f.read(1 << 20):
                yield chunk
    yield tail.encode()


def export(spark: SparkSession, folder: str, target: str, head: str = "", tail: str = "") -> int:
    """Every document as one file below ``target``, a task a document, each under its name only when whole; the number of documents."""
    files, _ = index(folder)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(target)
        for batch in batches:
            for path in batch["path"].to_pylist():
                place, _, name = f"{root}/{path}".rpartition("/")
                fs.create_dir(place, recursive=True)
                with fs.open_output_stream(f"{place}/.{name}.part") as out:
                    for chunk in stream(folder, path, head, tail):
                        out.write(chunk)
                fs.move(f"{place}/.{name}.part", f"{place}/{name}")
            yield batch.select(["path"])

    if not files:
        return 0
    paths = spark.createDataFrame([(p,) for p in files], "path string").repartition(min(len(files), 1000), "path")
    return paths.mapInArrow(one, "path string").count()


def feed(events: DataFrame, folder: str, order: list[str], path: str = "events.json", part_lines: int = PART_LINES) -> None:
    """The published feed's events as lines of one document, between commas; its frame holds what is said of the whole."""
    line = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    write(events.select(F.lit(path).alias("path"), line.alias("line"), *order), folder, order, ",", part_lines)


def pages(rows: DataFrame, folder: str, line: Column, part_lines: int = PART_LINES) -> None:
    """Rows of landing pages (kind, key, position) as a document each, under its kind and key; ``line`` renders a row."""
    path = F.concat_ws("/", "kind", F.concat("key", F.lit(".html")))
    write(rows.select(path.alias("path"), line.alias("line"), "position"), folder, ["position"], "\n", part_lines)
