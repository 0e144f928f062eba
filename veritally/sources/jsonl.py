"""Append-only JSONL logs as a data source: ``spark.read.format("jsonl_log")`` and ``df.write.format("jsonl_log")``.

A log is a folder with ``data/`` (files of lines) and ``commits/`` (a document per append that names its files). An append is all or nothing: its lines count from the moment its commit is there. An append with the
option ``commit`` (a name) is done once, however often it is tried: a second commit of the same name changes nothing. Readers see (file, line, value): lines are numbered from 1 within their file, and a file is read
by several tasks, from places that its commit lists with their line numbers.

Paths are those of pyarrow's file systems (local, ``file://``, ``hdfs://``, ``s3://``, ``gs://``); Python workers read and write them.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "jsonl_log"
#: Bytes of a file that a task reads, and that are read at once.
PART_BYTES, READ_BYTES = 32 << 20, 4 << 20
_SCHEMA = "file string, line long, value string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _names(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json"))


@dataclass
class Part(InputPartition):
    """Lines of a file from a byte on (to another); ``line`` is the first one's number."""

    file: str
    start: int
    end: int
    line: int


@dataclass
class Written(WriterCommitMessage):
    """A file of an append: its name, bytes, and places of its lines as (byte, line)."""

    file: str
    size: int = 0
    marks: list = field(default_factory=list)


class JsonLinesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        system, root = _open(self.path)
        parts = []
        for name in _names(system, f"{root}/commits"):
            with system.open_input_stream(f"{root}/commits/{name}") as f:
                for file in json.loads(f.read())["files"]:
                    marks = [*map(tuple, file["marks"]), (file["size"], None)]
                    parts += [Part(file["file"], a, b, line) for (a, line), (b, _) in zip(marks, marks[1:], strict=False)]
        return parts or [Part("", 0, 0, 1)]

    def read(self, partition):
        system, root = _open(self.path)
        if partition.end == partition.start:
            return
        line, rest, left = partition.line, b"", partition.end - partition.start
        with system.open_input_file(f"{root}/data/{partition.file}") as f:
            f.seek(partition.start)
            while left:
                block = f.read(min(READ_BYTES, left))
                left -= len(block)
                *lines, rest = (rest + block).split(b"\n")
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines)), pa.array(range(line, line + len(lines)), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], names=["file", "line", "value"])
                    line += len(lines)


class JsonLinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: str | None):
        self.path, self.name = path, name or uuid.uuid4().hex

    def write(self, iterator):
        system, root = _open(self.path)
        system.create_dir(f"{root}/data")
        out = Written(f"{uuid.uuid4().hex}.jsonl")
        line = 1
        with system.open_output_stream(f"{root}/data/{out.file}") as f:
            for batch in iterator:
                for value in batch.column("value").to_pylist():
                    if value is None or "\n" in value:
                        raise ValueError("a line is a string without line ends")
                    if not out.marks or out.size - out.marks[-1][0] >= PART_BYTES:
                        out.marks.append((out.size, line))
                    raw = value.encode() + b"\n"
                    f.write(raw)
                    out.size, line = out.size + len(raw), line + 1
        return out

    def _drop(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/data/{m.file}")

    def commit(self, messages):
        system, root = _open(self.path)
        system.create_dir(f"{root}/commits")
        final, tmp = f"{root}/commits/{self.name}.json", f"{root}/commits/{uuid.uuid4().hex}.tmp"
        if f"{self.name}.json" in _names(system, f"{root}/commits"):
            self._drop(messages)
            return
        kept = [m for m in messages if m is not None and m.size]
        with system.open_output_stream(tmp) as f:
            f.write(json.dumps({"files": [vars(m) for m in kept]}).encode())
        if isinstance(system, fs.LocalFileSystem):
            try:
                os.link(tmp, final)
            except FileExistsError:
                self._drop(messages)
            finally:
                os.unlink(tmp)
        else:
            system.move(tmp, final)

    def abort(self, messages):
        self._drop(messages)


class JsonLines(DataSource):
    """The format; see the module."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return JsonLinesReader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a log is only appended to")
        if [f.name for f in schema.fields] != ["value"]:
            raise ValueError("a log is written from one column, value")
        return JsonLinesWriter(self.options["path"], self.options.get("commit"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of a log; empty if there is none yet."""
    spark.dataSource.register(JsonLines)
    return spark.read.format(FORMAT).load(path)


def append_lines(lines: DataFrame, path: str, commit: str | None = None) -> None:
    """Appends the one string column of ``lines``, all or none of it, and under a ``commit`` name once."""
    lines.sparkSession.dataSource.register(JsonLines)
    writer = lines.toDF("value").write.format(FORMAT).mode("append")
    (writer.option("commit", commit) if commit else writer).save(path)


def files_of(path: str, commit: str) -> list[str]:
    """The files that an append of this name has put into the log."""
    system, root = _open(path)
    with system.open_input_stream(f"{root}/commits/{commit}.json") as f:
        return [x["file"] for x in json.loads(f.read())["files"]]


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, the fields of ``schema``) of a log; a line that isn't JSON is an error that names it."""
    lines = read_lines(spark, path).where(F.trim("value") != "")
    row = F.from_json("value", schema)
    bad = F.concat(F.lit("not JSON: line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    sound = F.assert_true(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)), bad)
    return lines.where(sound.isNull()).select("file", "line", row.alias("_r")).select("file", "line", "_r.*")


def append_rows(rows: DataFrame, path: str, commit: str | None = None) -> None:
    append_lines(rows.select(F.to_json(F.struct(*rows.columns))), path, commit)
