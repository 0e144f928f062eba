"""Lines of a member of a tar archive as a data source: ``spark.read.format("tar_lines").option("member", ending).load(path)``.

Nothing is unpacked. Of a plain tar the headers alone are read to find the member, and executors read ranges of it, each line where it begins. A compressed tar can only be read from its start: one task streams it, and
hands lines on as they come. Rows are (member, at, value): ``at`` is the byte in the member where the line begins. Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import tarfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritally.sources.jsonl import _open

FORMAT = "tar_lines"
#: Bytes of a member that a task reads, and that are read at once.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a member that begins at byte ``base`` of the archive; of a compressed one the whole (base -1)."""

    member: str
    base: int
    size: int
    start: int
    end: int


def _lines(read, at: int, stop: int, first: bool):
    """(place, line) of the lines that begin before ``stop``; ``read`` gives the bytes from ``at`` on. Unless ``first``, ``at`` is a byte before the range: what ends there or later began before."""
    rest, skip = b"", not first
    while at < stop or rest or skip:
        block = read(READ_BYTES)
        if not block:
            if rest and not skip and at < stop:
                yield at, rest
            return
        rest += block
        *lines, tail = rest.split(b"\n")
        for line in lines:
            if not skip and at < stop:
                yield at, line
            skip = False
            at += len(line) + 1
        rest = tail
        if at >= stop and not skip:
            return


class TarReader(DataSourceReader):
    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def _is(self, member: tarfile.TarInfo) -> bool:
        return member.isfile() and ("/" + member.name).endswith(self.ending)

    def partitions(self):
        system, path = _open(self.path)
        with system.open_input_file(path) as f:
            if f.read(2) == b"\x1f\x8b":
                return [Range("", -1, 0, 0, 0)]
            f.seek(0)
            with tarfile.open(fileobj=f, mode="r:") as tar:
                member = next((m for m in tar if self._is(m)), None)
        if member is None:
            raise FileNotFoundError(f"{self.path} has no member that ends in {self.ending}")
        return [Range(member.name, member.offset_data, member.size, a, min(a + RANGE_BYTES, member.size)) for a in range(0, max(1, member.size), RANGE_BYTES)]

    def read(self, partition):
        system, path = _open(self.path)
        if partition.base >= 0:
            with system.open_input_file(path) as f:
                at = max(0, partition.start - 1)
                f.seek(partition.base + at)
                left = [partition.size - at]

                def read(n: int) -> bytes:
                    block = f.read(min(n, left[0]))
                    left[0] -= len(block)
                    return block

                yield from self._batches(partition.member, _lines(read, at, partition.end, partition.start == 0))
            return
        with system.open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
            for member in tar:
                if self._is(member):
                    source = tar.extractfile(member)
                    yield from self._batches(member.name, _lines(source.read, 0, member.size, True))
                    return
        raise FileNotFoundError(f"{self.path} has no member that ends in {self.ending}")

    @staticmethod
    def _batches(member: str, lines):
        places, values, size = [], [], 0
        hand = lambda: pa.RecordBatch.from_arrays([pa.array([member] * len(values)), pa.array(places, pa.int64()), pa.array(values, pa.binary()).cast(pa.string())], names=["member", "at", "value"])
        for at, line in lines:
            places.append(at)
            values.append(line)
            size += len(line)
            if size >= READ_BYTES:
                yield hand()
                places, values, size = [], [], 0
        if values:
            yield hand()


class TarLines(DataSource):
    """The format; see the module."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "member string, at long, value string"

    def reader(self, schema):
        return TarReader(self.options["path"], self.options["member"])


def read_member(spark: SparkSession, archive: str, ending: str) -> DataFrame:
    """(member, at, value): the lines of the first member whose path ends so."""
    spark.dataSource.register(TarLines)
    return spark.read.format(FORMAT).option("member", ending).load(archive)
