"""Recordings' signals as a splittable source: one file is many tasks, each reading its own range of bytes.

    signals.register(spark)
    spark.read.format("mat_signals").option("chunk", 65536).load(folder)

A level-5 MAT file stores an uncompressed array as one run of numbers, so where each sample lies is known from the headers, of which
the driver reads a few bytes a file. A partition is a file and a range of samples; a task seeks to it and gives rows of ``chunk``
samples (record_id, freq, chunk, start_sample, raw). With the option pushdown, filters on record_id and start_sample leave out files and
ranges before any is read; Spark asks for spark.sql.python.filterPushdown.enabled then. Arrays that are compressed can't be split: such a file is one partition.

Files without a readable signal have no rows. Paths may be remote; they are read by Arrow's file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tachygraph.sources import matfile

SCHEMA = "record_id string, freq int, chunk long, start_sample long, raw array<double>"
#: Samples in a row, and rows in a partition.
CHUNK, ROWS = 65_536, 64
#: Partitions of a folder, about: where ``rows`` in each would make more, a partition has more rows.
PARTITIONS = 512
HEADER = 128


@dataclass
class Signal(InputPartition):
    """Samples first to last (exclusive) of the array at ``offset`` of a file; offset -1: of a file that must be read whole."""

    path: str
    freq: int
    offset: int
    kind: str
    first: int
    last: int

    @property
    def record(self) -> str:
        return self.path.rsplit("/", 1)[-1].removesuffix(".mat")


def opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _tag(f, order: str) -> tuple[int, int, bytes | None] | None:
    """An element's type and size, and its data if that is within the tag."""
    head = f.read(8)
    if len(head) < 8:
        return None
    kind, size = struct.unpack(order + "II", head)
    return (kind & 0xFFFF, kind >> 16, head[4 : 4 + (kind >> 16)]) if kind >> 16 else (kind, size, None)


def _small(f, order: str) -> bytes | None:
    tag = _tag(f, order)
    if tag is None:
        return None
    kind, size, data = tag
    if data is None:
        data = f.read(size)
        f.seek(f.tell() + -size % 8)
    return data


def located(f, path: str, name: str = "raw_data") -> Signal | None:
    """Where the array ``name`` lies, by the headers alone; None if the file has none."""
    head = f.read(HEADER)
    order = "<" if head[126:128] == b"IM" else ">"
    found, freq = None, None
    while (tag := _tag(f, order)) is not None:
        kind, size, _ = tag
        begin = f.tell()
        if kind == matfile.COMPRESSED:
            found = found or Signal(path, 0, -1, "", 0, 0)
        elif kind == matfile.MATRIX:
            flags, shape, label = (_small(f, order) for _ in range(3))
            if flags is not None and shape is not None and label is not None and label.decode() in (name, "frequency"):
                data = _tag(f, order)
                if data is not None and data[0] in matfile.TYPES:
                    dtype, n = np.dtype(order + matfile.TYPES[data[0]]), int(np.prod(np.frombuffer(shape, order + "i4")))
                    if label.decode() == name:
                        found = Signal(path, 0, f.tell(), dtype.str, 0, n)
                    elif n:
                        raw = data[2] if data[2] is not None else f.read(dtype.itemsize)
                        freq = int(np.frombuffer(raw, dtype, 1)[0])
        f.seek(begin + size + (-size % 8 if kind != matfile.COMPRESSED else 0))
    return None if found is None or (found.offset >= 0 and freq is None) else replace(found, freq=freq or 0)


class Reader(DataSourceReader):
    def __init__(self, path: str, chunk: int, rows: int) -> None:
        self.path, self.chunk, self.rows, self.kept = path, chunk, rows, []

    def _may_hold(self, s: Signal) -> bool:
        for f in self.kept:
            if f.attribute == ("record_id",):
                if isinstance(f, EqualTo) and f.value != s.record:
                    return False
            elif s.offset >= 0:
                low = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and s.last <= f.value
                high = isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and s.first > f.value
                if low or high:
                    return False
        return True

    def partitions(self) -> list[Signal]:
        from pyarrow import fs

        system, at = opened(self.path)
        files = [x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".mat")]
        scheme = self.path.split(at, 1)[0] if "://" in self.path else ""
        found = []
        for path in sorted(files):
            if not self._may_hold(Signal(path, 0, -1, "", 0, 0)):
                continue
            with system.open_input_file(path) as f:
                whole = located(f, f"{scheme}{path}")
            if whole is not None:
                found.append(whole)
        step = self.chunk * max(self.rows, -(-sum(-(-x.last // self.chunk) for x in found) // PARTITIONS))
        out = []
        for whole in found:
            out.extend([whole] if whole.offset < 0 else (replace(whole, first=k, last=min(k + step, whole.last)) for k in range(0, whole.last, step)))
        return [s for s in out if self._may_hold(s)]

    def read(self, s: Signal) -> Iterator[tuple]:
        system, at = opened(s.path)
        with system.open_input_file(at) as f:
            if s.offset < 0:
                try:
                    got = matfile.loads(f.read())
                    raw, freq = got["raw_data"].ravel(order="F").astype(float), int(got["frequency"].ravel()[0])
                except (KeyError, ValueError, struct.error):
                    return
                for k in range(0, len(raw), self.chunk):
                    yield s.record, freq, k // self.chunk, k, raw[k : k + self.chunk].tolist()
                return
            dtype = np.dtype(s.kind)
            f.seek(s.offset + s.first * dtype.itemsize)
            for k in range(s.first, s.last, self.chunk):
                n = min(self.chunk, s.last - k)
                yield s.record, s.freq, k // self.chunk, k, np.frombuffer(f.read(n * dtype.itemsize), dtype, n).astype(float).tolist()


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Remembers what can leave out partitions; Spark applies all filters again to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("record_id",), ("start_sample",)):
                self.kept.append(f)
            yield f


class MatSignals(DataSource):
    """The source ``mat_signals``; options: chunk (samples in a row), rows (rows in a partition, at least), pushdown (false)."""

    @classmethod
    def name(cls) -> str:
        return "mat_signals"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else Reader
        return kind(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("rows", ROWS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatSignals)
