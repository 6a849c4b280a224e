"""`format("mtx")`: MatrixMarket coordinate files as a data source.

    register(spark)
    spark.read.format("mtx").load(path).where("row between 10 and 20")
    df.write.format("mtx").option("n", 100).option("entries", 460).mode("overwrite").save(path)

A path is a file, or a folder whose files by name are one file cut in parts.  Reading is
dealt by byte ranges; the driver reads the banner and the size line only.  Bounds on row
and col are applied before values are parsed.  Columns are row, col (long, 0-based) and
val (double); symmetric files give both halves.

Writing puts a part for each task into a folder of its own; the commit compares the number of
entries with option `entries` (where given), writes the size line and moves the parts in
place.  With a wrong number nothing appears at the path.  Paths are those of pyarrow's
file systems (local, s3, gs, hdfs); `read_mtx` reaches whatever Spark does.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SCHEMA = "row long, col long, val double"
#: Bytes of a range, and of a piece of it that is parsed at once.
RANGE_BYTES, PIECE_BYTES = 32 << 20, 4 << 20
BANNER = "%%MatrixMarket matrix coordinate real general"


def _place(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str) -> tuple[list[tuple[str, int]], object]:
    """(path, bytes) of the parts, by name."""
    from pyarrow import fs

    system, place = _place(path)
    found = system.get_file_info(place)
    if found.type == fs.FileType.File:
        return [(place, found.size)], system
    if found.type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such file: {path}")
    parts = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    if not parts:
        raise FileNotFoundError(f"no file in {path}")
    return parts, system


@dataclass(frozen=True)
class Head:
    """What banner and size line say, and where the entries begin."""

    field: str
    symmetry: str
    n: int
    entries: int
    start: int


def head(path: str) -> Head:
    """Read the head of a file or of the first part of a folder."""
    parts, system = _files(path)
    with system.open_input_stream(parts[0][0]) as stream:
        data, line_start, kind = b"", 0, BANNER.lower().split()
        while True:
            end = data.find(b"\n", line_start)
            if end < 0:
                more = stream.read(1 << 16)
                if more:
                    data += more
                    continue
                end = len(data)
            line = data[line_start:end].decode("utf8", "replace").strip()
            if not line_start and line.startswith("%%MatrixMarket"):
                kind = line.lower().split()
            if line and not line.startswith("%"):
                break
            if end >= len(data):
                raise ValueError(f"no size line in {path}")
            line_start = end + 1
    if len(kind) != 5 or kind[1:3] != ["matrix", "coordinate"] or kind[3] not in ("real", "integer", "pattern") or kind[4] not in ("general", "symmetric"):
        raise ValueError(f"not a coordinate matrix of numbers: {' '.join(kind)}")
    rows, cols, entries = map(int, line.split()[:3])
    if rows != cols:
        raise ValueError(f"the matrix is not square: {rows} x {cols}")
    return Head(kind[3], kind[4], rows, entries, end + 1)


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes start to end of a file."""

    path: str
    start: int
    end: int


def _lines(path: str, start: int, end: int, first: int) -> Iterator[bytes]:
    """Whole lines that begin at start or later and before end, in pieces; `first` is where lines begin."""
    system, _ = _place(path)
    with system.open_input_file(path) as f:
        at = start
        if start > first:  # the line that runs into the range belongs to the one before
            f.seek(start - 1)
            rest = b""
            while b"\n" not in rest and (more := f.read(1 << 16)):
                rest += more
            if b"\n" not in rest:
                return
            at = start - 1 + rest.index(b"\n") + 1
        while at < end:
            f.seek(at)
            piece = f.read(min(PIECE_BYTES, end - at))
            if not piece:
                return
            while not piece.endswith(b"\n") and (more := f.read(1 << 16)):
                cut = more.find(b"\n")
                piece += more if cut < 0 else more[: cut + 1]
                if cut >= 0:
                    break
            at += len(piece)
            yield piece


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes, self.head = path, range_bytes, head(path)
        self.low, self.high = {"row": 0, "col": 0}, {"row": self.head.n - 1, "col": self.head.n - 1}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds on row and col are taken; what else there is comes back."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and name is not None:
                continue  # no column of an entry is null
            if name not in self.low or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.low[name], self.high[name] = max(self.low[name], f.value), min(self.high[name], f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        parts, _ = _files(self.path)
        if any(self.low[c] > self.high[c] for c in self.low):
            return [Range(parts[0][0], 0, 0)]
        found = []
        for k, (path, size) in enumerate(parts):
            first = self.head.start if k == 0 else 0
            found += [Range(path, at, min(at + self.range_bytes, size)) for at in range(first, size, self.range_bytes)]
        return found or [Range(parts[0][0], 0, 0)]

    def read(self, partition: Range):
        import numpy as np
        import pyarrow as pa

        width = 2 if self.head.field == "pattern" else 3
        parts, _ = _files(self.path)
        first = self.head.start if partition.path == parts[0][0] else 0
        for piece in _lines(partition.path, partition.start, partition.end, first):
            lines = piece.split(b"\n")
            if b"%" in piece:
                lines = [x for x in lines if not x.lstrip().startswith(b"%")]
            fields = [x.split() for x in lines if x.strip()]
            if not fields:
                continue
            if any(len(x) < width for x in fields):
                raise ValueError(f"{partition.path} has an entry of fewer than {width} fields")
            place = np.array([x[:2] for x in fields]).astype(np.int64) - 1
            row, col = place[:, 0], place[:, 1]
            if place.min() < 0 or place.max() >= self.head.n:
                raise ValueError(f"{partition.path} has entries outside the matrix")
            inside = lambda r, c: (r >= self.low["row"]) & (r <= self.high["row"]) & (c >= self.low["col"]) & (c <= self.high["col"])
            own = inside(row, col)
            other = (inside(col, row) & (row != col)) if self.head.symmetry == "symmetric" else np.zeros(len(row), bool)
            at = np.flatnonzero(own | other)
            val = np.ones(len(at)) if width == 2 else np.array([fields[i][2] for i in at.tolist()], dtype="S").astype(np.float64)
            if not np.isfinite(val).all():
                raise ValueError(f"{partition.path} has values that aren't finite")
            for keep, r, c in ((own[at], row[at], col[at]), (other[at], col[at], row[at])):
                if keep.any():
                    yield pa.record_batch([pa.array(r[keep]), pa.array(c[keep]), pa.array(val[keep])], ["row", "col", "val"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    entries: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, n: int, entries: int | None, overwrite: bool):
        self.path, self.n, self.entries, self.overwrite = path, n, entries, overwrite
        self.temporary = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        """A part of lines; tries of a task have names of their own, and only one is committed."""
        from pyspark import TaskContext

        context = TaskContext.get()
        system, place = _place(self.temporary)
        system.create_dir(place, recursive=True)
        name = f"part-{context.partitionId() + 1:05d}-{context.taskAttemptId()}"
        written = 0
        with system.open_output_stream(f"{place}/{name}") as out:
            for batch in iterator:
                row, col, val = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "col", "val"))
                if any(x is None or not 0 <= x < self.n for x in (*row, *col)) or None in val:
                    raise ValueError("an entry is null or outside the matrix")
                out.write("".join(f"{r + 1} {c + 1} {v!r}\n" for r, c, v in zip(row, col, val, strict=True)).encode())
                written += len(row)
        return Part(name, written)

    def commit(self, messages: list[Part | None]) -> None:
        """Check the number of entries, then put the parts in place behind a part with the size line."""
        from pyarrow import fs

        parts = [m for m in messages if m is not None]
        total = sum(m.entries for m in parts)
        if self.entries is not None and total != self.entries:
            raise ValueError(f"{total} entries were written; {self.entries} are due")
        system, place = _place(self.path)
        there = [f.path for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if not f.base_name.startswith("_writing-")]
        if there and not self.overwrite:
            raise FileExistsError(f"{self.path} has files; write with mode overwrite")
        _, temporary = _place(self.temporary)
        system.create_dir(temporary, recursive=True)
        with system.open_output_stream(f"{temporary}/part-00000") as out:
            out.write(f"{BANNER}\n{self.n} {self.n} {total}\n".encode())
        for old in there:
            system.delete_file(old)
        for name in ["part-00000", *(m.name for m in parts)]:
            system.move(f"{temporary}/{name}", f"{place}/{name}")
        system.delete_dir(temporary)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, place = _place(self.temporary)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class MtxSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        if "n" not in self.options:
            raise ValueError("option n is missing: the size of the matrix")
        entries = self.options.get("entries")
        return Writer(self.options["path"], int(self.options["n"]), int(entries) if entries is not None else None, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its code travels to the workers, which needn't have this package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MtxSource)
