"""Volumes read by ranges: a Python data source that seeks to the planes and rows it needs and never loads a file.

``planes`` and ``heads`` list files below ``root/case/group.ending`` and cut them into tasks by bytes, without opening one on the driver:
a task reads a file's first bytes, finds its share of the planes, and reads each plane's own bytes, or just the wanted rows of
them. Files of any size go, as no row holds more than a plane. Compressed files have one task each and are unpacked as a stream,
up to the last plane that is wanted. Filters on case and grp leave files out before they are opened, filters on z and c planes
(with ``spark.sql.python.filterPushdown.enabled``, or by the arguments). Paths may be of any file system that pyarrow opens.

Files that are no volumes, or whose headers don't read, give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridspan.sources import headers
from gridspan.sources.volumes import HEADER, PROBE, _HEADER, _as_row

#: Bytes that one task reads at most, unless a single plane has more; bytes of a batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
PLANES = "path string, case string, grp string, c int, z int, values array<double>, bytes_read long"
HEADS = f"path string, case string, grp string, length long, {HEADER}"
_ENDING = re.compile(r"\.(nii\.gz|[^.]*)$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Span(InputPartition):
    """Shares of files: (path, case, group, length, share, number of shares)."""

    files: list[tuple[str, str, str, int, int, int]] = field(default_factory=list)


def _bounds(filters: Iterable[Filter], column: str) -> tuple[int, float, set | None]:
    """[low, high) and the allowed values of a column."""
    low, high, allowed = 0, math.inf, None
    for f in filters:
        if f.attribute != (column,):
            continue
        if isinstance(f, (EqualTo, In)):
            own = set(f.value) if isinstance(f, In) else {f.value}
            allowed = own if allowed is None else allowed & own
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, f.value + isinstance(f, GreaterThan))
        else:
            high = min(high, f.value + isinstance(f, LessThanOrEqual))
    return low, high, allowed


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"], options.get("kind", "planes")
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        whole = lambda name: tuple(int(x) for x in options[name].split(":")) if options.get(name) else None
        self.z, self.rows = whole("z"), whole("rows")
        self.channels = {int(c) for c in options["channels"].split(",")} if options.get("channels") else None
        self.filters: list[Filter] = []

    def partitions(self) -> list[Span]:
        system, root = opened(self.root)
        cases, groups = (_bounds(self.filters, c)[2] for c in ("case", "grp"))
        out, filled = [Span()], 0
        # Spark takes the listing; nothing is opened here.
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            parts = info.path.split("/")
            hidden = any(p.startswith(("_", ".")) for p in parts[len(root.rstrip("/").split("/")) :])
            if info.type != fs.FileType.File or hidden or len(parts) < 2:
                continue
            case, group = parts[-2], _ENDING.sub("", parts[-1])
            if (cases is not None and case not in cases) or (groups is not None and group not in groups):
                continue
            shares = max(1, -(-info.size // self.task_bytes)) if self.kind == "planes" else 1
            cost = PROBE if self.kind != "planes" else info.size // shares
            for share in range(shares):
                if out[-1].files and filled + cost > self.task_bytes:
                    out.append(Span())
                    filled = 0
                out[-1].files.append((info.path, case, group, info.size, share, shares))
                filled += cost
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for path, case, group, length, share, shares in partition.files:
            with system.open_input_file(path) as f:
                start = f.read_at(min(PROBE, length), 0)
                try:
                    header = headers.header_of(path, start)
                except (ValueError, KeyError, TypeError, IndexError, zlib.error, headers.struct.error):
                    header = None
                if header is None:
                    continue
                if self.kind != "planes":
                    row = _as_row(header)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([case]), pa.array([group]), pa.array([length]), *[pa.array([row[x.name]], x.type) for x in _HEADER]], names=["path", "case", "grp", "length", *[x.name for x in _HEADER]])
                    continue
                yield from self._batches(path, case, group, self._planes(f, header, length, share, shares))

    def _wanted(self, header: headers.Header, share: int, shares: int) -> tuple[list[int], list[int], int, tuple[int, ...]]:
        """Channels, planes of this share, the number of planes, and the shape of one."""
        shape = header.shape if len(header.shape) > 3 else (header.shape[0], 1, *header.shape[1:])
        low, high, allowed = _bounds(self.filters, "z")
        if self.z:
            low, high = max(low, self.z[0]), min(high, self.z[1])
        planes = [z for z in range(share * shape[1] // shares, (share + 1) * shape[1] // shares) if low <= z < high and (allowed is None or z in allowed)]
        only = _bounds(self.filters, "c")[2]
        channels = [c for c in range(shape[0]) if (self.channels is None or c in self.channels) and (only is None or c in only)]
        return channels, planes, shape[1], shape[2:]

    def _planes(self, f, header: headers.Header, length: int, share: int, shares: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
        packed = header.compressed or header.format == "nii.gz"
        if packed and share:
            return
        channels, planes, depth, shape = self._wanted(header, 0 if packed else share, 1 if packed else shares)
        if not planes or not channels:
            return
        dtype = np.dtype(header.dtype)
        first, last = self.rows or (0, shape[-2])
        last = min(last, shape[-2])
        width, side = math.prod(shape[1:]) * dtype.itemsize, header.shape[0] if header.interleaved else 1
        read = _stream(f, header, length) if packed else lambda at, n: f.read_at(n, header.offset + at)
        places = [(c, z) for c in ([None] if header.interleaved else channels) for z in planes]
        for c, z in places:
            plane = ((z if c is None else c * depth + z) * shape[0] + first) * width * side
            raw = read(plane, (last - first) * width * side)
            values = np.frombuffer(raw, dtype).astype(float)
            if c is None:
                for own in channels:
                    yield own, z, values[own::side], len(raw) // side
            else:
                yield c, z, values, len(raw)

    @staticmethod
    def _batches(path: str, case: str, group: str, planes: Iterable[tuple[int, int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, int]] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([case] * n), pa.array([group] * n), pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.list_(pa.float64())), pa.array([h[3] for h in held], pa.int64())], names=["path", "case", "grp", "c", "z", "values", "bytes_read"])

        for plane in planes:
            held.append(plane)
            if sum(h[2].nbytes for h in held) >= BATCH_BYTES:
                yield batch()
                held.clear()
        if held:
            yield batch()


def _stream(f, header: headers.Header, length: int):
    """A reader of ranges that come in order, from packed bytes: what lies before a range is unpacked and dropped."""
    at_start = 0 if header.format == "nii.gz" else header.offset
    skip = header.offset if header.format == "nii.gz" else 0
    state = {"in": at_start, "out": 0, "held": b"", "unpack": zlib.decompressobj(47)}

    def read(at: int, n: int) -> bytes:
        at += skip
        parts, need = [], n
        while need:
            if state["out"] < at:
                drop = min(len(state["held"]), at - state["out"])
                state["held"], state["out"] = state["held"][drop:], state["out"] + drop
            if state["held"] and state["out"] >= at:
                part = state["held"][:need]
                parts.append(part)
                state["held"], state["out"], need = state["held"][len(part) :], state["out"] + len(part), need - len(part)
                at += len(part)
                continue
            if need:
                more = state["unpack"].unconsumed_tail
                if not more:
                    more = f.read_at(min(1 << 20, length - state["in"]), state["in"]) if state["in"] < length else b""
                    state["in"] += len(more)
                    if not more:
                        raise ValueError("a packed volume ends before its planes do")
                state["held"] += state["unpack"].decompress(more, BATCH_BYTES)
        return b"".join(parts)

    return read


class PushedReader(RangeReader):
    """With filters pushed down: Spark takes such a reader only where its setting allows that."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            whole = isinstance(f, (EqualTo, In)) and f.attribute in (("case",), ("grp",), ("c",), ("z",))
            ordered = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("z",)
            if (whole or ordered) and (self.kind == "planes" or f.attribute in (("case",), ("grp",))):
                self.filters.append(f)
            else:
                yield f


class VolumeRanges(DataSource):
    """``format("gridspan_ranges")``: options path, kind (planes or heads), z and rows (``a:b``), channels (``0,2``), task_bytes, pushed (true where filters may be)."""

    @classmethod
    def name(cls) -> str:
        return "gridspan_ranges"

    def schema(self) -> str:
        return HEADS if self.options.get("kind", "planes") != "planes" else PLANES

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushed") == "true" else RangeReader)(dict(self.options))


def _read(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(VolumeRanges)
    reader = spark.read.format("gridspan_ranges").option("path", root).option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()


def heads(spark: SparkSession, root: str) -> DataFrame:
    """path, case, grp, length and the header's fields of each volume: 64 KB of a file are read, whatever its size."""
    return _read(spark, root, kind="heads")


def planes(spark: SparkSession, root: str, z: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, channels: list[int] | None = None, task_bytes: int | None = None) -> DataFrame:
    """path, case, grp, c, z, values, bytes_read: planes [z) of each volume, or rows [rows) of these; bytes_read were read for it, packed files' as unpacked."""
    span = lambda x: None if x is None else f"{x[0]}:{x[1]}"
    return _read(spark, root, z=span(z), rows=span(rows), channels=None if channels is None else ",".join(map(str, channels)), task_bytes=task_bytes)
