"""Volumes of any size as tiles: a row for each box of a regular grid, so that no volume has to fit a row or a task.

``exchange`` is the one way in which tiles meet: every target tile names, axis by axis, the source window that it is computed from; each
source tile sends the parts of it that lie in such windows, one shuffle brings the parts of a window together, and a NumPy kernel
makes the target tile. A halo, a resampling, another tiling, a flip or a crop differ only in their windows. A task holds one
window and one target tile at a time. What needs no neighbour runs without a shuffle (``map_tiles``).

Tile rows hold keys, the tile's number (row-major) and an array of doubles per column. Null arrays count as missing: their voxels
are NaN. Of two rows for one tile the later one met wins; tables should have one.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspan.operators import kernels, volume

#: Bytes of tiles that are worked on and sent at once.
SENT = 4 << 20
Box = tuple[tuple[int, ...], tuple[int, ...]]
Window = Callable[[int, int], tuple[int, int]]
Kernel = Callable[[list[np.ndarray], tuple[int, ...], Box], list[np.ndarray]]


@dataclass(frozen=True)
class Tiling:
    """Extents and tile extents, the slowest axis first; the last tiles of an axis may be shorter."""

    shape: tuple[int, ...]
    tile: tuple[int, ...]

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // t) for n, t in zip(self.shape, self.tile, strict=True))

    def cut(self, axis: int, k: int) -> tuple[int, int]:
        return k * self.tile[axis], min(self.shape[axis], (k + 1) * self.tile[axis])

    def box(self, number: int) -> Box:
        index = np.unravel_index(number, self.counts)
        cuts = [self.cut(axis, int(k)) for axis, k in enumerate(index)]
        return tuple(a for a, _ in cuts), tuple(b for _, b in cuts)

    def number(self, index: Sequence[int]) -> int:
        return int(np.ravel_multi_index(tuple(index), self.counts))


def _fields(df: DataFrame, keys: list[str], columns: Sequence[str], extra: Sequence[tuple[str, T.DataType]] = ()) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in (("tile", T.IntegerType()), *extra)] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some SENT bytes, a row at least: what is made of a slice is sent before the next one is looked at."""
    for batch in batches:
        rows = max(1, SENT * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _shaped(flat: np.ndarray | None, shape: Sequence[int]) -> np.ndarray:
    return np.full(shape, np.nan) if flat is None else flat.reshape(shape)


def cut_rows(volumes: DataFrame, keys: list[str], columns: list[str], tiling: Tiling) -> DataFrame:
    """Tiles of volumes that are arrays in a row; a null volume gives tiles of nulls."""
    schema = _fields(volumes, keys, columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = range(math.prod(tiling.counts))
        for batch in batches:
            held = [kernels.rows_of(batch.column(len(keys) + i)) for i in range(len(columns))]
            for r in range(batch.num_rows):
                take = pa.array([r] * len(numbers))
                parts = []
                for rows in held:
                    whole = None if rows[r] is None else rows[r].reshape(tiling.shape)
                    parts.append(kernels.list_column([None if whole is None else np.ascontiguousarray(whole[tuple(map(slice, *tiling.box(k)))]) for k in numbers]))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keys))], pa.array(numbers, pa.int32()), *parts], names=schema.names)

    return volumes.select(*keys, *[F.col(c).cast("array<double>").alias(c) for c in columns]).mapInArrow(cut, schema)


def from_planes(planes: DataFrame, keys: list[str], z: str, columns: list[str], tiling: Tiling) -> DataFrame:
    """Tiles of volumes that are a row per plane of the first axis; one shuffle."""
    flat = planes.select(*keys, F.col(z).cast("int").alias("tile"), *[F.col(c).cast("array<double>").alias(c) for c in columns])
    return retile(flat, keys, columns, Tiling(tiling.shape, (1, *tiling.shape[1:])), tiling)


def map_tiles(tiles: DataFrame, keys: list[str], columns: list[str], tiling: Tiling, run: Callable[..., list[np.ndarray]], out: list[str] | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """Each tile by itself, without a shuffle. ``run`` gets the arrays, and numbers of the columns ``beside``."""
    names = out or columns
    schema = _fields(tiles, keys, names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = [kernels.rows_of(batch.column(len(keys) + 1 + i)) for i in range(len(columns))]
            numbers = [batch.column(len(keys) + 1 + len(columns) + i).to_pylist() for i in range(len(beside))]
            made: list[list[np.ndarray]] = [[] for _ in names]
            for r, tile in enumerate(batch.column(len(keys)).to_pylist()):
                start, stop = tiling.box(tile)
                shape = [b - a for a, b in zip(start, stop, strict=True)]
                for rows, x in zip(made, run(*[_shaped(h[r], shape) for h in held], *[n[r] for n in numbers]), strict=True):
                    rows.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *map(kernels.list_column, made)], names=schema.names)

    return tiles.select(*keys, "tile", *columns, *beside).mapInArrow(each, schema)


def _reached(window: Window, axis: int, count: int, a: int, b: int, ordered: bool) -> Sequence[int]:
    """The target tiles along an axis whose windows meet [a, b). Where windows move one way along the axis, bisection finds them."""
    if not ordered:
        return [k for k in range(count) if max(a, window(axis, k)[0]) < min(b, window(axis, k)[1])]
    if window(axis, 0)[0] > window(axis, count - 1)[0]:
        back = _reached(lambda _, k: window(axis, count - 1 - k), axis, count, a, b, True)
        return range(count - back.stop, count - back.start)
    first = bisect_right(range(count), a, key=lambda k: window(axis, k)[1])
    return range(first, max(first, bisect_left(range(count), b, key=lambda k: window(axis, k)[0])))


def exchange(tiles: DataFrame, keys: list[str], columns: list[str], source: Tiling, target: Tiling, window: Window, kernel: Kernel, *, out: list[str] | None = None, axes: Sequence[int] | None = None, ordered: bool = True) -> DataFrame:
    """Target tiles, each made by ``kernel`` of its source window: one shuffle, of no more than the windows' voxels.

    ``window`` gives for a source axis and a target tile's index along the target axis that belongs to it the source voxels [a, b);
    it must not be empty, and unless ``ordered`` is false its starts and ends rise or fall together with the index. ``axes`` gives each source axis its target
    axis. ``kernel`` gets the windows' arrays, the first source voxel, and the target box. A target tile none of whose parts
    came gets no row.
    """
    axes = list(axes) if axes is not None else list(range(len(source.shape)))
    counts, names = target.counts, out or columns
    parts_schema = _fields(tiles, keys, columns, [("lo", T.ArrayType(T.IntegerType())), ("size", T.ArrayType(T.IntegerType()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = [kernels.rows_of(batch.column(len(keys) + 1 + i)) for i in range(len(columns))]
            for r, tile in enumerate(batch.column(len(keys)).to_pylist()):
                start, stop = source.box(tile)
                shape = [b - a for a, b in zip(start, stop, strict=True)]
                whole = [_shaped(h[r], shape) for h in held]
                numbers, lows, sizes, parts = [], [], [], [[] for _ in columns]
                for met in itertools.product(*[_reached(window, axis, counts[axes[axis]], a, b, ordered) for axis, (a, b) in enumerate(zip(start, stop, strict=True))]):
                    lo = [max(a, window(axis, k)[0]) for axis, (a, k) in enumerate(zip(start, met, strict=True))]
                    hi = [min(b, window(axis, k)[1]) for axis, (b, k) in enumerate(zip(stop, met, strict=True))]
                    index = [0] * len(counts)
                    for axis, k in enumerate(met):
                        index[axes[axis]] = k
                    numbers.append(target.number(index))
                    lows.append(lo)
                    sizes.append([b - a for a, b in zip(lo, hi, strict=True)])
                    for rows, x in zip(parts, whole, strict=True):
                        rows.append(np.ascontiguousarray(x[tuple(slice(a - s, b - s) for a, b, s in zip(lo, hi, start, strict=True))]))
                if numbers:
                    take = pa.array([r] * len(numbers))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keys))], pa.array(numbers, pa.int32()), pa.array(lows, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), *map(kernels.list_column, parts)], names=parts_schema.names)

    made_schema = _fields(tiles, keys, names)

    def receive(parts: pa.Table) -> pa.Table:
        tile = parts["tile"][0].as_py()
        index = np.unravel_index(tile, counts)
        spans = [window(axis, int(index[axes[axis]])) for axis in range(len(source.shape))]
        held = [np.full([b - a for a, b in spans], np.nan) for _ in columns]
        lows, sizes = parts["lo"].to_pylist(), parts["size"].to_pylist()
        for c, whole in zip(columns, held, strict=True):
            for flat, lo, size in zip(kernels.rows_of(parts[c].combine_chunks()), lows, sizes, strict=True):
                whole[tuple(slice(a - s, a - s + n) for a, n, (s, _) in zip(lo, size, spans, strict=True))] = _shaped(flat, size)
        made = kernel(held, tuple(a for a, _ in spans), target.box(tile))
        return pa.table([*[parts[k].slice(0, 1) for k in keys], pa.array([tile], pa.int32()), *[kernels.list_column([x]) for x in made]], names=made_schema.names)

    sent = tiles.select(*keys, "tile", *columns).mapInArrow(send, parts_schema)
    return sent.groupBy(*keys, "tile").applyInArrow(receive, made_schema)


def retile(tiles: DataFrame, keys: list[str], columns: list[str], source: Tiling, target: Tiling) -> DataFrame:
    """The same volumes in other tiles."""
    return exchange(tiles, keys, columns, source, target, target.cut, lambda held, *_: held)


def with_halo(tiles: DataFrame, keys: list[str], columns: list[str], tiling: Tiling, radius: int, run: Callable[..., list[np.ndarray]], out: list[str] | None = None) -> DataFrame:
    """``run`` on each tile and ``radius`` voxels around it, cut at the volume's edge; what it gives for the tile's own voxels stays."""

    def window(axis: int, k: int) -> tuple[int, int]:
        a, b = tiling.cut(axis, k)
        return max(0, a - radius), min(tiling.shape[axis], b + radius)

    def kernel(held: list[np.ndarray], lo: tuple[int, ...], box: Box) -> list[np.ndarray]:
        own = tuple(slice(a - s, b - s) for s, a, b in zip(lo, *box, strict=True))
        return [np.ascontiguousarray(x[own]) for x in run(*held)]

    return exchange(tiles, keys, columns, tiling, tiling, window, kernel, out=out)


def dilate(tiles: DataFrame, keys: list[str], column: str, tiling: Tiling, radius: int) -> DataFrame:
    return with_halo(tiles, keys, [column], tiling, radius, lambda x: [kernels.dilate(x, radius)])


def box_mean(tiles: DataFrame, keys: list[str], column: str, tiling: Tiling, radius: int) -> DataFrame:
    return with_halo(tiles, keys, [column], tiling, radius, lambda x: [kernels.box_mean(x, radius)])


def gradient(tiles: DataFrame, keys: list[str], column: str, tiling: Tiling) -> DataFrame:
    return with_halo(tiles, keys, [column], tiling, 1, lambda x: [kernels.gradient(x)])


def resample(tiles: DataFrame, keys: list[str], column: str, source: Tiling, target: Tiling, labels: bool = False) -> DataFrame:
    """Resized to the target's extents: each tile from its ``source_window``, linear between pixel centres, or the voxel floor(o * scale) for labels."""
    scales = [n / m for n, m in zip(source.shape, target.shape, strict=True)]

    def window(axis: int, k: int) -> tuple[int, int]:
        a, b = target.cut(axis, k)
        return volume.source_window((a,), (b,), (scales[axis],), (source.shape[axis],))[0]

    def kernel(held: list[np.ndarray], lo: tuple[int, ...], box: Box) -> list[np.ndarray]:
        x = held[0]
        for axis, (s, a, b) in enumerate(zip(lo, *box, strict=True)):
            c = np.arange(a, b, dtype=float)
            if labels:
                x = np.take(x, np.minimum(np.floor(c * scales[axis]).astype(np.int64), source.shape[axis] - 1) - s, axis)
            else:
                x = kernels.along_axis(x, axis, np.minimum(kernels.half_pixel(c, scales[axis]), source.shape[axis] - 1.0) - s)
        return [np.ascontiguousarray(x)]

    return exchange(tiles, keys, [column], source, target, window, kernel)


def flip(tiles: DataFrame, keys: list[str], columns: list[str], tiling: Tiling, axes: Sequence[int]) -> DataFrame:
    """Mirrored along axes."""

    def window(axis: int, k: int) -> tuple[int, int]:
        a, b = tiling.cut(axis, k)
        return (tiling.shape[axis] - b, tiling.shape[axis] - a) if axis in axes else (a, b)

    return exchange(tiles, keys, columns, tiling, tiling, window, lambda held, *_: [np.ascontiguousarray(np.flip(x, tuple(axes))) for x in held])


def permute(tiles: DataFrame, keys: list[str], columns: list[str], source: Tiling, target: Tiling, dims: Sequence[int]) -> DataFrame:
    """Output axis k is source axis dims[k]."""
    axes = [list(dims).index(d) for d in range(len(dims))]
    return exchange(tiles, keys, columns, source, target, lambda axis, k: target.cut(axes[axis], k), lambda held, *_: [np.ascontiguousarray(np.transpose(x, dims)) for x in held], axes=axes)


def crop(tiles: DataFrame, keys: list[str], columns: list[str], source: Tiling, target: Tiling, start: Sequence[int]) -> DataFrame:
    """The region of the target's extents from ``start`` on."""

    def window(axis: int, k: int) -> tuple[int, int]:
        a, b = target.cut(axis, k)
        return a + start[axis], b + start[axis]

    return exchange(tiles, keys, columns, source, target, window, lambda held, *_: held)


def pad(tiles: DataFrame, keys: list[str], columns: list[str], source: Tiling, target: Tiling, before: Sequence[int], mode: str = "constant", fill: float = 0.0) -> DataFrame:
    """Wider by ``before`` and up to the target's extents; modes constant, reflect (by less than the extent) and replicate."""
    how = {"constant": {"mode": "constant", "constant_values": fill}, "reflect": {"mode": "reflect"}, "replicate": {"mode": "edge"}}[mode]

    def window(axis: int, k: int) -> tuple[int, int]:
        a, b = (c - before[axis] for c in target.cut(axis, k))
        n = source.shape[axis]
        low, high = max(0, min(a, n - 1)), min(n, max(b, 1))
        # What is mirrored lies on the other side of the edge.
        return (min(low, n - 1 - (b - n)) if mode == "reflect" and b > n else low), (max(high, 1 - a) if mode == "reflect" and a < 0 else high)

    def kernel(held: list[np.ndarray], lo: tuple[int, ...], box: Box) -> list[np.ndarray]:
        made = []
        for x in held:
            for axis, (s, a, b) in enumerate(zip(lo, *box, strict=True)):
                c = np.arange(a, b) - before[axis]
                n = source.shape[axis]
                inside = np.clip(c, 0, n - 1) if mode != "reflect" else np.where(c < 0, -c, np.where(c > n - 1, 2 * (n - 1) - c, c))
                taken = np.take(x, inside - s, axis)
                if mode == "constant":
                    taken[(slice(None),) * axis + ((c < 0) | (c >= n),)] = how["constant_values"]
                x = taken
            made.append(np.ascontiguousarray(x))
        return made

    return exchange(tiles, keys, columns, source, target, window, kernel, ordered=mode != "reflect")


def blend(pieces: DataFrame, keys: list[str], column: str, tiling: Tiling, patch: tuple[int, ...], overlap: tuple[int, ...], kind: str | None) -> DataFrame:
    """Tiles put together from patches (keys, patch_idx, column): the weighted mean over patches, or for no kind the last patch's voxel.

    One shuffle: a patch's part in a tile goes to that tile, which holds one array of sums and one of weights. A patch number that comes
    twice counts once, the last of its values by their order. Null voxels add their weight and nothing else; where no patch lies, or
    for no kind the last patch has a null, voxels are null. Voxels of a patch beyond the volume are left out.
    """
    starts = volume.cells(tiling.shape, patch, overlap)
    weight = np.ones(())
    for p, o in zip(patch, overlap, strict=True):
        weight = np.multiply.outer(weight, volume.axis_weights(kind or "mean", p, o))
    size = math.prod(patch)
    ints = T.ArrayType(T.IntegerType())
    parts_schema = T.StructType([*_fields(pieces, keys, [], [("patch", T.LongType()), ("lo", ints), ("size", ints)]).fields, T.StructField(column, T.ArrayType(T.DoubleType()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, missing = kernels.matrix_of(batch.column(len(keys) + 1), size)
            rows, numbers, patches, lows, sizes, held, gaps = ([] for _ in range(7))

            def sent(rows=rows, numbers=numbers, patches=patches, lows=lows, sizes=sizes, held=held, gaps=gaps, batch=batch, missing=missing) -> pa.RecordBatch:
                values = kernels.list_column(held)
                if missing is not None:
                    values = pa.ListArray.from_arrays(values.offsets, pa.array(np.concatenate(held), pa.float64(), mask=np.concatenate(gaps)))
                take = pa.array(rows)
                out = pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keys))], pa.array(numbers, pa.int32()), pa.array(patches, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), values], names=parts_schema.names)
                for part in (rows, numbers, patches, lows, sizes, held, gaps):
                    part.clear()
                return out

            for r, index in enumerate(batch.column(len(keys)).to_pylist()):
                if index is None or not 0 <= index < len(starts):
                    continue
                start, _ = starts[index]
                stop = [min(a + p, n) for a, p, n in zip(start, patch, tiling.shape, strict=True)]
                whole, lost = x[r].reshape(patch), None if missing is None else missing[r].reshape(patch)
                for met in itertools.product(*[range(a // t, -(-b // t)) for a, b, t in zip(start, stop, tiling.tile, strict=True)]):
                    cuts = [tiling.cut(axis, k) for axis, k in enumerate(met)]
                    lo = [max(a, c) for a, (c, _) in zip(start, cuts, strict=True)]
                    hi = [min(b, d) for b, (_, d) in zip(stop, cuts, strict=True)]
                    own = tuple(slice(a - s, b - s) for a, b, s in zip(lo, hi, start, strict=True))
                    rows.append(r)
                    numbers.append(tiling.number(met))
                    patches.append(index)
                    lows.append(lo)
                    sizes.append([b - a for a, b in zip(lo, hi, strict=True)])
                    held.append(np.ravel(whole[own]))
                    if lost is not None:
                        gaps.append(np.ravel(lost[own]))
                if len(held) * size * 8 > SENT:
                    yield sent()
            if held:
                yield sent()

    made_schema = _fields(pieces, keys, [column])

    def receive(parts: pa.Table) -> pa.Table:
        tile = parts["tile"][0].as_py()
        start, stop = tiling.box(tile)
        shape = [b - a for a, b in zip(start, stop, strict=True)]
        sums, weights, gaps = np.zeros(shape), np.zeros(shape), np.ones(shape, bool)
        held: dict[int, tuple] = {}
        values = parts[column].combine_chunks()
        flat = values.flatten()
        nulls = np.asarray(flat.is_null()) if flat.null_count else None
        at = 0
        for x, index, lo, n in zip(kernels.rows_of(values), parts["patch"].to_pylist(), parts["lo"].to_pylist(), parts["size"].to_pylist(), strict=True):
            missing = None if nulls is None else nulls[at : at + x.size]
            at += x.size
            if index not in held or tuple(x) > tuple(held[index][2]):
                held[index] = lo, n, x, missing
        for index in sorted(held):
            lo, n, x, missing = held[index]
            place = tuple(slice(a - s, a - s + m) for a, m, s in zip(lo, n, start, strict=True))
            x = x.reshape(n)
            lost = np.zeros(n, bool) if missing is None else missing.reshape(n)
            if kind is None:
                sums[place], gaps[place] = x, lost
                continue
            own = weight[tuple(slice(a - s, a - s + m) for a, m, s in zip(lo, n, starts[index][0], strict=True))]
            sums[place] += np.where(lost, 0.0, x * own)
            weights[place] += own
            gaps[place] = False
        made = sums if kind is None else sums / np.maximum(weights, np.finfo(float).tiny)
        return pa.table([*[parts[k].slice(0, 1) for k in keys], pa.array([tile], pa.int32()), kernels.lists_of(made.reshape(1, -1), gaps.reshape(1, -1) if gaps.any() else None, np.ones(1, bool))], names=made_schema.names)

    chosen = pieces.select(*keys, F.col("patch_idx").cast("long").alias("patch_idx"), F.col(column).cast("array<double>").alias(column))
    return chosen.mapInArrow(send, parts_schema).groupBy(*keys, "tile").applyInArrow(receive, made_schema)


def structural_similarity(tiles: DataFrame, keys: list[str], a: str, b: str, tiling: Tiling, data_range: float, width: int = 7) -> DataFrame:
    """keys and ssim: the mean over the windows of ``width`` that lie inside the volume. Tiles give sums; no window map leaves its task."""
    if any(n < width for n in tiling.shape):
        raise ValueError(f"a window of {width} needs as many voxels along each axis")
    core = Tiling(tuple(n - width + 1 for n in tiling.shape), tiling.tile)

    def window(axis: int, k: int) -> tuple[int, int]:
        start, stop = core.cut(axis, k)
        return start, stop + width - 1

    def kernel(held: list[np.ndarray], lo: tuple[int, ...], box: Box) -> list[np.ndarray]:
        local = kernels.local_similarity(held[0], held[1], data_range, width)
        return [np.array([local.sum(), float(local.size)])]

    sums = exchange(tiles, keys, [a, b], tiling, core, window, kernel, out=["sums"])
    return sums.groupBy(*keys).agg((F.sum(F.get("sums", F.lit(0))) / F.sum(F.get("sums", F.lit(1)))).alias("ssim"))


def statistics(tiles: DataFrame, keys: list[str], column: str, tiling: Tiling) -> DataFrame:
    """keys, min, max, mean, std (by n - 1) of each volume: five numbers leave each tile, NaN aside."""

    def reduced(x: np.ndarray) -> list[np.ndarray]:
        x = x[~np.isnan(x)]
        mean = x.mean() if x.size else 0.0
        return [np.array([x.min(), x.max(), float(x.size), mean, ((x - mean) ** 2).sum()]) if x.size else np.array([math.inf, -math.inf, 0.0, 0.0, 0.0])]

    parts = map_tiles(tiles, keys, [column], tiling, reduced, out=["parts"])
    at = lambda i: F.get("parts", F.lit(i))
    # Means and squares of the parts to those of the whole: squares about a part's mean, and its mean's distance from the whole's.
    mean = F.sum(at(2) * at(3)) / F.nullif(F.sum(at(2)), F.lit(0.0))
    spread = F.sum(at(4)) + F.sum(at(2) * at(3) * at(3)) - mean * F.sum(at(2) * at(3))
    return parts.groupBy(*keys).agg(F.min(at(0)).alias("min"), F.max(at(1)).alias("max"), mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(F.sum(at(2)) - 1, F.lit(0.0))).alias("std"))


def long_form(tiles: DataFrame, keys: list[str], columns: list[str], tiling: Tiling, axes: list[str]) -> DataFrame:
    """keys, axes, columns: a row per voxel."""
    counts, rank = tiling.counts, len(tiling.shape)
    index, rest = [None] * rank, F.col("tile")
    for k in reversed(range(rank)):
        index[k], rest = (rest % counts[k]), F.floor(rest / counts[k])
    starts = [i * t for i, t in zip(index, tiling.tile, strict=True)]
    sizes = [F.least(F.lit(t), F.lit(n) - s) for s, t, n in zip(starts, tiling.tile, tiling.shape, strict=True)]
    flat = tiles.select(*keys, *[s.cast("int").alias(f"__s{k}") for k, s in enumerate(starts)], *[n.cast("int").alias(f"__n{k}") for k, n in enumerate(sizes)], F.posexplode(F.arrays_zip(*columns)).alias("__i", "__v"))
    out, rest = [None] * rank, F.col("__i")
    for k in reversed(range(rank)):
        out[k], rest = (F.col(f"__s{k}") + rest % F.col(f"__n{k}")).cast("int").alias(axes[k]), F.floor(rest / F.col(f"__n{k}"))
    return flat.select(*keys, *out, *[F.col(f"__v.{c}").alias(c) for c in columns])


def joined_rows(tiles: DataFrame, keys: list[str], columns: list[str], tiling: Tiling) -> DataFrame:
    """keys and whole volumes as arrays: the way back, for volumes that do fit a row."""
    whole = Tiling(tiling.shape, tiling.shape)
    return retile(tiles, keys, columns, tiling, whole).drop("tile")
