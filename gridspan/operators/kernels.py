"""NumPy kernels of volumes: what the array expressions compute, on a whole array at once.

Python functions over Arrow batches use them, for volumes in a row (`volume`) and for tiles (`tiles`). A kernel treats the edge
of the array it gets as the edge of the volume.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each row of a list column as a view of the batch's flat values; null rows as None, null values as NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum([0 if n is None else n for n in column.value_lengths().to_pylist()])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return [flat[a:b] if valid else None for a, b, valid in zip(starts, ends, column.is_valid().to_pylist(), strict=True)]


def list_column(rows: Sequence[np.ndarray | None]) -> pa.Array:
    """A list column of flat arrays, without a Python object per value; NaN stays NaN."""
    sizes = [0 if r is None else r.size for r in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = pa.array(np.concatenate([np.ravel(r) for r in rows if r is not None]) if any(r is not None for r in rows) else np.zeros(0), pa.float64())
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def matrix_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of ``size`` values, and which of them are null or lacking (None: none); a null row lacks all."""
    lengths = column.value_lengths()
    if not column.null_count and len(column) and (np.asarray(lengths) == size).all():
        flat = column.flatten()
        missing = None if not flat.null_count else np.asarray(flat.is_null()).reshape(-1, size)
        return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size), missing
    out, missing = np.full((len(column), size), np.nan), np.ones((len(column), size), bool)
    for i, values in enumerate(column):
        if values.is_valid:
            own = values.values.cast(pa.float64())
            n = min(size, len(own))
            out[i, :n], missing[i, :n] = own.to_numpy(zero_copy_only=False)[:n], np.asarray(own.is_null())[:n]
    return out, missing


def lists_of(rows: np.ndarray, missing: np.ndarray | None, valid: np.ndarray) -> pa.Array:
    """A list column of equally long rows; ``missing`` values and rows that aren't ``valid`` are null."""
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    values = pa.array(np.ascontiguousarray(rows).ravel(), pa.float64(), mask=None if missing is None else np.ascontiguousarray(missing).ravel())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~valid))


def _shifted(x: np.ndarray, axis: int, start: int, n: int) -> np.ndarray:
    return x[(slice(None),) * axis + (slice(start, start + n),)]


def windows_along(x: np.ndarray, axis: int, width: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Windows of ``width`` that lie inside along an axis, merged in order."""
    n = x.shape[axis] - width + 1
    out = _shifted(x, axis, 0, n)
    for d in range(1, width):
        out = merge(out, _shifted(x, axis, d, n))
    return out


def _padded(x: np.ndarray, axis: int, radius: int, **how) -> np.ndarray:
    return np.pad(x, [(radius, radius) if k == axis else (0, 0) for k in range(x.ndim)], **how)


def dilate(x: np.ndarray, radius: int) -> np.ndarray:
    """1 where a voxel above 0 is within ``radius`` along every axis, else 0."""
    if not radius:
        return x
    out = (x > 0).astype(np.float64)
    for axis in range(x.ndim):
        out = windows_along(_padded(out, axis, radius, mode="constant"), axis, 2 * radius + 1, np.maximum)
    return out


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the box of ``radius``; beyond the edge the edge voxel counts again."""
    for axis in range(x.ndim):
        x = windows_along(_padded(x, axis, radius, mode="edge"), axis, 2 * radius + 1, np.add) / (2 * radius + 1)
    return x


def gradient(x: np.ndarray) -> np.ndarray:
    """Length, over the axes, of the logistic function of three times each forward difference; the difference is 0 at the far edge."""
    total = np.zeros(x.shape)
    for axis in range(x.ndim):
        step = np.zeros(x.shape)
        n = x.shape[axis] - 1
        _shifted(step, axis, 0, n)[...] = _shifted(x, axis, 1, n) - _shifted(x, axis, 0, n)
        total += (1 / (1 + np.exp(-3 * step))) ** 2
    return np.sqrt(total)


def box_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums over the boxes of ``width`` that lie inside."""
    for axis in range(x.ndim):
        x = windows_along(x, axis, width, np.add)
    return x


def local_similarity(a: np.ndarray, b: np.ndarray, data_range: float, width: int) -> np.ndarray:
    """Structural similarity of each window that lies inside; sample covariances."""
    count = width**a.ndim
    c1, c2, scale = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2, count / (count - 1)
    x, y = box_sums(a, width) / count, box_sums(b, width) / count
    vx, vy, vxy = (scale * (box_sums(p * q, width) / count - m) for p, q, m in ((a, a, x * x), (b, b, y * y), (a, b, x * y)))
    return (2 * x * y + c1) * (2 * vxy + c2) / ((x * x + y * y + c1) * (vx + vy + c2))


def bordered(c: np.ndarray, n: int, border: str) -> np.ndarray:
    """A fractional coordinate under a border rule: as it is (zeros), at the edge, or mirrored between the first and the last voxel."""
    if border == "border":
        return np.clip(c, 0.0, n - 1.0)
    if border == "reflection":
        if n == 1:
            return np.zeros_like(c)
        turns, rest = np.floor(np.abs(c) / (n - 1)), np.abs(c) % (n - 1)
        return np.where(turns % 2 == 0, rest, (n - 1) - rest)
    return c


def nearest(x: np.ndarray, places: Sequence[np.ndarray], border: str = "zeros") -> np.ndarray:
    """The voxel nearest to each fractional place, of halves the even one; 0 outside. Places are an array per axis, of one shape when broadcast."""
    at = [np.rint(bordered(np.asarray(p, float), n, border)).astype(np.int64) for p, n in zip(places, x.shape, strict=True)]
    inside = True
    for c, n in zip(at, x.shape, strict=True):
        inside = inside & (c >= 0) & (c < n)
    return np.where(inside, x[tuple(np.clip(c, 0, n - 1) for c, n in zip(at, x.shape, strict=True))], 0.0)


def interpolate(x: np.ndarray, places: Sequence[np.ndarray], border: str = "zeros") -> np.ndarray:
    """Linear interpolation at fractional places; voxels outside count 0."""
    at = [bordered(np.asarray(p, float), n, border) for p, n in zip(places, x.shape, strict=True)]
    low = [np.floor(c) for c in at]
    rest = [c - a for c, a in zip(at, low, strict=True)]
    out = 0.0
    for corner in itertools.product((0, 1), repeat=x.ndim):
        weight, tap = 1.0, []
        for r, a, d, n in zip(rest, low, corner, x.shape, strict=True):
            c = a + d
            weight = weight * np.where((c >= 0) & (c < n), r if d else 1 - r, 0.0)
            tap.append(np.clip(c, 0, n - 1).astype(np.int64))
        out = out + weight * x[tuple(tap)]
    return out


def open_grid(shape: Sequence[int], start: Sequence[int] | None = None) -> list[np.ndarray]:
    """Coordinates along each axis, shaped to be broadcast."""
    return [np.arange(n, dtype=float).reshape([-1 if j == k else 1 for j in range(len(shape))]) + (start[k] if start else 0) for k, n in enumerate(shape)]


def half_pixel(c: np.ndarray, scale: float) -> np.ndarray:
    """Where a resized voxel lies in the source: pixel centres aligned, not before the first voxel."""
    return np.maximum(scale * (c + 0.5) - 0.5, 0.0)


def along_axis(x: np.ndarray, axis: int, places: np.ndarray) -> np.ndarray:
    """Linear interpolation along one axis at places inside the array."""
    low = np.clip(np.floor(places).astype(np.int64), 0, x.shape[axis] - 1)
    high = np.minimum(low + 1, x.shape[axis] - 1)
    rest = (places - low).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
    return np.take(x, low, axis) * (1 - rest) + np.take(x, high, axis) * rest


#: Values that one step of a batch of rows makes.
STEP = 1 << 20


def sampled_rows(x: np.ndarray, shape: Sequence[int], places: Callable[[slice], list[np.ndarray]], count: int, border: str, labels: bool) -> np.ndarray:
    """Row by row: the volumes ``x`` (row, voxel) sampled at ``count`` places each. ``places`` gives for a slice of rows a (row or 1, place) array per axis."""
    out = np.empty((len(x), count))
    strides = [int(np.prod(shape[k + 1 :])) for k in range(len(shape))]
    step = max(1, STEP // max(1, count))
    for a in range(0, len(x), step):
        some = slice(a, min(a + step, len(x)))
        at = [bordered(np.asarray(p, float), n, border) for p, n in zip(places(some), shape, strict=True)]
        low = [np.rint(c) if labels else np.floor(c) for c in at]
        value = np.zeros((some.stop - a, count))
        for corner in [(0,) * len(shape)] if labels else itertools.product((0, 1), repeat=len(shape)):
            weight, index = 1.0, 0
            for c, start, d, n, stride in zip(at, low, corner, shape, strides, strict=True):
                tap = start + d
                weight = weight * np.where((tap >= 0) & (tap < n), 1.0 if labels else (c - start if d else 1 - (c - start)), 0.0)
                index = index + np.clip(tap, 0, n - 1).astype(np.int64) * stride
            taken = np.take_along_axis(x[some], np.broadcast_to(index, value.shape), 1)
            # A voxel outside counts 0, whatever stands at the edge.
            value += np.where(weight == 0, 0.0, weight * taken)
        out[some] = value
    return out


def displaced_rows(x: np.ndarray, shape: Sequence[int], fields: Sequence[np.ndarray], border: str = "border") -> np.ndarray:
    """Row by row: volumes sampled at each voxel's own displaced place; ``fields`` (row, voxel) in voxels, one for each axis."""
    own = [np.ravel(np.broadcast_to(c, shape)) for c in open_grid(shape)]
    return sampled_rows(x, shape, lambda some: [c[None] + f[some] for c, f in zip(own, fields, strict=True)], x.shape[1], border, False)


def inverted_fields(fields: Sequence[np.ndarray], shape: Sequence[int], rounds: int = 20) -> list[np.ndarray]:
    """The displacements that undo ``fields``, by fixed-point iteration: each place goes back by what the field is where it comes from."""
    back = [-f for f in fields]
    for _ in range(rounds):
        back = [-displaced_rows(f, shape, back) for f in fields]
    return back


def composed_fields(first: Sequence[np.ndarray], then: Sequence[np.ndarray], shape: Sequence[int]) -> list[np.ndarray]:
    """The displacement of going by ``first`` and then by ``then``."""
    return [a + displaced_rows(b, shape, first) for a, b in zip(first, then, strict=True)]
