"""Streams of patches and slabs: volumes put together while their patches arrive, streams aligned, results published once.

The first axis stands for event time: a case's patches come with starts that never fall, so every plane before the newest
start is final. State is one window of planes a case, the extent of a patch and its slide; a lost executor reads it back
from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspan.operators.volume import axis_weights, cells

SLAB = "case string, start int, stop int, values array<double>, late long"
STATE = "flushed int, sums binary, weights binary, done array<int>, late long"


class Window:
    """Sums and weights of the planes from ``flushed`` on; ``None`` for no blending, where the last patch's voxel stays."""

    def __init__(self, shape: tuple[int, ...], patch: tuple[int, ...], overlap: tuple[int, ...], kind: str | None):
        self.shape, self.patch, self.kind = shape, patch, kind
        self.cells = cells(shape, patch, overlap)
        self.depth = min(max(b[0] - a[0] for a, b in self.cells), shape[0])
        weight = np.ones(())
        for p, o in zip(patch, overlap, strict=True):
            weight = np.multiply.outer(weight, axis_weights(kind or "mean", p, o))
        self.weight = weight

    def fresh(self) -> tuple[int, np.ndarray, np.ndarray, set[int], int]:
        room = (2 * self.depth, *self.shape[1:])
        return 0, np.zeros(room), np.zeros(room), set(), 0

    def advance(self, state, z: int):
        """The planes before z, and the state after they have left."""
        flushed, sums, weights, done, late = state
        z = min(z, self.shape[0])
        if z <= flushed:
            return None, state
        n = z - flushed
        slab = sums[:n] / np.maximum(weights[:n], np.finfo(float).tiny) if self.kind else sums[:n].copy()
        for a in (sums, weights):
            a[:-n] = a[n:].copy()
            a[-n:] = 0
        return (flushed, z, slab), (z, sums, weights, done, late)

    def add(self, state, index: int, values: np.ndarray, strict: bool):
        """A slab that became final, if any, and the state with the patch. A patch that comes again is passed over."""
        flushed, sums, weights, done, late = state
        if index in done:
            return None, state
        start, stop = self.cells[index]
        if start[0] < flushed:
            if strict:
                raise ValueError(f"patch {index} starts at {start[0]}, but planes before {flushed} are final")
            return None, (flushed, sums, weights, done, late + 1)
        slab, (flushed, sums, weights, done, late) = self.advance(state, start[0])
        cut = tuple(slice(0, b - a) for a, b in zip(start, stop, strict=True))
        place = (slice(start[0] - flushed, stop[0] - flushed), *(slice(a, b) for a, b in zip(start[1:], stop[1:], strict=True)))
        part, weight = values.reshape(self.patch)[cut], self.weight[cut]
        if self.kind:
            sums[place] += part * weight
            weights[place] += weight
        else:
            sums[place] = part
        return slab, (flushed, sums, weights, done | {index}, late)


def assembled(patches: DataFrame, shape: tuple[int, ...], patch: tuple[int, ...], overlap: tuple[int, ...], kind: str | None = "mean", strict: bool = True) -> DataFrame:
    """case, start, stop, values, late: slabs of each case as they become final; ``patches`` streams case, patch_idx, values.

    A case's patches must arrive by their number; those of one micro-batch are put in order. The last slab comes when the last
    patch has. A patch whose planes are final is an error, or without ``strict`` counted in late.
    """
    window = Window(shape, patch, overlap, kind)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            flushed, sums, weights, done, late = state.get
            room = (2 * window.depth, *shape[1:])
            held = flushed, np.frombuffer(sums).reshape(room).copy(), np.frombuffer(weights).reshape(room).copy(), set(done), late
        else:
            held = window.fresh()
        rows = pd.concat(list(batches)).sort_values("patch_idx")
        out = []
        for index, values in zip(rows["patch_idx"], rows["values"], strict=True):
            slab, held = window.add(held, int(index), np.array(values, float), strict)
            if slab is not None:
                out.append(slab)
        if len(held[3]) == len(window.cells):
            slab, held = window.advance(held, shape[0])
            if slab is not None:
                out.append(slab)
        flushed, sums, weights, done, late = held
        state.update((flushed, sums.tobytes(), weights.tobytes(), sorted(done), late))
        yield pd.DataFrame([(key[0], a, b, s.ravel().tolist(), late) for a, b, s in out], columns=["case", "start", "stop", "values", "late"])

    return patches.groupBy("case").applyInPandasWithState(run, SLAB, STATE, "append", GroupStateTimeout.NoTimeout)


def aligned(slabs: DataFrame, stream: str, streams: int) -> DataFrame:
    """case, start, stop and values (an array by stream) of the planes that all streams of a case have: one row a plane, once.

    ``slabs`` streams case, the stream's number, z, values: a plane each. State holds the planes that some streams lack.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(z, s): np.frombuffer(v).tolist() for z, s, v in zip(*state.get, strict=True)} if state.exists else {}
        for batch in batches:
            for s, z, v in zip(batch[stream], batch["z"], batch["values"], strict=True):
                held.setdefault((int(z), int(s)), list(map(float, v)))
        planes = sorted({z for z, _ in held})
        ready = [z for z in planes if all((z, s) in held for s in range(streams))]
        rows = [(key[0], z, [held.pop((z, s)) for s in range(streams)]) for z in ready]
        left = sorted(held)
        state.update(([z for z, _ in left], [s for _, s in left], [np.array(held[k], float).tobytes() for k in left]))
        yield pd.DataFrame(rows, columns=["case", "z", "values"])

    return slabs.groupBy("case").applyInPandasWithState(run, "case string, z int, values array<array<double>>", "zs array<int>, ss array<int>, vs array<binary>", "append", GroupStateTimeout.NoTimeout)


def frontier(slabs: DataFrame, keys: list[str], stream: str, stop: str) -> DataFrame:
    """Where all streams of a key have come to: the least of their furthest stops."""
    ends = slabs.groupBy(*keys, stream).agg(F.max(stop).alias("__stop"))
    return ends.groupBy(*keys).agg(F.min("__stop").alias("frontier"), F.count("*").alias("streams"))


def out_of_contract(patches: DataFrame, keys: list[str], order: str, start: str, extent: int) -> DataFrame:
    """keys, order, start of patches that break the contract: a first one not at 0, a start that falls, or one further than a patch's extent."""
    from pyspark.sql.window import Window as W

    before = F.lag(start).over(W.partitionBy(*keys).orderBy(order))
    step = F.col(start) - F.coalesce(F.col("__before"), F.lit(0))
    bad = F.when(F.col("__before").isNull(), F.col(start) != 0).otherwise((step < 0) | (step > extent))
    return patches.withColumn("__before", before).where(bad).select(*keys, order, start)


def halo_planes(planes: DataFrame, keys: list[str], axis: str, values: str, radius: int) -> DataFrame:
    """Each plane with those within ``radius`` along the axis, as an array of arrays in order: what a stage on a stream of slabs needs of its neighbours."""
    from pyspark.sql.window import Window as W

    near = W.partitionBy(*keys).orderBy(axis).rangeBetween(-radius, radius)
    return planes.withColumn("near", F.collect_list(values).over(near))


def publish(path: str):
    """For ``foreachBatch``: each batch in a folder of its number, written over if the batch comes again, so that every row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def revisions(controls: DataFrame, revision: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Each revision of a control stream once, as it first comes."""
    return controls.withWatermark(time, lateness).dropDuplicatesWithinWatermark([revision])


def streamed_metrics(voxels: DataFrame, keys: list[str], output: str, target: str) -> DataFrame:
    """keys, n, mae, mse: running aggregates of a stream, for the update and complete modes; Spark keeps partial sums as state."""
    d = F.col(output) - F.col(target)
    return voxels.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def region_stage(planes: DataFrame, depth: int, shape: tuple[int, ...], pull: Callable[[int], tuple[int, int]], produce: Callable[[np.ndarray, int, int], np.ndarray], out_depth: int | None = None) -> DataFrame:
    """case, z, values, held: the planes that one region stage makes of a stream of planes (case, z, values), each as soon as what it reads has come.

    ``pull`` gives the input planes [a, b) that output plane z is made of, rising with z; ``produce`` gets these as an array, z and a.
    State is the planes that outputs still to come read: for a halo of r at most 2 r + 1 in order, and those that came too early; ``held`` is how many
    stay after a row. A plane that comes again is passed over, and so is one that no output reads any more.
    """
    last = depth if out_depth is None else out_depth

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, held = 0, {}
        if state.exists:
            z, zs, values = state.get
            held = {k: np.frombuffer(v).reshape(shape) for k, v in zip(zs, values, strict=True)}
        out = []
        arrived = sorted((int(k), v) for batch in batches for k, v in zip(batch["z"], batch["values"], strict=True))
        for k, v in arrived:
            if z < last and k >= pull(z)[0]:
                held.setdefault(k, np.array(v, float).reshape(shape))
            while z < last and all(p in held for p in range(*pull(z))):
                a, b = pull(z)
                made = produce(np.stack([held[p] for p in range(a, b)]), z, a)
                z += 1
                low = pull(z)[0] if z < last else depth
                held = {p: x for p, x in held.items() if p >= low}
                out.append((key[0], z - 1, np.ravel(made).tolist(), len(held)))
        state.update((z, sorted(held), [held[p].tobytes() for p in sorted(held)]))
        yield pd.DataFrame(out, columns=["case", "z", "values", "held"])

    return planes.groupBy("case").applyInPandasWithState(run, "case string, z int, values array<double>, held int", "z int, zs array<int>, vs array<binary>", "append", GroupStateTimeout.NoTimeout)


def halo(depth: int, radius: int) -> Callable[[int], tuple[int, int]]:
    """The planes within ``radius``, cut at the volume's ends."""
    return lambda z: (max(0, z - radius), min(depth, z + radius + 1))
