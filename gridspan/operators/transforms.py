"""Voxel transforms over the long form (case, coordinates, value), and their inverses: for volumes that do not fit a row.

Volumes that do are arrays in a row; ``pointwise`` and ``volume`` transform them without a shuffle. Here null and NaN
voxels stay as they are, an empty table stays empty, and a null case is a case. Columns made on the way are vmin, vmax,
lo and hi; input columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspan.functions.arrays import let

from .ordering import quantiles


def lattice(arrays: DataFrame, case: str, values: str) -> DataFrame:
    """Long form of one array per case: case, x, value."""
    return arrays.select(case, F.posexplode(values).alias("x", "value")).withColumn("value", F.col("value").cast("double"))


def normalize(voxels: DataFrame, case: str, value: str, low: float, high: float) -> DataFrame:
    """Each case's values mapped linearly from [min, max] to [low, high]; a constant case becomes low. Keeps min and max for the inverse."""
    own = Window.partitionBy(case)
    v = voxels.withColumns({"vmin": F.min(value).over(own), "vmax": F.max(value).over(own)})
    span = F.col("vmax") - F.col("vmin")
    return v.withColumn(value, F.when(span != 0, (high - low) * (F.col(value) - F.col("vmin")) / span + low).otherwise(F.lit(low)))


def unnormalize(voxels: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return voxels.withColumn(value, (F.col(value) - low) / (high - low) * (F.col("vmax") - F.col("vmin")) + F.col("vmin")).drop("vmin", "vmax")


def standardize(voxels: DataFrame, case: str, value: str) -> DataFrame:
    """Zero mean, unit sample deviation per case; a case of one or of equal values becomes 0."""
    own = Window.partitionBy(case)
    spread = F.coalesce(F.stddev_samp(value).over(own), F.lit(0.0))
    return voxels.withColumn(value, F.when(spread == 0, F.col(value) * 0.0).otherwise((F.col(value) - F.avg(value).over(own)) / spread))


def clip_percentile(voxels: DataFrame, case: str, value: str, low: float, high: float) -> DataFrame:
    """Values held between two exact quantiles of their case; a case of any size, its values sorted in ranges."""
    bounds = quantiles(voxels, [case], value, [low, high], ["lo", "hi"])
    return voxels.join(bounds, case).withColumn(value, F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi"))).drop("lo", "hi")


def softmax(values: Column) -> Column:
    """Exponentials by their sum."""

    def of(x: Column) -> Column:
        shares = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
        return let(shares, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))

    return let(values, of)


def argmax(values: Column) -> Column:
    """The first position of the greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(voxels: DataFrame, label: str, classes: int) -> DataFrame:
    return voxels.select("*", F.posexplode(F.array(*[(F.col(label) == c).cast("int") for c in range(classes)])).alias("channel", "hot"))


def select_labels(label: Column, mapping: dict[int, int]) -> Column:
    """Labels renamed; those without a name are background."""
    out = F.lit(0)
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def flip(voxels: DataFrame, axis: str, extent: int) -> DataFrame:
    """Coordinates mirrored: no shuffle; its own inverse."""
    return voxels.withColumn(axis, F.lit(extent - 1) - F.col(axis))


def permute(voxels: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Axes renamed at once; ``axes`` maps old names to new ones."""
    return voxels.select(*[F.col(c).alias(axes.get(c, c)) for c in voxels.columns])


def gradient(voxels: DataFrame, case: str, axis: str, value: str) -> DataFrame:
    """Forward difference along an axis; 0 at the far end."""
    after = F.lead(value).over(Window.partitionBy(case).orderBy(axis))
    return voxels.withColumn("gradient", F.coalesce(after - F.col(value), F.lit(0.0)))


def dilate(voxels: DataFrame, case: str, axes: list[str], value: str, radius: int) -> DataFrame:
    """1 where a voxel above 0 lies within ``radius`` along every axis, else 0: one window an axis, each over lines along it."""
    out = voxels.withColumn(value, (F.col(value) > 0).cast("double"))
    for axis in axes:
        line = Window.partitionBy(case, *[a for a in axes if a != axis]).orderBy(axis).rangeBetween(-radius, radius)
        out = out.withColumn(value, F.max(value).over(line))
    return out


def crop_box(voxels: DataFrame, case: str, axis: str, value: str, share: float) -> DataFrame:
    """First and last coordinate of values above the case's percentile, and the voxels that the box keeps."""
    level = quantiles(voxels, [case], value, [share], ["level"])
    return voxels.join(level, case).where(F.col(value) > F.col("level")).groupBy(case).agg(F.min(axis).alias("near"), F.max(axis).alias("far"))


def pad(voxels: DataFrame, case: str, axis: str, value: str, before: int, after: int, extent: int, fill: float) -> DataFrame:
    """Coordinates shifted by ``before``, and constant voxels on both sides."""
    moved = voxels.withColumn(axis, F.col(axis) + before)
    edges = [*range(before), *range(before + extent, before + extent + after)]
    added = voxels.select(case).distinct().select(case, F.explode(F.array(*map(F.lit, edges))).alias(axis), F.lit(fill).alias(value))
    return moved.select(case, axis, value).unionByName(added)


def resample_nearest(voxels: DataFrame, case: str, axis: str, value: str, n_in: int, n_out: int) -> DataFrame:
    """Output o takes input floor(o * n_in / n_out): each input knows its outputs, no join."""
    outputs = [[o for o in range(n_out) if o * n_in // n_out == i] for i in range(n_in)]
    table = F.array(*[F.array(*map(F.lit, o)).cast("array<int>") for o in outputs])
    return voxels.select(case, F.explode(F.get(table, F.col(axis))).alias(axis), value)


def resample_linear(voxels: DataFrame, case: str, axis: str, value: str, n_in: int, n_out: int) -> DataFrame:
    """Half-pixel linear interpolation: each input emits its weighted taps, one aggregation adds them up."""
    taps: list[list[tuple[int, float]]] = [[] for _ in range(n_in)]
    for o in range(n_out):
        at = max(n_in / n_out * (o + 0.5) - 0.5, 0.0)
        first = int(at)
        second, part = min(first + 1, n_in - 1), at - int(at)
        taps[first].append((o, 1 - part))
        taps[second].append((o, part))
    kind = "array<struct<o:int,w:double>>"
    table = F.array(*[F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in own]).cast(kind) for own in taps])
    spread = voxels.select(case, value, F.explode(F.get(table, F.col(axis))).alias("tap"))
    return spread.groupBy(case, F.col("tap.o").alias(axis)).agg(F.sum(F.col(value) * F.col("tap.w")).alias(value))
