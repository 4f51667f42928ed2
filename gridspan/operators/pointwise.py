"""Voxel-wise transforms of arrays in a row, and their inverses: expressions, without a shuffle.

Null arrays give null, null voxels stay null. Statistics of a volume skip NaN and null voxels; of an empty volume,
or one without a chosen voxel, they are null, and so is what is computed with them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspan.functions.arrays import average, clean, let, quantile, sample_variance, total


def chosen(values: Column, mask: Column | None) -> Column:
    """The voxels where the mask is 1, or all."""
    if mask is None:
        return clean(values)
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: (z["m"] == 1) & z["v"].isNotNull() & ~F.isnan(z["v"])), lambda z: z["v"])


def bound(values: Column, spec: float | str, mask: Column | None = None) -> Column:
    """A constant, or min, max or percentile:p of the (masked) voxels."""
    if not isinstance(spec, str):
        return F.lit(float(spec))
    held = chosen(values, mask)
    if spec in ("min", "max"):
        return (F.array_min if spec == "min" else F.array_max)(held)
    if spec.startswith("percentile:"):
        return quantile(held, float(spec.partition(":")[2]) / 100)
    raise ValueError(f"unknown bound {spec!r}")


def clip(values: Column, low: float | str = -1024.0, high: float | str = 1024.0, mask: Column | None = None) -> Column:
    """Values held between two bounds; where a bound is null values stay as they are on that side."""
    ends = F.struct(bound(values, low, mask).alias("low"), bound(values, high, mask).alias("high"))
    return let(ends, lambda e: F.transform(values, lambda v: F.when(v < e["low"], e["low"]).when(v > e["high"], e["high"]).otherwise(v)))


def normalize(values: Column, low: float = -1.0, high: float = 1.0, least: Column | None = None, most: Column | None = None) -> Column:
    """From [min, max] to [low, high], of the volume's own or given ends; a constant volume becomes low."""
    ends = F.struct((F.array_min(clean(values)) if least is None else least).alias("a"), (F.array_max(clean(values)) if most is None else most).alias("b"))
    return let(ends, lambda e: F.transform(values, lambda v: F.when(e["b"] != e["a"], (high - low) * (v - e["a"]) / (e["b"] - e["a"]) + low).otherwise(F.lit(float(low)))))


def denormalize(values: Column, low: float, high: float, least: Column, most: Column) -> Column:
    """The inverse of ``normalize`` by the ends that it saw."""
    return F.transform(values, lambda v: (v - low) * (most - least) / (high - low) + least)


def unnormalize(values: Column, least: float = -1024.0, most: float = 3071.0) -> Column:
    """From [-1, 1] to [least, most]."""
    return F.transform(values, lambda v: (v + 1) / 2 * (most - least) + least)


def standardize(values: Column, mask: Column | None = None, mean: Column | None = None, deviation: Column | None = None) -> Column:
    """Less the mean, by the sample deviation, of the (masked) voxels or as given. A deviation of 0, as of one voxel or equal ones, gives 0."""
    held = chosen(values, mask)
    known = F.struct((average(held) if mean is None else mean).alias("m"), (F.sqrt(sample_variance(held)) if deviation is None else deviation).alias("s"))
    return let(known, lambda k: F.transform(values, lambda v: F.when(k["s"] == 0, v * 0.0).otherwise((v - k["m"]) / k["s"])))


def destandardize(values: Column, mean: Column, deviation: Column) -> Column:
    return F.transform(values, lambda v: v * deviation + mean)


def by_channel(values: Column, channels: int, apply, which: list[int] | None = None) -> Column:
    """``apply`` to each channel of a channel-first array by itself, or to the chosen ones; the others stay."""
    n = F.floor(F.size(values) / channels).cast("int")
    parts = [F.slice(values, n * k + 1, n) for k in range(channels)]
    return F.concat(*[apply(p) if which is None or k in which else p for k, p in enumerate(parts)])


def cast(values: Column, dtype: str) -> Column:
    """Elements of another type; values that do not fit are null."""
    return F.transform(values, lambda v: v.try_cast(dtype))


def channel_sum(values: Column, channels: int) -> Column:
    """Sum over the channels of each voxel."""
    return _over_channels(values, channels, lambda parts: sum(parts[1:], parts[0]))


def _over_channels(values: Column, channels: int, of) -> Column:
    """``of`` the list of each voxel's channels."""

    def bound(held: Column) -> Column:
        n = F.floor(F.size(held) / channels).cast("int")
        return F.transform(F.slice(held, F.lit(1), n), lambda v, i: of([v, *(F.get(held, i + n * k) for k in range(1, channels))]))

    return let(values, bound)


def sum_labels(values: Column, channels: int, classes: list[int]) -> Column:
    """Members' label maps added up, a member's labels first raised by the classes less one of the member before it."""
    raised = lambda k, v: F.when(v != 0, v + (classes[k - 1] - 1)).otherwise(v) if k else v
    return _over_channels(values, channels, lambda parts: sum((raised(k, v) for k, v in enumerate(parts)), F.lit(0)))


def offsets(classes: list[int]) -> list[int]:
    """What each member's labels are raised by, so that no two members share one: the foreground classes of those before it."""
    out = [0]
    for c in classes[:-1]:
        out.append(out[-1] + c - 1)
    return out


def merge_labels(values: Column, classes: list[int]) -> Column:
    """Members' label maps as one: each member's labels raised past those of the members before it; of several that claim a voxel the last wins."""
    raised = offsets(classes)

    def last(parts: list[Column]) -> Column:
        out = parts[0]
        for own, offset in list(zip(parts, raised, strict=True))[1:]:
            out = F.when(own != 0, own + offset).otherwise(out)
        return out

    return _over_channels(values, len(classes), last)


def flat_label(values: Column, labels: list[int] | None = None) -> Column:
    """1 for the chosen labels, or for all above 0."""
    return F.transform(values, lambda v: (v.isin(*labels) if labels else v > 0).cast("int"))


def percentage(values: Column, baseline: float) -> Column:
    return F.transform(values, lambda v: v / baseline * 100)


def norm(values: Column, channels: int) -> Column:
    """Length of each voxel's vector; channels first."""
    return _over_channels(values, channels, lambda parts: F.sqrt(sum((v * v for v in parts), F.lit(0.0))))


def masked(values: Column, mask: Column, outside: float = 0.0) -> Column:
    """``outside`` where the mask is 0."""
    return F.zip_with(values, mask, lambda v, m: F.when(m == 0, F.lit(outside)).otherwise(v))


def image_statistics(values: Column) -> Column:
    """A struct of min, max, mean and sample deviation."""
    held = clean(values)
    return F.struct(F.array_min(held).alias("min"), F.array_max(held).alias("max"), average(held).alias("mean"), F.sqrt(sample_variance(held)).alias("std"))


def matched_histogram(values: Column, reference: Column, points: int = 1) -> Column:
    """Values mapped so that their quantiles above the mean meet those of a reference, piecewise linear between them.

    The knots are the least value, the mean, ``points`` quantiles of the voxels above the mean, and the greatest value.
    """

    def knots(v: Column) -> Column:
        def of(m: Column) -> Column:
            above = F.filter(v, lambda x: x > m)
            inner = [quantile(above, (k + 1) / (points + 1)) for k in range(points)]
            return F.array(F.array_min(v), m, *[F.coalesce(q, m) for q in inner], F.array_max(v))

        return let(average(v), of)

    both = F.struct(knots(clean(values)).alias("a"), knots(clean(reference)).alias("b"))

    def map_one(k: Column):
        def at(v: Column) -> Column:
            out = F.get(k["b"], F.lit(0))
            for j in range(points + 2):
                a0, a1, b0, b1 = (F.get(k[c], F.lit(j + d)) for c, d in (("a", 0), ("a", 1), ("b", 0), ("b", 1)))
                out = F.when(v >= a0, F.when(a1 > a0, b0 + (v - a0) / (a1 - a0) * (b1 - b0)).otherwise(b1)).otherwise(out)
            return out

        return at

    return let(both, lambda k: F.transform(values, map_one(k)))


def clip_normalize(values: Column, low: float, high: float, mean: float, deviation: float) -> Column:
    """Held between bounds, then standardised with stored statistics."""
    return F.transform(values, lambda v: (F.least(F.greatest(v, F.lit(low)), F.lit(high)) - mean) / deviation)


def mean_of(values: Column) -> Column:
    return average(clean(values))


def channel_variance(values: Column, channels: int) -> Column:
    """Mean over the voxels of the sample variance over their channels; one channel gives 0."""
    return average(_over_channels(values, channels, lambda parts: sample_variance(F.array(*parts))))


def gram_matrix(values: Column, channels: int) -> Column:
    """Products of the channels over the number of values, as an array of rows."""
    n = F.floor(F.size(values) / channels).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: F.slice(values, k * n + 1, n))
    return let(parts, lambda p: F.transform(p, lambda a: F.transform(p, lambda b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) / F.size(values))))


def gram_distance(a: Column, b: Column, channels: int) -> Column:
    """Sum of absolute differences between two volumes' channel products."""
    rows = F.zip_with(gram_matrix(a, channels), gram_matrix(b, channels), lambda x, y: total(F.zip_with(x, y, lambda p, q: F.abs(p - q))))
    return total(rows)
