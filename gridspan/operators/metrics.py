"""Criteria as aggregate expressions: partial sums before the shuffle, ratios of global sums at the end.

Null and NaN values are left out of means; a group without a value is null with a count of 0; an empty table has no
groups. Columns that a function makes for itself start with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspan.functions.arrays import average, let, sample_variance, total
from gridspan.operators import kernels

SMOOTH = 1e-6


def clean(value: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def regression_report(df: DataFrame, keys: list[str], output: Column, target: Column, mask: Column | None = None, data_range: float = 4095.0) -> DataFrame:
    """n, mae, mse, me, rmse, psnr per group over voxels where the mask is true; psnr from the group's global mean."""
    rows = df if mask is None else df.where(mask)
    d = clean((output - target).cast("double"))
    mse = F.avg(d * d)
    return rows.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), mse.alias("mse"), F.avg(d).alias("me"), F.sqrt(mse).alias("rmse"), (10 * F.log10(data_range**2 / mse)).alias("psnr"))


def masked_item_mean(df: DataFrame, keys: list[str], item: str, error: Column, mask: Column) -> DataFrame:
    """Mean over items of their masked mean; items without a masked voxel don't count, a group without any is null."""
    per_item = df.groupBy(*keys, item).agg(F.avg(F.when(mask, error)).alias("own"))
    return per_item.groupBy(*keys).agg(F.count("own").alias("items"), F.avg("own").alias("value"))


def partial_regression(df: DataFrame, keys: list[str], part: str, output: Column, target: Column, mask: Column | None = None) -> DataFrame:
    """keys, part, abs, square, diff, n: what each disjoint part (a patch) of a case adds up to."""
    d = clean((output - target).cast("double"))
    rows = df if mask is None else df.where(mask)
    return rows.groupBy(*keys, part).agg(F.sum(F.abs(d)).alias("abs"), F.sum(d * d).alias("square"), F.sum(d).alias("diff"), F.count(d).alias("n"))


def combine_regression(parts: DataFrame, keys: list[str], data_range: float = 4095.0) -> DataFrame:
    """The report of ``regression_report`` from partial sums: ratios of global sums, never means of ratios."""
    n, square = F.sum("n"), F.sum("square")
    mse = F.when(n > 0, square / n)
    return parts.groupBy(*keys).agg(n.alias("n"), F.when(n > 0, F.sum("abs") / n).alias("mae"), mse.alias("mse"), F.when(n > 0, F.sum("diff") / n).alias("me"), F.sqrt(mse).alias("rmse"), (10 * F.log10(data_range**2 / mse)).alias("psnr"))


def image_masked_mean(df: DataFrame, keys: list[str], output: Column, target: Column, mask: Column, error: Callable[[Column, Column], Column]) -> DataFrame:
    """Mean over all voxels of the error between both images times the mask."""
    return df.groupBy(*keys).agg(F.avg(error(output * mask, target * mask)).alias("value"))


def error_map(df: DataFrame, output: str, target: str, mask: str | None = None, name: str = "error") -> DataFrame:
    """``df`` plus the absolute error of each voxel, of masked images where a mask is given."""
    m = F.lit(1) if mask is None else F.col(mask)
    return df.withColumn(name, F.abs(F.col(output) * m - F.col(target) * m))


def partial_dice(df: DataFrame, keys: list[str], output: str, target: str, mask: str | None = None, labels: list[int] | None = None) -> DataFrame:
    """keys, label, common, in_output, in_target: counts of each label, in one pass.

    A mask turns voxels outside of it to label 0 in both maps first. Without ``labels`` all labels but 0 are counted.
    """
    own, other = (F.col(c) if mask is None else F.when(F.col(mask) == 1, F.col(c)).otherwise(0) for c in (output, target))
    rows = df.select(*keys, own.cast("int").alias("__o"), other.cast("int").alias("__t"))
    seen = F.array_distinct(F.filter(F.array("__o", "__t"), lambda x: x.isNotNull() & (x.isin(*labels) if labels else x != 0)))
    each = rows.withColumn("label", F.explode(seen))
    is_o, is_t = (F.coalesce((F.col(c) == F.col("label")).cast("long"), F.lit(0)) for c in ("__o", "__t"))
    return each.groupBy(*keys, "label").agg(F.sum(is_o * is_t).alias("common"), F.sum(is_o).alias("in_output"), F.sum(is_t).alias("in_target"))


def dice(df: DataFrame, keys: list[str], output: str, target: str, mask: str | None = None, labels: list[int] | None = None) -> DataFrame:
    """Dice coefficient for each label of the target; of given labels those that the target lacks are left out, as they count for nothing in the mean."""
    return combine_dice(partial_dice(df, keys, output, target, mask, labels), keys)


def combine_dice(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients from counts of disjoint parts."""
    summed = parts.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("common", "in_output", "in_target")]).where("in_target > 0")
    return summed.select(*keys, "label", ((2 * F.col("common") + SMOOTH) / (F.col("in_output") + F.col("in_target") + SMOOTH)).alias("dice"))


def dice_loss(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """One less the mean coefficient over the labels."""
    return coefficients.groupBy(*keys).agg((1 - F.avg("dice")).alias("loss"))


def soft_dice(df: DataFrame, keys: list[str], scores: Column, target: Column, labels: list[int]) -> DataFrame:
    """Dice coefficient for each label from a channel of scores a label; ``scores`` is an array by label number."""
    rows = df.select(*keys, scores.alias("__s"), target.alias("__t"), F.explode(F.array(*map(F.lit, labels))).alias("label"))
    p, t = F.get("__s", F.col("label")), (F.col("__t") == F.col("label")).cast("double")
    out = rows.groupBy(*keys, "label").agg(((2 * F.sum(p * t) + SMOOTH) / (F.sum(p) + F.sum(t) + SMOOTH)).alias("dice"), F.sum(t).alias("__n"))
    return out.where("__n > 0").drop("__n")


def disagreement_map(df: DataFrame, output: str, target: str, name: str = "differs") -> DataFrame:
    return df.withColumn(name, (F.col(output) != F.col(target)).cast("int"))


def accuracy(df: DataFrame, keys: list[str], output: Column, target: Column) -> DataFrame:
    """Share of rows whose first greatest channel of the output is the target."""
    found = F.array_position(output, F.array_max(output)) - 1
    return df.groupBy(*keys).agg(F.avg((found == target).cast("double")).alias("accuracy"))


def log_softmax(logits: Column) -> Column:
    """Each logit less the logarithm of the sum of all exponentials."""

    def of(x: Column) -> Column:
        top = F.array_max(x)
        return let(let(top, lambda m: F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m))) + m), lambda norm: F.transform(x, lambda v: v - norm))

    return let(logits, of)


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.get(log_softmax(logits), label)


def focal(logits: Column, label: Column, alpha: list[float], gamma: float) -> Column:
    """-a[t] * (1 - p_t)**gamma * log p_t, with the weights scaled to sum to their number."""
    weights = F.array(*[F.lit(a / sum(alpha) * len(alpha)) for a in alpha])
    logp = F.get(log_softmax(logits), label)
    return -F.get(weights, label) * F.pow(1 - F.exp(logp), F.lit(gamma)) * logp


def kl_divergence(df: DataFrame, keys: list[str], p: Column, q: Column) -> DataFrame:
    """Sum of p * log(p / q) of each group's distributions; terms with p = 0 are 0."""
    return df.groupBy(*keys).agg(F.sum(F.when(p > 0, p * F.log(p / q)).otherwise(0.0)).alias("kl"))


def gram(voxels: DataFrame, case: str, vector: str) -> DataFrame:
    """case, a, b, gram: channel products a <= b, mean over coordinates. ``vector`` holds a coordinate's channels; no join."""
    v = F.col(vector)
    pairs = F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda y, j: F.struct(i.alias("a"), (i + j).alias("b"), (x * y).alias("p")))))
    return voxels.select(case, F.inline(pairs)).groupBy(case, "a", "b").agg(F.avg("p").alias("gram"))


def registration_error(moved: DataFrame, fixed: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Mean and greatest distance between landmarks of the same index."""
    joined = moved.alias("m").join(fixed.alias("f"), [*keys, "idx"])
    distance = F.sqrt(sum(((F.col(f"m.{c}") - F.col(f"f.{c}")) ** 2 for c in axes), F.lit(0.0)))
    return joined.groupBy(*keys).agg(F.avg(distance).alias("tre"), F.max(distance).alias("worst"))


#: Groups that a worker sums up at once, parts that a group's tasks are dealt to before they meet, values weighed at once.
HELD, SALTS, WEIGHED = 256, 64, 1 << 20


def _bin_weights(values: np.ndarray, bins: int) -> np.ndarray:
    """Each value's shares in soft Gaussian bins over [0, 1]."""
    width = 0.5 / (bins - 1)
    w = np.exp(-((np.clip(values, 0, 1)[:, None] - np.linspace(0, 1, bins)) ** 2) / (2 * width * width))
    return w / w.sum(1, keepdims=True)


def _joint_sum(a: np.ndarray, b: np.ndarray, bins: int) -> np.ndarray:
    """Sums, over the voxels of two arrays, of the products of their bin weights."""
    step = max(1, WEIGHED // bins)
    return sum((_bin_weights(a[i : i + step], bins).T @ _bin_weights(b[i : i + step], bins) for i in range(0, len(a), step)), np.zeros((bins, bins)))


def mutual_information(blocks: DataFrame, keys: list[str], a: str, b: str, bins: int = 23) -> DataFrame:
    """keys, n, mutual_information of two intensities in [0, 1], with soft Gaussian bins; the loss is its negative.

    ``a`` and ``b`` are arrays of the same voxels, without nulls: a whole volume in a row, or any of its blocks; rows with a null array don't
    count. A block costs one matrix product. Workers add up the blocks of a group that they meet, so a task sends bins * bins sums for
    each group it holds; a group's sums meet in SALTS parts first, then in one.
    """
    kinds = [blocks.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("__n", T.LongType()), T.StructField("__t", T.ArrayType(T.DoubleType()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types: list = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in held.values()], pa.int64()), kernels.list_column([t for _, t in held.values()])], names=schema.names)

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            names = zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True) if keys else [()] * batch.num_rows
            for key, x, y in zip(names, kernels.rows_of(batch.column(len(keys))), kernels.rows_of(batch.column(len(keys) + 1)), strict=True):
                if x is None or y is None or not len(x):
                    continue
                own = held.setdefault(key, [0, np.zeros((bins, bins))])
                own[0] += len(x)
                own[1] += _joint_sum(x, y, bins)
                if len(held) > HELD:
                    yield flushed()
                    held = {}
        if held:
            yield flushed()

    def met(parts: pa.Table) -> tuple[int, np.ndarray]:
        return sum(parts["__n"].to_pylist()), kernels.matrix_of(parts["__t"].combine_chunks(), bins * bins)[0].sum(0)

    def part(parts: pa.Table) -> pa.Table:
        n, t = met(parts)
        return pa.table([*[parts[k].slice(0, 1) for k in keys], pa.array([n], pa.int64()), kernels.list_column([t])], names=schema.names)

    def information(parts: pa.Table) -> pa.Table:
        n, t = met(parts)
        p = t.reshape(bins, bins) / n
        value = (p * np.log((p + 1e-7) / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True) + 1e-7) + 1e-7)).sum()
        return pa.table([*[parts[k].slice(0, 1) for k in keys], pa.array([n], pa.int64()), pa.array([value])], names=[*keys, "n", "mutual_information"])

    summed = blocks.select(*keys, F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).mapInArrow(sums, schema)
    salted = summed.withColumn("__salt", F.spark_partition_id() % SALTS).groupBy(*keys, "__salt").applyInArrow(part, schema)
    return salted.groupBy(*keys).applyInArrow(information, T.StructType([*kinds, T.StructField("n", T.LongType()), T.StructField("mutual_information", T.DoubleType())]))


def features_of(features: Callable[[np.ndarray], np.ndarray], image: Column) -> Column:
    """Features of each row's array by any function of a batch of arrays (a network, say): an array column. Rows of a batch are of one length."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_pylist()
            out = features(np.array(rows, float)) if rows else []
            yield pa.array([list(map(float, r)) for r in out], pa.list_(pa.float64()))

    return run(image)


def feature_distance(a: Column, b: Column, squared: bool = False) -> Column:
    """Mean absolute (or squared) difference of two feature arrays."""
    return average(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) if squared else F.abs(x - y)))


def principal_axes(rows: DataFrame, vector: str, k: int) -> tuple[list[float], list[list[float]]]:
    """Mean and the k first eigenvectors of the covariance of a column of vectors. Sums go by the square of the vectors' length, which the driver holds."""
    mean, covariance, _ = moments(rows, vector)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order].T
    # A vector's sign is free: its greatest part is positive.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean.tolist(), axes.tolist()


def project(vector: Column, mean: list[float], axes: list[list[float]]) -> Column:
    centred = F.zip_with(vector, F.array(*map(F.lit, mean)), lambda v, m: v - m)
    return F.array(*[total(F.zip_with(centred, F.array(*map(F.lit, axis)), lambda v, x: v * x)) for axis in axes])


def moments(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number of a column of vectors: sums and products by position, added up where the rows lie."""
    v = F.col(vector)
    held = rows.where(v.isNotNull())
    sums = held.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    mean, n = np.array([r["m"] for r in sums]), held.count()
    centre = F.zip_with(v, F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    pairs = F.flatten(F.transform("__c", lambda x, i: F.transform(F.slice("__c", i + 1, F.size("__c")), lambda y, j: F.struct(i.alias("i"), (i + j).alias("j"), (x * y).alias("p")))))
    out = np.zeros((len(mean), len(mean)))
    for r in held.select(centre.alias("__c")).select(F.inline(pairs)).groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["p"] / max(n - 1, 1)
    return mean, out, n


def frechet_distance(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Squared distance of the means, plus traces of both covariances less twice that of the root of their product."""
    (ma, ca, _), (mb, cb, _) = moments(a, vector), moments(b, vector)
    values, vectors = np.linalg.eigh(ca)
    root = vectors @ np.diag(np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cb @ root), 0, None)).sum()
    return float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * cross)


def weighted_cross_entropy(df: DataFrame, keys: list[str], logits: Column, label: Column, weights: list[float]) -> DataFrame:
    """Mean of the rows' losses by the weights of their labels."""
    w = F.get(F.array(*map(F.lit, weights)), label)
    return df.groupBy(*keys).agg((F.sum(w * cross_entropy(logits, label)) / F.sum(w)).alias("loss"))


def mean_variance(df: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """Mean, over rows, of the sample variance of a row's array."""
    return df.groupBy(*keys).agg(F.avg(sample_variance(vector)).alias("variance"))
