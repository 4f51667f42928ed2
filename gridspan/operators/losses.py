"""Training criteria over arrays as expressions and aggregates, and windows over the losses that they log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import last_of


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def bce_with_logits(x: Column, target: float) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def squared_to(x: Column, target: float) -> Column:
    """Squared distance to a constant: of a patch critic, or of a gradient's length to 1."""
    return (x - target) * (x - target)


def distance(a: Column, b: Column, eps: float = 1e-7) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y + eps) * (x - y + eps))))


def triplet(anchor: Column, positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(distance(anchor, positive) - distance(anchor, negative) + margin, F.lit(0.0))


def latent_kl(mean: Column, log_variance: Column) -> Column:
    """Divergence of a diagonal normal distribution from the standard one."""
    return -0.5 * total(F.zip_with(mean, log_variance, lambda m, s: 1 + s - m * m - F.exp(s)))


def gradient_difference(a: Column, b: Column) -> Column:
    """L2 norm, along the one axis, of the difference between forward differences."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(total(F.zip_with(F.slice(d, 2, F.size(d) - 1), F.slice(d, 1, F.size(d) - 1), lambda after, at: (after - at) * (after - at))))


def representation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean absolute difference of two batches of vectors, plus for each the mean lack of unit variance per dimension.

    Partial sums by dimension before the shuffle; a batch of one has no variance and gives null.
    """
    long = df.select(*keys, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("at", "v"))
    per = long.groupBy(*keys, "at").agg(F.avg(F.abs(F.col("v.a") - F.col("v.b"))).alias("l1"), F.var_samp("v.a").alias("va"), F.var_samp("v.b").alias("vb"))
    lack = lambda c: F.avg(F.greatest(1 - F.col(c), F.lit(0.0)))
    return per.groupBy(*keys).agg((F.avg("l1") + lack("va") + lack("vb")).alias("loss"))


def ssim(voxels: DataFrame, case: str, axis: str, a: str, b: str, data_range: float, extent: int, width: int = 7) -> DataFrame:
    """Mean structural similarity per case, over uniform windows along an axis that lie inside it; sample covariances."""
    side = (width - 1) // 2
    w = Window.partitionBy(case).orderBy(axis).rowsBetween(-side, side)
    x, y = F.col(a), F.col(b)
    means = {"mx": F.avg(x).over(w), "my": F.avg(y).over(w), "xx": F.avg(x * x).over(w), "yy": F.avg(y * y).over(w), "xy": F.avg(x * y).over(w)}
    scale, c1, c2 = width / (width - 1), (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    mx, my = F.col("mx"), F.col("my")
    vx, vy, vxy = scale * (F.col("xx") - mx * mx), scale * (F.col("yy") - my * my), scale * (F.col("xy") - mx * my)
    local = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return voxels.withColumns(means).where(F.col(axis).between(side, extent - 1 - side)).groupBy(case).agg(F.avg(local).alias("ssim"))


def last_values(log: DataFrame, keys: list[str], step: str, value: str, n: int) -> DataFrame:
    """Mean of the last n values at each step, NaN skipped; steps with fewer before them are left out.

    A key's log goes in blocks, each with the n - 1 rows before it, so a long log is many tasks. Ties of a step go in any order.
    """
    w = Window.partitionBy(*keys, "block").orderBy("__rank").rowsBetween(1 - n, 0)
    blocks = last_of(log, keys, [step], n)
    seen = blocks.withColumns({"mean": F.avg(F.when(~F.isnan(value), F.col(value))).over(w), "held": F.count("*").over(w)})
    return seen.where((F.col("held") == n) & ~F.col("context")).drop("held", "block", "context", "__rank")


def loss_by_group(log: DataFrame, keys: list[str], group: str, weight: str, value: str) -> DataFrame:
    """Weighted sum of the losses of each group."""
    return log.groupBy(*keys, group).agg(F.sum(F.col(weight) * F.col(value)).alias("loss"))


def formatted_losses(log: DataFrame, keys: list[str], step: str, weight: str, value: str, n: int) -> DataFrame:
    """keys, weight, value: means over the last n steps, where there are as many."""
    w = Window.partitionBy(*keys).orderBy(F.desc(step))
    rows = log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    own = rows.groupBy(*keys).agg(F.avg(weight).alias("weight"), F.avg(F.when(~F.isnan(value), F.col(value))).alias("value"), F.count("*").alias("__c"))
    return own.where(F.col("__c") == n).drop("__c")


def rank_means(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over the ranks of a distributed run."""
    return values.groupBy(*keys).agg(F.avg(value).alias(value))


def scheduler_at(step: Column, schedulers: list[tuple[str, int]]) -> Column:
    """The scheduler whose steps hold ``step``; the last one beyond all."""
    out, end = F.lit(schedulers[-1][0]), sum(n for _, n in schedulers[:-1])
    for name, n in reversed(schedulers[:-1]):
        out = F.when(step < end, F.lit(name)).otherwise(out)
        end -= n
    return out


def compose(first: list[list[float]], second: list[list[float]]) -> list[list[float]]:
    """The affine map (rows of 3 factors and a shift) that applies ``first``, then ``second``."""
    a, b = [*first, [0.0, 0.0, 0.0, 1.0]], [*second, [0.0, 0.0, 0.0, 1.0]]
    return [[sum(b[i][k] * a[k][j] for k in range(4)) for j in range(4)] for i in range(3)]


def move_points(points: DataFrame, axes: list[str], affine: list[list[float]]) -> DataFrame:
    return points.withColumns({c: sum((F.col(p) * f for p, f in zip(axes, row, strict=False)), F.lit(row[3])) for c, row in zip(axes, affine, strict=True)})
