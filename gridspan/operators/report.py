"""Statistics, profiles, leaderboards, run comparisons and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspan.functions.arrays import average, let, quantile, sample_variance
from gridspan.functions.arrays import clean as array_clean

from .metrics import clean
from .ordering import quantiles


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """max, min, std (population), quartiles by linear interpolation, mean and count; NaN is skipped, a group of NaN alone has nulls and count 0.

    Quartiles are exact and come from ranges of sorted values, so a group may be of any size. Null keys are a group.
    """
    v = clean(F.col(value).cast("double"))
    sums = df.groupBy(*keys).agg(F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"), F.avg(v).alias("mean"), F.count(v).alias("count"))
    quarters = quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).select(*[F.col(k).alias(f"__q_{k}") for k in keys], "q25", "q50", "q75")
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
    return sums.join(quarters, meet, "left").select(*keys, "max", "min", "std", "q25", "q50", "q75", "mean", "count")


def case_statistics(volumes: DataFrame, keys: list[str], values: str) -> DataFrame:
    """keys and min, max, mean, std (population), p25, p50, p75, count of each row's own array, NaN skipped: no shuffle."""
    v = array_clean(F.col(values))
    std = let(v, lambda x: F.sqrt(sample_variance(x) * (F.size(x) - 1) / F.size(x)))
    return volumes.select(*keys, F.array_min(v).alias("min"), F.array_max(v).alias("max"), average(v).alias("mean"), F.when(F.size(v) == 1, 0.0).otherwise(std).alias("std"), *[quantile(F.col(values), q).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))], F.size(v).cast("long").alias("count"))


def element_statistics(cases: DataFrame, keys: list[str], values: str) -> DataFrame:
    """keys, position, max, min, std (population), mean over cases of each element of an array column, as of shapes and spacings."""
    long = cases.select(*keys, F.posexplode(values).alias("position", "__v"))
    v = clean(F.col("__v").cast("double"))
    return long.groupBy(*keys, "position").agg(F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"), F.avg(v).alias("mean"))


def label_presence(df: DataFrame, case: str, label: str, most: int = 512) -> DataFrame:
    """label, cases, mean_share: in how many cases a label occurs and its mean share of their voxels, over cases with labels.

    A table of more than ``most`` labels is an intensity and has no profile: no rows.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(case, label).agg(F.count("*").alias("__n"))
    sizes = df.groupBy(F.col(case).alias("__case")).agg(F.count("*").alias("__all"))
    shares = counts.join(sizes, F.col(case).eqNullSafe(F.col("__case")))
    out = shares.groupBy(label).agg(F.count("*").alias("cases"), F.avg(F.col("__n") / F.col("__all")).alias("mean_share"))
    return out.crossJoin(F.broadcast(out.agg(F.count("*").alias("__labels")))).where(F.col("__labels") <= most).drop("__labels")


def with_components(values: DataFrame, keys: list[str], base: str, component: str, value: str) -> DataFrame:
    """keys, metric, value: each component as base:component, and their mean, NaN skipped, under the base."""
    named = values.select(*keys, F.concat_ws(":", base, component).alias("metric"), F.col(value).alias("value"))
    means = values.groupBy(*keys, F.col(base).alias("metric")).agg(F.avg(clean(F.col(value))).alias("value"))
    return named.unionByName(means)


def latest(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row written last, of ties the greatest."""
    row = F.struct(order, *[c for c in values.columns if c != order])
    return values.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.max(row).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in values.columns])


def top_level(keys: DataFrame, key: str) -> DataFrame:
    """Without component keys: those whose part before the last colon is itself a key."""
    parents = keys.select(F.col(key).alias("__parent")).distinct()
    head = F.regexp_replace(key, r":[^:]*$", "")
    return keys.join(parents, (head == F.col("__parent")) & (head != F.col(key)), "left_anti")


#: Parts of metric names that say which way is better; loss counts before all others.
MAXIMISED = ("dice", "iou", "accuracy", "acc", "auc", "f1", "ssim", "psnr")
MINIMISED = ("mae", "mse", "rmse", "loss", "hausdorff", "hd")


def direction(metric: Column, declared: Column | None = None) -> Column:
    """struct(direction, source): as declared, or by the name, or min by default."""
    name = F.lower(metric)
    has = lambda words: F.coalesce(name.rlike("|".join(words)), F.lit(False))
    both = lambda d, s: F.struct(F.lit(d).alias("direction"), F.lit(s).alias("source"))
    guessed = F.when(F.contains(name, F.lit("loss")), both("min", "heuristic:min")).when(has(MAXIMISED), both("max", "heuristic:max")).when(has(MINIMISED), both("min", "heuristic:min")).otherwise(both("min", "default:min"))
    if declared is None:
        return guessed
    return F.when(declared.isin("min", "max"), F.struct(declared.alias("direction"), F.lit("declared").alias("source"))).otherwise(guessed)


def scoreboard(scores: DataFrame, metric: str, run: str, value: str, newest: str, top: int = 20, declared: str | None = None) -> DataFrame:
    """The best runs of each metric by its own direction, ties newest first, then by name; with direction and place."""
    known = scores.withColumn("direction", direction(F.col(metric), F.col(declared) if declared else None)["direction"]).where(clean(F.col(value)).isNotNull())
    signed = F.when(F.col("direction") == "max", -F.col(value)).otherwise(F.col(value))
    place = F.row_number().over(Window.partitionBy(metric).orderBy("__signed", F.desc(newest), run))
    return known.withColumn("__signed", signed).withColumn("place", place).where(F.col("place") <= top).drop("__signed")


def matching(metrics: DataFrame, metric: str, wanted: str) -> DataFrame:
    """Metrics of a name or of a last part of it after a colon."""
    return metrics.where((F.col(metric) == wanted) | F.col(metric).endswith(":" + wanted))


def splits(files: DataFrame, path: str) -> DataFrame:
    """Distinct splits that metric files name: Metric_<split>.json."""
    return files.select(F.regexp_extract(path, r"Metric_([^/]*)\.json$", 1).alias("split")).where("split <> ''").distinct()


def newest_files(files: DataFrame, path: str, modified: str, split: str) -> DataFrame:
    return files.where(F.col(path).endswith(f"/Metric_{split}.json")).orderBy(F.desc(modified), path)


def common_prefix(metrics: DataFrame, metric: str) -> DataFrame:
    """The longest common prefix of all names, without a colon at its end: that of the least and the greatest name."""
    ends = metrics.agg(F.min(metric).alias("a"), F.max(metric).alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("a"), F.length("b"))), lambda n: F.substring("a", F.lit(1), n) == F.substring("b", F.lit(1), n))
    return ends.select(F.rtrim(F.substring("a", F.lit(1), F.array_max(same)), F.lit(":")).alias("prefix"))


def filtered_tags(points: DataFrame, tag: str, wanted: list[str]) -> DataFrame:
    """Points whose tag holds one of the wanted strings; all for none wanted."""
    out = F.lit(not wanted)
    for w in wanted:
        out = out | F.contains(F.col(tag), F.lit(w))
    return points.where(out)


def latest_per_stage(lines: DataFrame, stage: str, order: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest row of each stage, and the last ``most`` rows of all."""
    return latest(lines, [stage], order), lines.orderBy(F.desc(order)).limit(most)


def config_differences(a: DataFrame, b: DataFrame, path: str, value: str) -> DataFrame:
    """path, a, b of each setting that differs or that one side lacks."""
    left, right = a.select(path, F.col(value).alias("a")), b.select(path, F.col(value).alias("b"))
    return left.join(right, path, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def flattened(config: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value) of every leaf of a nested configuration, in order."""
    out = []
    for k, v in config.items():
        out += flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", str(v))]
    return out


def run_record(runs: DataFrame, metrics: DataFrame, logs: DataFrame, run: str, metric: str, value: str, line: str, text: str, tail: int = 100) -> DataFrame:
    """run, metrics (a map) and log_tail (the last lines in order) of each run; runs without either have empty ones."""
    scores = metrics.groupBy(F.col(run).alias("__m")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(metric, value)))).alias("metrics"))
    last = Window.partitionBy(run).orderBy(F.desc(line))
    lines = logs.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= tail)
    lines = lines.groupBy(F.col(run).alias("__l")).agg(F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: x[text]).alias("log_tail"))
    out = runs.select(run).distinct().join(scores, F.col(run) == F.col("__m"), "left").join(lines, F.col(run) == F.col("__l"), "left").drop("__m", "__l")
    kind = dict(metrics.dtypes)
    return out.withColumns({"metrics": F.coalesce("metrics", F.create_map().cast(f"map<{kind[metric]},{kind[value]}>")), "log_tail": F.coalesce("log_tail", F.array().cast("array<string>"))})


def preview(voxels: DataFrame, keys: list[str], axis: str, index: int | None, value: str, others: list[str]) -> DataFrame:
    """One plane of each volume, or the greatest value along the axis for no index, scaled to [0, 1]."""
    plane = voxels.where(F.col(axis) == index).select(*keys, *others, value) if index is not None else voxels.groupBy(*keys, *others).agg(F.max(value).alias(value))
    ends = plane.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    scaled = F.when(F.col("__b") > F.col("__a"), (F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a"))).otherwise(0.0)
    return plane.join(ends, meet).withColumn(value, scaled).select(*keys, *others, value)


def error_excerpt(lines: DataFrame, run: str, line: str, text: str) -> DataFrame:
    """run, error: from the last line that begins an exception's report to the end of the log, or null."""
    head = F.col(text).rlike(r"^(Traceback \(most recent call last\)|[A-Za-z_.]*(Error|Exception)\b.*)")
    starts = lines.where(F.col(text).startswith("Traceback") | head).groupBy(F.col(run).alias("__r")).agg(F.coalesce(F.max(F.when(F.col(text).startswith("Traceback"), F.col(line))), F.max(line)).alias("__from"))
    body = lines.join(starts, (F.col(run) == F.col("__r")) & (F.col(line) >= F.col("__from")))
    return body.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: x[text]), "\n").alias("error"))


def volume_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, mean and sample standard deviation of a stored volume; of a single voxel the deviation is 0."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))


def label_profile(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Voxels of each label and their share of the group."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def leaderboard(runs: DataFrame, metric: str, run: str, value: str, top: int, descending: bool = True) -> DataFrame:
    """The best runs of each metric, ties by name."""
    order = F.desc(value) if descending else F.asc(value)
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(metric).orderBy(order, run))).where(F.col("place") <= top)


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str, maximise: bool) -> DataFrame:
    """On common cases: mean difference, wins of each run, winner. Missing values are left out; equal ones count for neither."""
    d = F.col("b.v") - F.col("a.v")
    left, right = a.select(*keys, F.col(value).alias("v")).alias("a"), b.select(*keys, F.col(value).alias("v")).alias("b")
    better = d > 0 if maximise else d < 0
    worse = d < 0 if maximise else d > 0
    counted = left.join(right, keys).where(d.isNotNull()).agg(F.count("*").alias("cases"), F.avg(d).alias("delta"), F.count(F.when(better, 1)).alias("better_b"), F.count(F.when(worse, 1)).alias("better_a"))
    return counted.withColumn("winner", F.when(F.col("better_b") > F.col("better_a"), "b").when(F.col("better_a") > F.col("better_b"), "a").otherwise("tie"))


def curve(points: DataFrame, run: str, step: str, most: int) -> DataFrame:
    """At most about ``most`` points of each run, at an even stride; the last one always."""
    own = Window.partitionBy(run)
    numbered = points.withColumns({"__n": F.row_number().over(own.orderBy(step)) - 1, "__all": F.count("*").over(own)})
    stride = F.greatest(F.ceil(F.col("__all") / most), F.lit(1))
    return numbered.where((F.col("__n") % stride == 0) | (F.col("__n") == F.col("__all") - 1)).drop("__n", "__all")


def best_checkpoint(points: DataFrame, run: str, step: str, value: str, maximise: bool) -> DataFrame:
    """The step with the best value of each run, the earliest of ties; NaN and null are never the best."""
    rows = points.where(clean(F.col(value).cast("double")).isNotNull())
    row = F.struct(*points.columns)
    order = F.struct((-F.col(value) if maximise else F.col(value)).alias("v"), step)
    return rows.groupBy(F.col(run).alias("__run")).agg(F.min_by(row, order).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in points.columns])


def report_json(statistics_rows: DataFrame, metric: str) -> DataFrame:
    """One JSON object per metric; what JSON can't say is null."""
    columns = [c for c in statistics_rows.columns if c != metric]
    safe = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if dict(statistics_rows.dtypes)[c] == "double" else F.col(c) for c in columns]
    return statistics_rows.select(metric, F.to_json(F.struct(*safe)).alias("report"))
