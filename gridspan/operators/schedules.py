"""Weights and learning rates by step, and rules that stop a run: expressions of a step column, folds over a run's ordered scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions.arrays import running


def constant(step: Column, value: float = 1.0) -> Column:
    return F.when(step.isNotNull(), F.lit(value))


def cosine_annealing(step: Column, start: float = 1.0, least: float = 1e-5, steps: int = 100) -> Column:
    return least + (start - least) * (1 + F.cos(step * math.pi / steps)) / 2


def warmup(step: Column, steps: int = 10) -> Column:
    """A factor that rises to 1."""
    return F.least(F.lit(1.0), (step + 1) / (steps + 1))


def polynomial(step: Column, initial: float, steps: int, exponent: float = 0.9) -> Column:
    return initial * F.pow(1 - F.least(step, F.lit(steps)) / steps, F.lit(exponent))


def cosine_betas(n: int, s: float = 0.008) -> list[float]:
    """Noise rates whose cumulative product falls as a squared cosine, held within [0.0001, 0.9999]."""
    level = [math.cos((i / n + s) / (1 + s) * math.pi / 2) ** 2 for i in range(n + 1)]
    return [min(max(1 - level[i + 1] / level[i], 0.0001), 0.9999) for i in range(n)]


def signal_levels(n: int = 1000, first: float = 1e-4, last: float = 0.02) -> list[float]:
    """The signal's share after 0 to n steps of noise at linearly rising rates, scaled so that nothing is left after the last."""
    level, held = 1.0, []
    for i in range(n):
        level *= 1 - (first + (last - first) * i / (n - 1))
        held.append(math.sqrt(level))
    scale = held[0] / (held[0] - held[-1])
    return [1.0, *(((h - held[-1]) * scale) ** 2 for h in held)]


def running_best(scores: Column, maximise: bool) -> Column:
    """The best of the scores before each one; null before the first."""
    worst = F.lit(None).cast("double")
    pick = F.greatest if maximise else F.least
    return running(scores, worst, lambda a, b: pick(a, b))


def early_stop(log: DataFrame, run: str, step: str, score: str, patience: int = 10, least_gain: float = 0.0, maximise: bool = False) -> DataFrame:
    """run, best, stop_step: the step at which ``patience`` scores in a row have not bettered the best by more than ``least_gain``; null if none.

    A fold over a run's scores in order; NaN and null scores better nothing. A run's log is one array.
    """
    ordered = log.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col(score).cast("double").alias("score")))).alias("__s"))
    sign = 1.0 if maximise else -1.0
    state = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(None).cast(dict(log.dtypes)[step]).alias("stop"))

    def after(a: Column, x: Column) -> Column:
        better = x["score"].isNotNull() & ~F.isnan(x["score"]) & (a["best"].isNull() | (sign * (x["score"] - a["best"]) > least_gain))
        waited = F.when(better, 0).otherwise(a["waited"] + 1)
        moved = F.struct(F.when(better, x["score"]).otherwise(a["best"]).alias("best"), waited.alias("waited"), F.when(waited >= patience, x["step"]).otherwise(a["stop"]).alias("stop"))
        return F.when(a["stop"].isNotNull(), a).otherwise(moved)

    return ordered.withColumn("__e", F.aggregate("__s", state, after)).select(run, F.col("__e.best").alias("best"), F.col("__e.stop").alias("stop_step"))


def monitored(log: DataFrame, run: str, step: str, key: str, value: str, monitor: list[str]) -> DataFrame:
    """run, step, score: the monitored keys' values added up, where all of them were logged."""
    rows = log.where(F.col(key).isin(*monitor)).groupBy(run, step).agg(F.sum(value).alias("score"), F.count_distinct(key).alias("__n"))
    return rows.where(F.col("__n") == len(set(monitor))).drop("__n")
