"""Event-time windows; the same expressions serve batch and Structured Streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summed(grouped, value: str) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def tumbling(events: DataFrame, time: str, keys: list[str], value: str, width: str) -> DataFrame:
    return _summed(events.groupBy(*keys, F.window(time, width).alias("w")), value).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str) -> DataFrame:
    return _summed(events.groupBy(*keys, F.window(time, width, slide).alias("w")), value).select(*keys, F.col("w.start").alias("start"), "n", "total")


def session(events: DataFrame, time: str, keys: list[str], value: str, gap: str) -> DataFrame:
    """A session ends where no event follows within the gap."""
    return _summed(events.groupBy(*keys, F.session_window(time, gap).alias("w")), value).select(*keys, F.col("w.start").alias("start"), "n", "total")


def late_safe(events: DataFrame, time: str, lateness: str) -> DataFrame:
    """A stream whose state is dropped once events are ``lateness`` behind the newest; later ones are left out of windows."""
    return events.withWatermark(time, lateness)


def once(events: DataFrame, time: str, lateness: str, keys: list[str]) -> DataFrame:
    """Events without repeats of their keys within the lateness."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def newest(entries: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """The values of each key's newest entry: state is one row a key. Ties take the greatest values."""
    row = F.struct(time, *values)
    return entries.groupBy(*keys).agg(F.max(row).alias("__row")).select(*keys, F.col(f"__row.{time}").alias(time), *[F.col(f"__row.{v}").alias(v) for v in values])
