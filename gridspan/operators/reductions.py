"""Reductions over ensemble members or augmented copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.avg(value).alias(value))


def lower_median(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of an even number the lower middle one."""
    return members.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias(value))


def concat(members: DataFrame, keys: list[str], member: str, value: str) -> DataFrame:
    """Members as channels, in their order."""
    return members.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(member, value))), lambda s: s[value]).alias(value))


def variance(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sample variance over the members; 0 for a single one."""
    return members.groupBy(*keys).agg(F.when(F.count(value) > 0, F.coalesce(F.var_samp(value), F.lit(0.0))).alias("variance"))


def deviation(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sample deviation over the members; 0 for a single one."""
    return members.groupBy(*keys).agg(F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("deviation"))


def disagreement(members: DataFrame, keys: list[str], label: str, ignore_background: bool = False) -> DataFrame:
    """One minus the share of the most frequent label; without valid votes, or with one member, 0. The background's votes can be left out."""
    valid = F.when(F.col(label) != 0, 1).otherwise(0) if ignore_background else F.lit(1)
    votes = members.groupBy(*keys, label).agg(F.count("*").alias("__all"), F.sum(valid).alias("__n"))
    return votes.groupBy(*keys).agg(F.when((F.sum("__all") > 1) & (F.sum("__n") > 0), 1 - F.max("__n") / F.sum("__n")).otherwise(0.0).alias("disagreement"))


def merge_labels(members: DataFrame, keys: list[str], member: str, label: str, classes: dict[int, int]) -> DataFrame:
    """Members' label maps as one: each member's labels raised past the foreground of those before it; of several that claim a voxel the last wins.

    ``classes`` gives each member's number of classes, background included, in the members' order. Of one member's several rows at
    a voxel the greatest label counts; 0 where none has a label.
    """
    raised, offset = {}, 0
    for m in sorted(classes):
        raised[m], offset = offset, offset + classes[m] - 1
    own = F.col(label) + F.element_at(F.create_map(*[F.lit(x) for pair in raised.items() for x in pair]), F.col(member))
    claim = F.max(F.when(F.col(label) != 0, F.struct(F.col(member).alias("m"), own.alias("l"))))
    return members.groupBy(*keys).agg(F.coalesce(claim["l"], F.lit(0)).alias(label))


def split_members(channels: DataFrame, channel: str, counts: list[int]) -> DataFrame:
    """``channels`` of members one after another, with member and the channel's place in it: a lookup among a few literals."""
    ends = [sum(counts[: k + 1]) for k in range(len(counts))]
    member = sum(((F.col(channel) >= e).cast("int") for e in ends[:-1]), F.lit(0))
    starts = F.array(*map(F.lit, [0, *ends[:-1]]))
    return channels.withColumn("member", member).withColumn(channel, F.col(channel) - F.get(starts, F.col("member")))


def nested(members: DataFrame, keys: list[str], outer: str, value: str, inner: str = "mean", over: str = "mean") -> DataFrame:
    """Reduced over the members of each ``outer`` (a copy), then over those: mean or median at each level."""
    kinds = {"mean": mean, "median": lower_median}
    return kinds[over](kinds[inner](members, [*keys, outer], value), keys, value)


def inference_stack(members: DataFrame, keys: list[str], member: str, value: str, mode: str = "mean") -> DataFrame:
    """keys, stack (members' values in order) and their mean or lower median."""
    stacked = F.transform(F.array_sort(F.collect_list(F.struct(member, value))), lambda s: s[value])
    rows = members.groupBy(*keys).agg(stacked.alias("stack"))
    held = F.array_sort("stack")
    middle = F.get(held, F.floor((F.size(held) - 1) / 2).cast("int"))
    average = F.aggregate("stack", F.lit(0.0), lambda a, v: a + v) / F.size("stack")
    return rows.withColumn(value, average if mode == "mean" else middle)


def uncertainty(fields: DataFrame, keys: list[str], member: str, components: list[str]) -> DataFrame:
    """Spread of members' displacement lengths at each voxel: the sample deviation, 0 for one member."""
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in components), F.lit(0.0)))
    return deviation(fields.select(*keys, member, length.alias("__length")), keys, "__length").withColumnRenamed("deviation", "uncertainty")


def average_displacement(fields: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    return fields.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in components])
