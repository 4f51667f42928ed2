"""Global order without a single task: rows are dealt into ranges of a key, and each range knows what lies before it.

The ranges' boundaries come from a seeded sample of fixed size; they decide only how even the tasks are. What a range
adds up to is counted exactly, one small row a range, so ranks and running sums are exact at any size. Rows that agree in the
whole order lie in one range. Quantiles need no order of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sampled keys for each range.
PER_RANGE = 40


def range_of(df: DataFrame, order: str | list[str], ranges: int | None = None) -> Column:
    """The number of the range that a row lies in by the whole order, from 0: a binary search among the cuts. Nulls come first.

    One pass samples the order's columns. Rows that agree in all of them lie in one range, as their places are any.
    """
    columns = [order] if isinstance(order, str) else order
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(*columns).orderBy(F.rand(7)).limit(n * PER_RANGE).orderBy(*columns).collect()
    step = max(1, len(sample) // n)
    cuts = list(dict.fromkeys(tuple(r) for r in sample[step::step]))
    if not cuts:
        return F.lit(0)
    kinds = dict(df.select(*columns).dtypes)
    row = lambda values: F.struct(*[v.cast(kinds[c]).alias(f"c{k}") for k, (c, v) in enumerate(zip(columns, values, strict=True))])
    held = F.array(*[row(map(F.lit, c)) for c in cuts])
    own = row([F.col(c) for c in columns])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    # ``found`` cuts are at or below the row; are ``step`` more?
    def narrowed(found: Column, step: Column) -> Column:
        at = found + step
        return F.when((at <= len(cuts)) & (F.get(held, at - 1) <= own), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), narrowed)


def before(df: DataFrame, keys: list[str], bucket: str, **sums: Column) -> DataFrame:
    """keys, bucket and, for each name, the sum over the earlier ranges of the same keys: a row for each keys and range."""
    counted = df.groupBy(*keys, bucket).agg(*[s.alias(name) for name, s in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*keys, bucket, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums])


def _joined(dealt: DataFrame, small: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    names = [*keys, bucket]
    other = small.select(*[F.col(c).alias(f"__b_{c}") for c in names], *[c for c in small.columns if c not in names])
    meet = F.lit(True)
    for c in names:
        meet = meet & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return dealt.join(other, meet).drop(*[f"__b_{c}" for c in names])


def with_rank(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` plus the place of each row in the order, from 0, within its keys or in all. Ties of the whole order get different places in any order."""
    keys, bucket = keys or [], "__bucket"
    dealt = df.withColumn(bucket, range_of(df, order, ranges))
    small = before(dealt, keys, bucket, __before=F.count("*"))
    own = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = dealt.withColumn("__own", F.row_number().over(own) - 1)
    return _joined(ranked, small, keys, bucket).withColumn(name, F.col("__own") + F.col("__before")).drop(bucket, "__own", "__before")


def with_running_sum(df: DataFrame, order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` plus the sum of a column over all rows up to each one, its own included."""
    bucket = "__bucket"
    dealt = df.withColumn(bucket, range_of(df, order, ranges))
    small = before(dealt, [], bucket, __before=F.sum(value))
    own = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("__own", F.sum(value).over(own))
    return _joined(summed, small, [], bucket).withColumn(name, F.col("__own") + F.col("__before")).drop(bucket, "__own", "__before")


#: Ranges of values that one factor of e is cut into, and more factors than doubles have.
FINE, FACTORS = 2048, 4096


def _value_range(v: Column) -> Column:
    """A number that rises with a double, by its sign and logarithm."""
    size = F.floor(F.greatest(F.least(F.log(F.abs(v)), F.lit(float(FACTORS - 1))), F.lit(float(-FACTORS + 1))) * FINE)
    return F.when(v > 0, size + 2 * FACTORS * FINE).when(v < 0, -size - 2 * FACTORS * FINE).otherwise(0).cast("long")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], names: list[str]) -> DataFrame:
    """keys and exact quantiles by linear interpolation; null and NaN are skipped, groups without a value are left out.

    The input is read once and nothing is sampled: values are counted before the shuffle, so that equal ones are one row; counts of ranges of
    values tell in which of them the wanted ranks lie, and only those ranges' values are sorted. No task holds a group.
    """
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    own = [f"__k{i}" for i in range(len(keys))]
    counted = rows.groupBy(*own, "__v").agg(F.count("*").alias("__c")).withColumn("__r", _value_range(F.col("__v")))
    sums = counted.groupBy(*own, "__r").agg(F.sum("__c").alias("__m"))
    within = Window.partitionBy(*own)
    placed = sums.withColumns({"__before": F.coalesce(F.sum("__m").over(within.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__m").over(within)})
    place = [(F.col("__n") - 1) * F.lit(q) for q in qs]
    ends = [e for p in place for e in (F.floor(p), F.ceil(p))]
    inside = lambda low, n: F.exists(F.array(*ends), lambda e: (e >= low) & (e < low + n))
    wanted = placed.where(inside(F.col("__before"), F.col("__m"))).drop("__m")
    meet = F.col("a.__r") == F.col("b.__r")
    for k in own:
        meet = meet & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    held = counted.alias("a").join(wanted.alias("b"), meet).select("a.*", "b.__before", "b.__n")
    earlier = Window.partitionBy(*own, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("__at", F.col("__before") + F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
    at = lambda e: F.max(F.when((e >= F.col("__at")) & (e < F.col("__at") + F.col("__c")), F.col("__v")))
    out = ranked.groupBy(*own, "__n").agg(*[at(e).alias(f"__e{i}") for i, e in enumerate(ends)])
    share = lambda i, p: F.when(F.col(f"__e{2 * i}") == F.col(f"__e{2 * i + 1}"), F.col(f"__e{2 * i}")).otherwise(F.col(f"__e{2 * i}") + (F.col(f"__e{2 * i + 1}") - F.col(f"__e{2 * i}")) * (p - F.floor(p)))
    return out.select(*[F.col(k).alias(name) for k, name in zip(own, keys, strict=True)], *[share(i, p).alias(n) for i, (p, n) in enumerate(zip(place, names, strict=True))])


def last_of(df: DataFrame, keys: list[str], order: list[str], n: int, block: int = 100_000) -> DataFrame:
    """``df`` plus ``block`` and ``context``, each row once in its own block of a group's order and, among the last n - 1 of it, once more as context of the next.

    A frame of n rows back then lies within (keys, block): long groups are many tasks.
    """
    ranked = with_rank(df, order, keys, "__rank")
    own = F.struct(F.floor(F.col("__rank") / block).alias("block"), F.lit(False).alias("context"))
    following = F.struct((F.floor(F.col("__rank") / block) + 1).alias("block"), F.lit(True).alias("context"))
    near_end = F.col("__rank") % block >= block - (n - 1)
    return ranked.withColumn("__in", F.explode(F.when(near_end, F.array(own, following)).otherwise(F.array(own)))).withColumns({"block": F.col("__in.block"), "context": F.col("__in.context")}).drop("__in")
