"""Which cases take part: selectors, slices, exclusions, splits, folds, group intersection, source priority, presence.

A catalogue has a row per case and may be very long: ranks and running sums go by ranges of the order (see ``ordering``),
never through a window over all rows. Null case names are no cases and are left out of what ranks them; other columns
keep their names, but for those that start with two underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators import ordering


def ranked(catalog: DataFrame, case: str) -> DataFrame:
    """Distinct cases with their place in sorted order, from 0."""
    return ordering.with_rank(catalog.where(F.col(case).isNotNull()).select(case).distinct(), [case])


def subset_slice(catalog: DataFrame, case: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Cases at ranks start, start + step, ... before stop."""
    return ranked(catalog, case).where((F.col("rank") >= start) & (F.col("rank") < stop) & ((F.col("rank") - start) % step == 0)).select(case)


@dataclass(frozen=True)
class Selector:
    """One selector: a place, a slice ``a:b``, a name, a file of names, or with ``~`` the exclusion of a name or a file."""

    text: str | int

    @property
    def excludes(self) -> bool:
        return isinstance(self.text, str) and self.text.startswith("~")

    @property
    def slice(self) -> tuple[int, int] | None:
        if isinstance(self.text, int):
            return self.text, self.text + 1
        first, colon, last = self.text.partition(":")
        return (int(first), int(last)) if colon and first.lstrip("-").isdigit() and last.lstrip("-").isdigit() else None


def names_in(spark: SparkSession, path: str, case: str) -> DataFrame:
    """The names of a text file, one a line; blank lines are none."""
    lines = spark.read.text(path).select(F.trim("value").alias(case))
    return lines.where(F.col(case) != "").distinct()


def select_cases(catalog: DataFrame, case: str, selectors: list[str | int] | str | int | None, files: dict[str, DataFrame] | None = None) -> DataFrame:
    """Distinct cases that selectors choose: the union of the including ones, or all where none includes, less the excluded ones.

    ``files`` maps a selector's text to the cases that it lists. Slices are cut to the number of cases; places and names
    that do not exist choose nothing; an empty list chooses nothing, None all.
    """
    if selectors is None:
        return ranked(catalog, case).select(case)
    chosen = [Selector(s) for s in (selectors if isinstance(selectors, list) else [selectors])]
    files = files or {}
    rows = ranked(catalog, case)

    def meets(s: Selector) -> Column | None:
        if not s.excludes and s.slice is not None and s.text not in files:
            return (F.col("rank") >= max(s.slice[0], 0)) & (F.col("rank") < s.slice[1])
        name = s.text[1:] if s.excludes else s.text
        return F.col(case).cast("string") == F.lit(name) if name not in files else None

    def listed(group: list[Selector]) -> tuple[Column, list[DataFrame]]:
        here, tables = F.lit(False), []
        for s in group:
            condition = meets(s)
            if condition is None:
                tables.append(files[s.text[1:] if s.excludes else s.text])
            else:
                here = here | condition
        return here, tables

    def flagged(df: DataFrame, flag: str, group: list[Selector]) -> DataFrame:
        here, tables = listed(group)
        out = df.withColumn(flag, here)
        for k, t in enumerate(tables):
            mark = t.select(F.col(t.columns[0]).alias("__name")).distinct().withColumn("__in", F.lit(True))
            out = out.join(mark, F.col(case) == F.col("__name"), "left").withColumn(flag, F.col(flag) | F.coalesce("__in", F.lit(False))).drop("__name", "__in")
        return out

    if not chosen:
        return rows.select(case).limit(0)
    including = [s for s in chosen if not s.excludes]
    out = flagged(rows, "__take", including) if including else rows.withColumn("__take", F.lit(True))
    out = flagged(out, "__leave", [s for s in chosen if s.excludes])
    return out.where(F.col("__take") & ~F.col("__leave")).select(case)


def subset_list(catalog: DataFrame, listed: DataFrame, case: str) -> DataFrame:
    return catalog.join(listed.select(case).distinct(), case, "left_semi")


def subset_exclude(catalog: DataFrame, listed: DataFrame, case: str) -> DataFrame:
    return catalog.join(listed.select(case).distinct(), case, "left_anti")


def validation_split(weighted: DataFrame, case: str, weight: str, fraction: float) -> DataFrame:
    """validation is true from the first case whose cumulative weight exceeds floor(total * (1 - fraction))."""
    total = weighted.agg(F.floor(F.sum(weight) * (1 - fraction)).alias("threshold"))
    running = ordering.with_running_sum(weighted.select(case, weight), [case], weight, "running")
    return running.crossJoin(F.broadcast(total)).select(case, weight, "running", (F.col("running") > F.col("threshold")).alias("validation"))


def entry_counts(patches: DataFrame, case: str, copies: int) -> DataFrame:
    """entries of each case: its patches, once for the case itself and once for each copy."""
    return patches.groupBy(case).agg((F.count("*") * (1 + copies)).alias("entries"))


def split_names(subset: DataFrame, validation: DataFrame, case: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation cases: what validation names of the subset, and the rest."""
    names = validation.select(case).distinct()
    return subset.join(names, case, "left_anti"), subset.join(names, case, "left_semi")


def draw(key: Column, seed: int = 0) -> Column:
    """A number in [0, 2**31) from a key by integer arithmetic that any SQL dialect has."""
    return F.pmod(F.pmod(key.cast("long") + seed * 7919, F.lit(2147483648)) * 1103515245 + 12345, F.lit(2147483648))


def shuffled(catalog: DataFrame, case: str, seed: int = 0, name: str = "place") -> DataFrame:
    """Distinct cases with their place in a drawn order. ``case`` is a number; text goes by its hash."""
    rows = catalog.where(F.col(case).isNotNull()).select(case).distinct()
    key = F.col(case) if dict(rows.dtypes)[case] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64(case)
    return ordering.with_rank(rows.withColumn("__draw", draw(key, seed)), ["__draw", case], name=name).drop("__draw")


def kfold(catalog: DataFrame, case: str, folds: int, seed: int = 0) -> DataFrame:
    """fold: cases in drawn order, dealt in turn."""
    if folds < 2:
        raise ValueError("two folds at least")
    return shuffled(catalog, case, seed).select(case, (F.col("place") % folds).cast("int").alias("fold"))


def sample_cases(catalog: DataFrame, case: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` cases, those drawn first."""
    return shuffled(catalog, case, seed).where(F.col("place") < most).select(case)


def windowed_order(entries: DataFrame, case: str, entry: str, window: int, seed: int = 0) -> DataFrame:
    """``entries`` plus place: cases in drawn order, ``window`` of them at a time, and the entries of a window in drawn order."""
    cases = shuffled(entries, case, seed, "__place").select(F.col(case).alias("__case"), F.floor(F.col("__place") / window).alias("__window"))
    rows = entries.join(cases, F.col(case) == F.col("__case")).drop("__case").withColumn("__key", F.col("__window") * (1 << 31) + draw(F.col(case) * 65537 + F.col(entry), seed + 1))
    return ordering.with_rank(rows, ["__key", case, entry], name="place").drop("__window", "__key")


def dealt(weighted: DataFrame, case: str, weight: str, workers: int) -> DataFrame:
    """worker of each case: whole cases by falling weight, dealt back and forth so that loads stay close. No fold over all cases."""
    order = ordering.with_rank(weighted.withColumn("__w", -F.col(weight)), ["__w", case], name="__place")
    lap, at = F.floor(F.col("__place") / workers), F.col("__place") % workers
    return order.select(case, weight, F.when(lap % 2 == 0, at).otherwise(workers - 1 - at).cast("int").alias("worker"))


def shards(mapping: DataFrame, order: list[str], world: int) -> DataFrame:
    """``mapping`` plus shard and padding: ranges of equal length of the order, short ones filled with their own first rows, an empty one with those of the mapping."""
    rows = ordering.with_rank(mapping, order, name="__place")
    size = mapping.count()
    ends = [(size * r // world, size * (r + 1) // world) for r in range(world)]
    most = max((b - a for a, b in ends), default=0)
    homes = []
    for r, (a, b) in enumerate(ends):
        own = (F.col("__place") >= a) & (F.col("__place") < b)
        homes.append(F.when(own, F.struct(F.lit(r).alias("shard"), F.lit(False).alias("padding"))))
        if b - a < most:
            head = a if b > a else 0
            homes.append(F.when((F.col("__place") >= head) & (F.col("__place") < head + most - (b - a)), F.struct(F.lit(r).alias("shard"), F.lit(True).alias("padding"))))
    out = rows.withColumn("__home", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull())))
    return out.withColumns({"shard": F.col("__home.shard"), "padding": F.col("__home.padding")}).drop("__home", "__place")


def dense_index(mapping: DataFrame, key: str, order: list[str], name: str = "index") -> DataFrame:
    """``mapping`` plus a number from 0 for each key, by its first row in the order."""
    first = mapping.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    numbered = ordering.with_rank(first.select(key, *[F.col(f"__first.{c}").alias(f"__o{k}") for k, c in enumerate(order)]), [f"__o{k}" for k in range(len(order))], name=name)
    return mapping.join(numbered.select(F.col(key).alias("__key"), name), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def interleaved(entries: DataFrame, start: str, copy: str, patch: str) -> DataFrame:
    """``entries`` plus place: by the patch's first plane, then copy, then patch, so that all copies of a slab come together."""
    return ordering.with_rank(entries, [start, copy, patch], name="place")


def common_cases(groups: list[DataFrame], case: str) -> DataFrame:
    """Cases that every group has."""
    out = groups[0].select(case)
    for g in groups[1:]:
        out = out.intersect(g.select(case))
    return out


def common_by_flags(sources: list[tuple[str, DataFrame]], case: str) -> DataFrame:
    """Cases over several sources of one group: flag ``a`` adds a source's cases, flag ``i`` keeps those that it has too, in order."""
    out = None
    for flag, df in sources:
        names = df.select(case).distinct()
        out = names if out is None else out.union(names).distinct() if flag == "a" else out.join(names, case, "left_semi")
    return out


def priority_source(sources: DataFrame, case: str, priority: str) -> DataFrame:
    """Of each case the row of the first source that has it, of ties the least row. Partial results before the shuffle; a null case is one case."""
    row = F.struct(priority, *[c for c in sources.columns if c != priority])
    return sources.groupBy(F.col(case).alias("__case")).agg(F.min(row).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in sources.columns])


def last_source(sources: DataFrame, case: str, priority: str) -> DataFrame:
    """Of each case the row of the last source that has it."""
    row = F.struct(priority, *[c for c in sources.columns if c != priority])
    return sources.groupBy(F.col(case).alias("__case")).agg(F.max(row).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in sources.columns])


def missing_groups(present: DataFrame, case: str, group: str, groups: list[str]) -> DataFrame:
    """(case, group) for each of ``groups`` that a case lacks."""
    have = present.groupBy(case).agg(F.collect_set(group).alias("have"))
    return have.select(case, F.explode(F.array_except(F.array(*map(F.lit, groups)), "have")).alias(group))


def aliased(present: DataFrame, case: str, group: str, renames: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Groups under new names, and (case, group) for each source that a case lacks. Two sources of one name are an error."""
    if len(set(renames.values())) < len(renames):
        raise ValueError("two groups would get one name")
    names = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair]) if renames else F.create_map().cast("map<string,string>")
    renamed = present.withColumn(group, F.coalesce(F.try_element_at(names, F.col(group)), F.col(group)))
    return renamed, missing_groups(present, case, group, list(renames))


def candidate_roots(files: DataFrame, path: str, most: int = 10) -> DataFrame:
    """root, cases, groups, depth: directories whose children hold files, by most cases, most groups, least depth; roots inside a better one are left out.

    A case is a directory, its groups the names of its files without their ending.
    """
    parts = files.select(F.split(path, "/").alias("__p")).where(F.size("__p") >= 3)
    n = F.size("__p")
    placed = parts.select(F.array_join(F.slice("__p", 1, n - 2), "/").alias("root"), F.get("__p", n - 2).alias("case"), F.regexp_replace(F.get("__p", n - 1), r"\..*$", "").alias("grp"), (n - 2).alias("depth"))
    roots = placed.groupBy("root", "depth").agg(F.count_distinct("case").alias("cases"), F.count_distinct("grp").alias("groups"))
    # A root's own ancestors are few: each is looked up by its path.
    upper = roots.select("root", "cases", "groups", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/"))), lambda k: F.array_join(F.slice(F.split(F.col("root"), "/"), F.lit(1), k - 1), "/"))).alias("above"))
    better = upper.join(roots.select(F.col("root").alias("above"), F.col("cases").alias("c"), F.col("groups").alias("g")), "above").where((F.col("c") > F.col("cases")) | ((F.col("c") == F.col("cases")) & (F.col("g") >= F.col("groups"))))
    return roots.join(better.select("root").distinct(), "root", "left_anti").orderBy(F.desc("cases"), F.desc("groups"), "depth", "root").limit(most)


def browse(files: DataFrame, path: str, depth: int = 2, most: int = 200) -> DataFrame:
    """entry, files: directories down to a depth with the number of files below them, the first ``most`` by name."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda k: F.array_join(F.slice(F.split(F.col(path), "/"), F.lit(1), k), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(above).alias("entry")).groupBy("entry").agg(F.count("*").alias("files")).orderBy("entry").limit(most)


def worst_shape(catalog: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """The greatest extent along each axis over a group's cases."""
    axes = catalog.select(*keys, F.posexplode(shape).alias("axis", "extent")).groupBy(*keys, "axis").agg(F.max("extent").alias("extent"))
    return axes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "extent"))), lambda a: a["extent"]).alias(shape))


def cached_bytes(shape: Column, copies: Column | int, item: int = 4) -> Column:
    """What a case and its copies take in memory."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda n, e: n * e) * item * copies
