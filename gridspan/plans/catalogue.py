"""Every registered query with its equivalent SQL, over the driver's tables.

Mapping: ``embeddings`` is a lattice (case vec_id, axis x of extent 64); ``lineitem`` joined to ``part`` is an
output against a target with a mask; ``customer``, ``orders`` and ``nation`` are catalogues; ``events`` is a
signal and a log; ``labels`` is a label map with a prediction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.functions.arrays import total
from gridspan.operators import augment, losses, metrics, patches, pointwise, reductions, report, selection, transforms, volume
from gridspan.sources import logs
from gridspan.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EXTENT = 64


def rounds_out(sql: str) -> str:
    """Each round(x, n) written out as floor(x * 10**n + 0.5) / 10**n in doubles, as ``half_up`` does: engines round halves in ways of their own."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, comma, end = 1, at, at + 6
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        if sql[end] == "," and depth == 1:
            comma = end
        end += 1
    inner, digits = rounds_out(sql[at + 6 : comma]), int(sql[comma + 1 : end - 1])
    return f"{sql[:at]}(floor(({inner}) * 1e{digits} + 0.5e0) / 1e{digits}){rounds_out(sql[end:])}"


def half_up(value: Column, digits: int) -> Column:
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = rounds_out(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    return df.select(*[half_up(F.col(c), own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the array v, as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def points(df: DataFrame, **own: int) -> DataFrame:
    """A row per voxel of v."""
    return rounded(df.select("vec_id", F.posexplode("v").alias("x", "value")), **own)


V = volume.Grid((EXTENT,))
CUBE = volume.Grid((4, 4, 4))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.lattice(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


VOX = "vox AS (SELECT vec_id, unnest(range(64))::INT AS x, unnest(embedding)::DOUBLE AS value FROM embeddings)"


CUBED = "v AS (SELECT vec_id, (x // 16)::INT AS z, (x // 4 % 4)::INT AS y, (x % 4)::INT AS x, value FROM vox)"


def cube_points(df: DataFrame, *columns: str, grid: volume.Grid = CUBE) -> DataFrame:
    """A row per voxel of array columns on a grid of three axes."""
    flat = df.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("i", "s"))
    return rounded(flat.select("vec_id", *[c.alias(a) for c, a in zip(grid.coordinates(F.col("i")), "zyx", strict=True)], *[F.col(f"s.{c}").alias(c) for c in columns]))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output, target and mask per line; the part table is small here, and the optimiser sees its size."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumns({"output": F.col("l_quantity") * F.col("p_retailprice"), "target": F.col("l_extendedprice")})


PAIRS = "pairs AS (SELECT *, l_quantity * p_retailprice AS output, l_extendedprice AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {PAIRS} SELECT l_returnflag, count(*) AS n, round(avg(abs(output - target)), 4) AS mae, round(avg((output - target) * (output - target)), 0) AS mse, round(avg(output - target), 4) AS me, round(sqrt(avg((output - target) * (output - target))), 4) AS rmse, round(10 * log10(4095.0 * 4095.0 / avg((output - target) * (output - target))), 4) AS psnr FROM pairs WHERE l_discount > 0.02 GROUP BY l_returnflag")
def masked_regression_report(spark, sf_dir):
    return rounded(metrics.regression_report(pairs(spark, sf_dir), ["l_returnflag"], F.col("output"), F.col("target"), F.col("l_discount") > 0.02), mse=0)


@query(f"WITH {PAIRS}, own AS (SELECT l_linestatus, l_orderkey, avg(abs(output - target)) FILTER (WHERE l_returnflag = 'R') AS v FROM pairs GROUP BY ALL) SELECT l_linestatus, count(v) AS items, round(avg(v), 3) AS value FROM own GROUP BY l_linestatus")
def metric_masked_items(spark, sf_dir):
    return rounded(metrics.masked_item_mean(pairs(spark, sf_dir), ["l_linestatus"], "l_orderkey", F.abs(F.col("output") - F.col("target")), F.col("l_returnflag") == "R"), 3)


@query(f"WITH {PAIRS} SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(avg(abs(output - target)), 4) AS mae FROM pairs GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def metric_grouping_sets(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(F.abs(F.col("output") - F.col("target"))).alias("mae")))


@query("SELECT event_type, round(max(value), 4) AS max, round(min(value), 4) AS min, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, round(avg(value), 4) AS mean, count(value) AS count FROM events GROUP BY event_type")
def stats_summary(spark, sf_dir):
    return rounded(report.statistics(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query(f"WITH {VOX} SELECT vec_id, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std FROM vox GROUP BY vec_id")
def volume_stats(spark, sf_dir):
    s = pointwise.image_statistics(F.col("v"))
    return rounded(arrays(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", "s.*"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer GROUP BY c_nationkey, c_mktsegment")
def profile_labels(spark, sf_dir):
    return rounded(report.label_profile(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment"), 6)


@query("WITH r AS (SELECT event_type, user_id::VARCHAR AS run, round(avg(value), 6) AS score FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, run) AS place FROM r) SELECT event_type, run, round(score, 4) AS score, place::INT AS place FROM p WHERE place <= 5")
def leaderboard_topk(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").cast("string").alias("run")).agg(half_up(F.avg("value"), 6).alias("score"))
    return rounded(report.leaderboard(runs, "event_type", "run", "score", 5))


@query("WITH a AS (SELECT user_id, round(avg(value), 6) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, round(avg(value), 6) AS v FROM events WHERE event_type = 'view' GROUP BY 1), j AS (SELECT b.v - a.v AS d FROM a JOIN b USING (user_id)) SELECT count(*) AS cases, round(avg(d), 4) AS delta, count(*) FILTER (WHERE d > 0) AS better_b, count(*) FILTER (WHERE d < 0) AS better_a, CASE WHEN count(*) FILTER (WHERE d > 0) > count(*) FILTER (WHERE d < 0) THEN 'b' WHEN count(*) FILTER (WHERE d < 0) > count(*) FILTER (WHERE d > 0) THEN 'a' ELSE 'tie' END AS winner FROM j")
def compare_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    run = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(half_up(F.avg("value"), 6).alias("score"))
    return rounded(report.compare_runs(run("click"), run("view"), ["user_id"], "score", True))


@query("WITH n AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, value FROM n WHERE k % greatest(ceil(total / 20.0)::BIGINT, 1) = 0 OR k = total - 1")
def curve_stride(spark, sf_dir):
    return report.curve(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", 20)


@query("WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id, value FROM n WHERE k = 1")
def best_checkpoint(spark, sf_dir):
    return report.best_checkpoint(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", True)


@query("WITH r AS (SELECT DISTINCT o_orderkey, dense_rank() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey FROM r WHERE k >= 10 AND k < 1000 AND (k - 10) % 7 = 0")
def subset_slice(spark, sf_dir):
    return selection.subset_slice(table(spark, sf_dir, "orders"), "o_orderkey", 10, 1000, 7)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def subset_list(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.subset_list(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), listed, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def subset_exclude(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.subset_exclude(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), listed, "o_orderkey")


@query("WITH w AS (SELECT l_orderkey, count(*) AS patches FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, patches, sum(patches) OVER (ORDER BY l_orderkey) AS running, floor(sum(patches) OVER () * 0.8) AS threshold FROM w) SELECT l_orderkey, patches, running::BIGINT AS running, running > threshold AS validation FROM s")
def validation_split(spark, sf_dir):
    weighted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("patches"))
    return selection.validation_split(weighted, "l_orderkey", "patches", 0.2)


@query("WITH d AS (SELECT DISTINCT c_custkey, (c_custkey * 1103515245 + 12345) % 2147483648 AS draw FROM customer) SELECT c_custkey, ((row_number() OVER (ORDER BY draw, c_custkey) - 1) % 5)::INT AS fold FROM d")
def kfold_assign(spark, sf_dir):
    return selection.kfold(table(spark, sf_dir, "customer"), "c_custkey", 5)


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def common_cases(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return selection.common_cases([e.where(F.col("event_type") == k) for k in ("click", "error", "purchase")], "user_id")


@query("WITH s AS (SELECT c_nationkey AS nation, 1 AS priority, max(c_acctbal) AS best FROM customer WHERE c_acctbal > 9000 GROUP BY 1 UNION ALL SELECT s_nationkey, 2, max(s_acctbal) FROM supplier GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY priority) AS k FROM s) SELECT nation, priority, best FROM r WHERE k = 1")
def priority_source(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.lit(1).alias("priority"), F.max("c_acctbal").alias("best"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.lit(2).alias("priority"), F.max("s_acctbal").alias("best"))
    return selection.priority_source(a.unionByName(b), "nation", "priority")


GROUPS = ["click", "error", "purchase", "signup", "view"]


@query("WITH g AS (SELECT DISTINCT event_type FROM events), d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), h AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events) SELECT concat(d.user_id, ':', d.day) AS session, g.event_type FROM d CROSS JOIN g ANTI JOIN h ON h.user_id = d.user_id AND h.day = d.day AND h.event_type = g.event_type")
def presence_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.to_date("ts")).alias("session"), "event_type")
    return selection.missing_groups(e, "session", "event_type", GROUPS)


@query(f"WITH {VOX} SELECT vec_id, x, round(2 * (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) + -1, 4) AS value FROM vox WINDOW w AS (PARTITION BY vec_id)")
def normalize(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", pointwise.normalize(F.col("v"), -1.0, 1.0)))


@query(f"WITH {VOX} SELECT vec_id, x, round(value, 4) AS value FROM vox")
def inverse_roundtrip(spark, sf_dir):
    there = arrays(spark, sf_dir).withColumns({"a": F.array_min("v"), "b": F.array_max("v")}).withColumn("v", pointwise.normalize(volume.flip(F.col("v"), V, (0,)), -1.0, 1.0))
    return points(there.withColumn("v", volume.flip(pointwise.denormalize(F.col("v"), -1.0, 1.0, F.col("a"), F.col("b")), V, (0,))))


@query(f"WITH {VOX} SELECT vec_id, x, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 4) AS value FROM vox WINDOW w AS (PARTITION BY vec_id)")
def standardize(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", pointwise.standardize(F.col("v"))))


@query(f"WITH {VOX}, b AS (SELECT vec_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM vox GROUP BY 1) SELECT vec_id, x, round(least(greatest(value, lo), hi), 4) AS value FROM vox JOIN b USING (vec_id)")
def clip_percentile(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", pointwise.clip(F.col("v"), "percentile:5", "percentile:95")))


@query(f"WITH {VOX}, m AS (SELECT *, max(value) OVER (PARTITION BY vec_id) AS top FROM vox) SELECT vec_id, x, round(exp(value - top) / sum(exp(value - top)) OVER (PARTITION BY vec_id), 5) AS p FROM m")
def softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(transforms.softmax(F.col("embedding").cast("array<double>"))).alias("x", "p"))
    return rounded(e, 5)


@query(f"WITH {VOX}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, x) AS k FROM vox) SELECT vec_id, x AS channel FROM r WHERE k = 1")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", transforms.argmax(F.col("embedding")).alias("channel"))


@query("SELECT vec_id, label, c.range::INT AS channel, (label = c.range)::INT AS hot FROM embeddings, range(10) c")
def onehot(spark, sf_dir):
    return transforms.one_hot(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 10)


@query("SELECT vec_id, CASE label WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS label FROM embeddings")
def select_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", transforms.select_labels(F.col("label"), {3: 1, 5: 2, 7: 3}).alias("label"))


@query("SELECT vec_id, (label > 0)::INT AS label FROM embeddings")
def flat_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(pointwise.flat_label(F.array("label")), F.lit(0)).alias("label"))


@query(f"WITH {VOX} SELECT vec_id, 63 - x AS x, round(value, 4) AS value FROM vox")
def flip(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", volume.flip(F.col("v"), V, (0,))))


@query(f"WITH {VOX} SELECT vec_id, (x % 8)::INT AS z, (x // 8)::INT AS y, round(value, 4) AS value FROM vox")
def permute(spark, sf_dir):
    planes = voxels(spark, sf_dir).select("vec_id", F.floor(F.col("x") / 8).cast("int").alias("z"), (F.col("x") % 8).alias("y"), "value")
    return rounded(transforms.permute(planes, {"z": "y", "y": "z"}))


@query(f"WITH {VOX}, {CUBED}, g AS (SELECT a.vec_id, a.z, a.y, a.x, coalesce(p.value - a.value, 0) AS gz, coalesce(q.value - a.value, 0) AS gy, coalesce(r.value - a.value, 0) AS gx FROM v a LEFT JOIN v p ON p.vec_id = a.vec_id AND p.z = a.z + 1 AND p.y = a.y AND p.x = a.x LEFT JOIN v q ON q.vec_id = a.vec_id AND q.z = a.z AND q.y = a.y + 1 AND q.x = a.x LEFT JOIN v r ON r.vec_id = a.vec_id AND r.z = a.z AND r.y = a.y AND r.x = a.x + 1), s AS (SELECT *, 1 / (1 + exp(-3 * gz)) AS sz, 1 / (1 + exp(-3 * gy)) AS sy, 1 / (1 + exp(-3 * gx)) AS sx FROM g) SELECT vec_id, z, y, x, round(sqrt(sz * sz + sy * sy + sx * sx), 4) AS gradient, round(gy, 4) AS by_row FROM s")
def gradient(spark, sf_dir):
    cubes = arrays(spark, sf_dir).withColumns({"gradient": volume.gradient(F.col("v"), CUBE), "by_row": volume.differences(F.col("v"), CUBE, 1)})
    return cube_points(cubes, "gradient", "by_row")


@query(f"WITH {VOX}, {CUBED} SELECT a.vec_id, a.z, a.y, a.x, max((b.value > 1)::INT)::DOUBLE AS dilated FROM v a JOIN v b ON b.vec_id = a.vec_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.z, a.y, a.x")
def dilate(spark, sf_dir):
    above = F.transform("v", lambda x: x - 1)
    return cube_points(arrays(spark, sf_dir).withColumn("dilated", volume.dilate(above, CUBE, 1)), "dilated")


@query(f"WITH {VOX}, b AS (SELECT vec_id, quantile_cont(value, 0.9) AS level FROM vox GROUP BY 1) SELECT vec_id, min(x) AS near, max(x) AS far FROM vox JOIN b USING (vec_id) WHERE value > level GROUP BY vec_id")
def crop_bbox(spark, sf_dir):
    level = pointwise.bound(F.col("v"), "percentile:90")
    places = arrays(spark, sf_dir).withColumn("level", level).withColumn("at", F.filter(F.transform("v", lambda v, i: F.when(v > F.col("level"), i)), lambda i: i.isNotNull()))
    return places.where(F.size("at") > 0).select("vec_id", F.array_min("at").alias("near"), F.array_max("at").alias("far"))


@query(f"WITH {VOX} SELECT vec_id, (x + 2)::INT AS x, round(value, 4) AS value FROM vox UNION ALL SELECT vec_id, e::INT, -1.0 FROM embeddings, (SELECT unnest([0, 1, 66, 67, 68]) AS e)")
def padding(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", volume.pad(F.col("v"), V, (2,), (3,), "constant", -1.0)))


@query(f"WITH {VOX} SELECT v.vec_id, o.range::INT AS x, round(v.value, 4) AS value FROM range(40) o JOIN vox v ON v.x = (o.range * 64) // 40")
def resample_nearest(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", volume.resample(F.col("v"), V, volume.Grid((40,)), labels=True)))


@query(f"WITH {VOX}, o AS (SELECT range::INT AS o, greatest(64.0 / 40 * (range + 0.5) - 0.5, 0)::DOUBLE AS pos FROM range(40)), t AS (SELECT o, floor(pos)::INT AS i, pos - floor(pos) AS p FROM o) SELECT a.vec_id, o AS x, round(a.value * (1 - p) + b.value * p, 4) AS value FROM t JOIN vox a ON a.x = t.i JOIN vox b ON b.vec_id = a.vec_id AND b.x = least(t.i + 1, 63)")
def resample_linear(spark, sf_dir):
    return points(arrays(spark, sf_dir).withColumn("v", volume.resample(F.col("v"), V, volume.Grid((40,)))))


@query("WITH e AS (SELECT o_orderkey, (o_orderkey % 90 + 1)::INT AS extent FROM orders), g AS (SELECT o_orderkey, extent, unnest(range(CASE WHEN extent <= 16 THEN 1 ELSE ceil((extent - 16) / 12.0)::INT + 1 END)) AS k FROM e) SELECT o_orderkey, k::INT AS patch_idx, (k * 12)::INT AS start, least(k * 12 + 16, extent)::INT AS stop FROM g")
def patch_grid(spark, sf_dir):
    return patches.grid(table(spark, sf_dir, "orders"), "o_orderkey", (F.col("o_orderkey") % 90 + 1).cast("int"), 16, 4)


CELLS = "cells AS (SELECT range AS k, (range * 12)::INT AS a FROM range(5)), held AS (SELECT vec_id, k, x - a AS o, x, value FROM vox JOIN cells ON x >= a AND x < a + 16)"


def _pieces(spark, sf_dir):
    return patches.extract(voxels(spark, sf_dir), "vec_id", "x", "value", EXTENT, 16, 4, 0.0)


@query(f"WITH {VOX}, c AS (SELECT range::INT AS k, (range * 14)::INT AS a FROM range(5)), p AS (SELECT vec_id, k, unnest(range(16))::INT AS o, a FROM embeddings, c) SELECT p.vec_id, p.k AS patch_idx, p.o AS offset, round(coalesce(vox.value, -2.0), 4) AS value FROM p LEFT JOIN vox ON vox.vec_id = p.vec_id AND vox.x = p.a + p.o")
def patch_extract_pad(spark, sf_dir):
    return rounded(patches.extract(voxels(spark, sf_dir), "vec_id", "x", "value", EXTENT, 16, 2, -2.0))


def _blend(kind):
    return lambda spark, sf_dir: rounded(patches.blend(_pieces(spark, sf_dir).withColumn("value", F.col("value") + F.col("patch_idx")), "vec_id", "value", EXTENT, 16, 4, kind))


for _kind, _weight in (("mean", "1.0"), ("cosinus", "least(CASE WHEN o < 4 THEN sin((o + 0.5) / 4 * pi() / 2) ** 2 ELSE 1 END, CASE WHEN 15 - o < 4 THEN sin((15 - o + 0.5) / 4 * pi() / 2) ** 2 ELSE 1 END)"), ("gaussian", "exp(-((o - 7.5) ** 2) / 8.0)")):
    QUERIES[f"patch_blend_{_kind}"] = _blend(_kind)
    SQL[f"patch_blend_{_kind}"] = rounds_out(f"WITH {VOX}, {CELLS}, w AS (SELECT *, ({_weight})::DOUBLE AS w FROM held) SELECT vec_id, x, round(sum(w * (value + k)) / sum(w), 4) AS value FROM w GROUP BY vec_id, x")


@query(f"WITH {VOX}, {CELLS} SELECT vec_id, x, round(arg_max(value + k, k), 4) AS value FROM held GROUP BY vec_id, x")
def patch_overwrite(spark, sf_dir):
    return rounded(patches.overwrite(_pieces(spark, sf_dir).withColumn("value", F.col("value") + F.col("patch_idx")), "vec_id", "value", EXTENT, 16, 4))


def _members(spark, sf_dir):
    """Vectors of one label are the members that vote on each x."""
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("member"), F.posexplode("embedding").alias("x", "value")).withColumn("value", F.col("value").cast("double"))


MEM = "mem AS (SELECT label, vec_id AS member, unnest(range(64))::INT AS x, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"WITH {MEM} SELECT label, x, round(avg(value), 4) AS value FROM mem GROUP BY label, x")
def ensemble_mean(spark, sf_dir):
    return rounded(reductions.mean(_members(spark, sf_dir), ["label", "x"], "value"))


@query(f"WITH {MEM} SELECT label, x, round(quantile_disc(value, 0.5), 4) AS value FROM mem GROUP BY label, x")
def ensemble_lower_median(spark, sf_dir):
    return rounded(reductions.lower_median(_members(spark, sf_dir), ["label", "x"], "value"))


@query(f"WITH {MEM} SELECT label, x, round(coalesce(var_samp(value), 0), 4) AS variance FROM mem GROUP BY label, x")
def member_variance(spark, sf_dir):
    return rounded(reductions.variance(_members(spark, sf_dir), ["label", "x"], "value"))


@query(f"WITH {MEM}, c AS (SELECT label, x, list(value ORDER BY member) AS vs FROM mem GROUP BY label, x) SELECT label, x, len(vs)::INT AS channels, round(vs[1], 4) AS first, round(vs[-1], 4) AS last FROM c")
def ensemble_concat(spark, sf_dir):
    c = reductions.concat(_members(spark, sf_dir), ["label", "x"], "member", "value")
    return rounded(c.select("label", "x", F.size("value").alias("channels"), F.get("value", F.lit(0)).alias("first"), F.element_at("value", -1).alias("last")))


@query(f"WITH {MEM}, v AS (SELECT x, label, floor(value * 2)::INT AS cls, count(*) AS n FROM mem GROUP BY ALL) SELECT label, x, round(CASE WHEN sum(n) > 1 THEN 1 - max(n) / sum(n) ELSE 0 END, 5) AS disagreement, round(CASE WHEN sum(n) > 1 AND sum(n) FILTER (cls <> 0) > 0 THEN 1 - max(n) FILTER (cls <> 0) / sum(n) FILTER (cls <> 0) ELSE 0 END, 5) AS foreground FROM v GROUP BY label, x")
def disagreement(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("cls", F.floor(F.col("value") * 2).cast("int"))
    both = reductions.disagreement(m, ["label", "x"], "cls").join(reductions.disagreement(m, ["label", "x"], "cls", True).withColumnRenamed("disagreement", "foreground"), ["label", "x"])
    return rounded(both, 5)


@query("WITH m AS (SELECT l_orderkey, l_linenumber AS member, (l_partkey % 4)::INT AS cls, (l_linenumber - 1) * 3 AS raised FROM lineitem) SELECT l_orderkey, coalesce(arg_max(cls + raised, member * 10 + cls) FILTER (WHERE cls <> 0), 0)::INT AS cls FROM m GROUP BY l_orderkey")
def merge_labels(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("member"), (F.col("l_partkey") % 4).cast("int").alias("cls"))
    return reductions.merge_labels(m, ["l_orderkey"], "member", "cls", {k: 4 for k in range(1, 8)})


@query("WITH v AS (SELECT label AS target, (vec_id * 7 % 10)::INT AS output FROM embeddings), l AS (SELECT target AS label, count(*) AS t FROM v WHERE target <> 0 GROUP BY 1), o AS (SELECT output AS label, count(*) AS o FROM v WHERE output <> 0 GROUP BY 1), c AS (SELECT target AS label, count(*) AS c FROM v WHERE target = output AND target <> 0 GROUP BY 1) SELECT 0 AS grp, label, round((2 * coalesce(c, 0) + 1e-6) / (coalesce(o, 0) + t + 1e-6), 6) AS dice FROM l LEFT JOIN o USING (label) LEFT JOIN c USING (label)")
def dice_per_label(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("grp"), F.col("label").alias("target"), (F.col("vec_id") * 7 % 10).cast("int").alias("output"))
    return rounded(metrics.dice(v, ["grp"], "output", "target"), 6)


@query(f"WITH {VOX}, r AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, x) AS k FROM vox WHERE x < 10) SELECT (e.vec_id % 7)::INT AS grp, round(avg((r.x = e.label)::INT), 6) AS accuracy FROM r JOIN embeddings e USING (vec_id) WHERE k = 1 GROUP BY 1")
def accuracy(spark, sf_dir):
    e = arrays(spark, sf_dir).withColumn("grp", (F.col("vec_id") % 7).cast("int"))
    return rounded(metrics.accuracy(e, ["grp"], F.slice("v", 1, 10), F.col("label")), 6)


LOGP = f"{VOX}, lse AS (SELECT vec_id, log_sum AS s FROM (SELECT vec_id, ln(sum(exp(value))) AS log_sum FROM vox WHERE x < 10 GROUP BY 1)), logp AS (SELECT e.vec_id, e.label, v.value - s AS lp FROM embeddings e JOIN vox v ON v.vec_id = e.vec_id AND v.x = e.label JOIN lse ON lse.vec_id = e.vec_id)"


@query(f"WITH {LOGP} SELECT vec_id, round(-lp, 4) AS loss FROM logp")
def cross_entropy(spark, sf_dir):
    logits = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", metrics.cross_entropy(logits, F.col("label")).alias("loss")))


@query(f"WITH {LOGP} SELECT vec_id, round(-((label + 1) / 55.0 * 10)::DOUBLE * (1 - exp(lp)) ** 2 * lp, 4) AS loss FROM logp")
def focal(spark, sf_dir):
    logits = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", metrics.focal(logits, F.col("label"), [float(i + 1) for i in range(10)], 2.0).alias("loss")))


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS p FROM c) SELECT c_nationkey, round(sum(p * ln(p / 0.2)), 5) AS kl FROM p GROUP BY c_nationkey")
def kl(spark, sf_dir):
    profile = report.label_profile(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")
    return rounded(metrics.kl_divergence(profile, ["c_nationkey"], F.col("share"), F.lit(0.2)), 5)


@query(f"WITH {VOX}, p AS (SELECT vec_id, x // 16 AS c, x % 16 AS i, value FROM vox) SELECT s.vec_id, s.c::INT AS a, t.c::INT AS b, round(avg(s.value * t.value), 4) AS gram FROM p s JOIN p t ON s.vec_id = t.vec_id AND s.i = t.i AND s.c <= t.c GROUP BY ALL")
def gram(spark, sf_dir):
    e = arrays(spark, sf_dir).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(*[F.get("v", i + 16 * c) for c in range(4)]))).alias("vector"))
    return rounded(metrics.gram(e, "vec_id", "vector"))


@query("WITH l AS (SELECT label AS grp, vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings) SELECT grp, round(avg(sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2)), 4) AS tre, round(max(sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2)), 4) AS worst FROM l GROUP BY grp")
def tre(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    marks = lambda at: e.select(F.col("label").alias("grp"), F.col("vec_id").alias("idx"), *[F.get("embedding", F.lit(at + i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    return rounded(metrics.registration_error(marks(0), marks(3), ["grp"], list("xyz")))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    return rounded(windows.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 hour"), 3)


@query("WITH s AS (SELECT event_type, value, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * unnest(range(3)) AS start FROM events) SELECT event_type, start, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY ALL")
def event_sliding(spark, sf_dir):
    return rounded(windows.sliding(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "30 minutes", "10 minutes"), 3)


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, k")
def event_session(spark, sf_dir):
    return rounded(windows.session(table(spark, sf_dir, "events"), "ts", ["user_id"], "value", "6 hours"), 3)


@query("SELECT event_id, event_type AS stage, regexp_extract('step ' || event_id || ' loss=' || round(value, 3) || ' k=' || props, 'step ([0-9]+)', 1)::BIGINT AS step, regexp_extract(props, '\"k\": ?([0-9]+)', 1)::BIGINT AS k FROM events")
def log_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stage"), F.concat(F.lit("step "), "event_id", F.lit(" k="), "props").alias("line"))
    return logs.parse(e, "line", {"step": (r"step ([0-9]+)", "bigint"), "k": (r'"k": ?([0-9]+)', "bigint")}).select("event_id", "stage", "step", "k")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of each array, as doubles."""
    return augment.copies(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), 3)


def draw(salt: int) -> str:
    return f"((((vec_id % 2147483648 + copy * 7919 + {salt * 104729}) * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 / 2147483648e0)"


def bell(salt: int) -> str:
    return f"(sqrt(-2 * ln(1 - {draw(salt)})) * cos(2 * pi() * {draw(salt + 1)}))"


def spread(df: DataFrame) -> DataFrame:
    return rounded(df.select("vec_id", "copy", F.posexplode("v").alias("x", "value")))


COPIES = "c AS (SELECT vec_id, unnest(range(3)) AS copy, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id, copy, unnest(range(64))::INT AS x, v FROM c)"


@query(f"WITH {COPIES} SELECT vec_id, copy, x, round(CASE WHEN {draw(0)} < 0.33 THEN v[64 - x] ELSE v[x + 1] END, 4) AS value FROM d")
def augment_flip(spark, sf_dir):
    return spread(copies(spark, sf_dir).withColumn("v", augment.flip(F.col("v"), augment.uniform(F.col("vec_id"), F.col("copy"), 0) < 0.33)))


@query(f"WITH {COPIES}, e AS (SELECT *, abs(x - (floor({draw(1)} * 21) - 10)::INT) AS pos FROM d) SELECT vec_id, copy, x, round(v[CASE WHEN pos > 63 THEN 126 - pos ELSE pos END + 1], 4) AS value FROM e")
def augment_translate(spark, sf_dir):
    shift = (F.floor(augment.uniform(F.col("vec_id"), F.col("copy"), 1) * 21) - 10).cast("int")
    return spread(copies(spark, sf_dir).withColumn("shift", shift).withColumn("v", augment.translate(F.col("v"), F.col("shift"))))


@query(f"WITH {COPIES} SELECT vec_id, copy, x, round((v[x + 1] + 0.1e0 * {bell(2)}) * 2 ** (0.2e0 * {bell(4)}), 4) AS value FROM d")
def augment_brightness_contrast(spark, sf_dir):
    own = {n: augment.normal(F.col("vec_id"), F.col("copy"), salt) * size for n, salt, size in (("added", 2, 0.1), ("exponent", 4, 0.2))}
    return spread(copies(spark, sf_dir).withColumns(own).withColumn("v", augment.brightness_contrast(F.col("v"), F.col("added"), F.col("exponent"))))


@query(f"WITH {COPIES} SELECT vec_id, copy, x, round(CASE WHEN abs((x + 0.5e0) / 64 - {draw(6)}) < 0.125e0 THEN 0 ELSE v[x + 1] END, 4) AS value FROM d")
def augment_cutout(spark, sf_dir):
    return spread(copies(spark, sf_dir).withColumn("centre", augment.uniform(F.col("vec_id"), F.col("copy"), 6)).withColumn("v", augment.cut_out(F.col("v"), F.col("centre"), 0.25, 0.0)))


@query("WITH vox AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, round(avg(greatest(x, 0) - x + ln(1 + exp(-abs(x)))), 4) AS bce, round(avg(x * x), 4) AS patch_gan, round(avg((x - 1) * (x - 1)), 4) AS wgp FROM vox GROUP BY label")
def adversarial_losses(spark, sf_dir):
    x = F.col("x")
    vox = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rounded(vox.groupBy("label").agg(F.avg(losses.bce_with_logits(x, 1.0)).alias("bce"), F.avg(losses.squared_to(x, 0.0)).alias("patch_gan"), F.avg(losses.squared_to(x, 1.0)).alias("wgp")))


def beside(spark: SparkSession, sf_dir: str, others: int) -> DataFrame:
    """Arrays v0, v1, ... of each id and of those that follow it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v0"))
    out = e
    for k in range(1, others + 1):
        out = out.join(e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v0").alias(f"v{k}")), "vec_id")
    return out


BESIDE = "s AS (SELECT a.vec_id, a.label, unnest(range(64))::INT AS x, unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query("WITH s AS (SELECT a.vec_id, a.label, unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b, unnest(c.embedding)::DOUBLE AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2), t AS (SELECT vec_id, label, sqrt(sum((a - b + 1e-7) ** 2)) - sqrt(sum((a - c + 1e-7) ** 2)) + 1 AS d FROM s GROUP BY ALL) SELECT label, round(avg(greatest(d, 0)), 4) AS loss FROM t GROUP BY label")
def triplet_loss(spark, sf_dir):
    return rounded(beside(spark, sf_dir, 2).groupBy("label").agg(F.avg(losses.triplet(F.col("v0"), F.col("v1"), F.col("v2"))).alias("loss")))


@query("WITH s AS (SELECT vec_id, label, unnest(embedding[1:32])::DOUBLE AS m, unnest(embedding[33:64])::DOUBLE AS s FROM embeddings), t AS (SELECT vec_id, label, -0.5e0 * sum(1 + s - m * m - exp(s)) AS kl FROM s GROUP BY ALL) SELECT label, round(avg(kl), 4) AS loss FROM t GROUP BY label")
def latent_kl(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return rounded(table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(losses.latent_kl(F.slice(v, 1, 32), F.slice(v, 33, 32))).alias("loss")))


@query(f"WITH {BESIDE}, g AS (SELECT vec_id, (lead(a - b) OVER (PARTITION BY vec_id ORDER BY x)) - (a - b) AS d FROM s) SELECT vec_id, round(sqrt(sum(d * d)), 4) AS loss FROM g GROUP BY vec_id")
def gradient_images(spark, sf_dir):
    return rounded(beside(spark, sf_dir, 1).select("vec_id", losses.gradient_difference(F.col("v0"), F.col("v1")).alias("loss")))


@query(f"WITH {BESIDE}, p AS (SELECT label, x, avg(abs(a - b)) AS l1, var_samp(a) AS va, var_samp(b) AS vb FROM s GROUP BY ALL) SELECT label, round(avg(l1) + avg(greatest(1 - va, 0)) + avg(greatest(1 - vb, 0)), 4) AS loss FROM p GROUP BY label")
def representation_loss(spark, sf_dir):
    return rounded(losses.representation(beside(spark, sf_dir, 1), ["label"], "v0", "v1"))


@query(f"WITH {BESIDE}, w AS (SELECT vec_id, x, avg(a) OVER r AS mx, avg(b) OVER r AS my, avg(a * a) OVER r AS xx, avg(b * b) OVER r AS yy, avg(a * b) OVER r AS xy FROM s WINDOW r AS (PARTITION BY vec_id ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT vec_id, round(avg((2 * mx * my + 0.0004e0) * (2 * 7e0 / 6 * (xy - mx * my) + 0.0036e0) / ((mx * mx + my * my + 0.0004e0) * (7e0 / 6 * (xx - mx * mx + yy - my * my) + 0.0036e0))), 4) AS ssim FROM w WHERE x BETWEEN 3 AND 60 GROUP BY vec_id")
def ssim(spark, sf_dir):
    vox = beside(spark, sf_dir, 1).select("vec_id", F.posexplode(F.arrays_zip(F.col("v0").alias("a"), F.col("v1").alias("b"))).alias("x", "v")).select("vec_id", "x", "v.a", "v.b")
    return rounded(losses.ssim(vox, "vec_id", "x", "a", "b", 2.0, EXTENT))


@query("WITH w AS (SELECT event_type, event_id, avg(value) OVER r AS mean, count(*) OVER r AS held FROM events WINDOW r AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT event_type, event_id, round(mean, 4) AS mean FROM w WHERE held = 20")
def measure_last_values(spark, sf_dir):
    return rounded(losses.last_values(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", 20).drop("value"))


@query("SELECT event_id, CASE WHEN event_id < 100 THEN 'warm' WHEN event_id < 600 THEN 'flat' ELSE 'decay' END AS scheduler FROM events")
def scheduler_at(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", losses.scheduler_at(F.col("event_id"), [("warm", 100), ("flat", 500), ("decay", 300)]).alias("scheduler"))


@query("SELECT label, max(len(embedding))::BIGINT AS worst_extent, sum(len(embedding) * 4 * 3)::BIGINT AS cached_bytes FROM embeddings GROUP BY label")
def cache_plan(spark, sf_dir):
    shape = F.array(F.size("embedding"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding").cast("long")).alias("worst_extent"), F.sum(selection.cached_bytes(shape, 3)).alias("cached_bytes"))


@query("WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, round(sqrt(sum(v * v)), 4) AS norm, round(sum(v / 2 * 100), 3) AS percentage FROM s GROUP BY vec_id")
def norm_percentage(spark, sf_dir):
    v = F.col("v")
    return rounded(arrays(spark, sf_dir).select("vec_id", F.get(pointwise.norm(v, EXTENT), F.lit(0)).alias("norm"), total(pointwise.percentage(v, 2.0)).alias("percentage")), percentage=3)


@query(f"WITH {BESIDE} SELECT vec_id, x, round(CASE WHEN b > 0 THEN a ELSE -1 END, 4) AS value FROM s")
def mask_fill(spark, sf_dir):
    return points(beside(spark, sf_dir, 1).withColumn("v", pointwise.masked(F.col("v0"), F.transform("v1", lambda m: (m > 0).cast("int")), -1.0)))


@query("WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), q AS (SELECT vec_id, -y + 1 AS x, x + 2 AS y, z + 3 AS z FROM p) SELECT vec_id, round(2 * x, 4) AS x, round(y + 0.5e0 * z, 4) AS y, round(z - 1, 4) AS z FROM q")
def affine_points(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    turn, stretch = [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0]], [[2.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.5, 0.0], [0.0, 0.0, 1.0, -1.0]]
    return rounded(losses.move_points(points, ["x", "y", "z"], losses.compose(turn, stretch)))


@query(f"WITH {VOX}, c AS (SELECT vec_id, x, least(greatest(value / 4 + 0.5e0, 0), 1) AS a FROM vox), d AS (SELECT vec_id, x, a, 1 - a AS b FROM c), bins AS (SELECT range AS k, range / 22e0 AS t FROM range(23)), w AS (SELECT vec_id, x, k, exp(-968e0 * (a - t) * (a - t)) AS wa, exp(-968e0 * (b - t) * (b - t)) AS wb FROM d, bins), n AS (SELECT vec_id, x, k, wa / sum(wa) OVER p AS wa, wb / sum(wb) OVER p AS wb FROM w WINDOW p AS (PARTITION BY vec_id, x)), j AS (SELECT s.vec_id, s.k AS i, t.k AS j, sum(s.wa * t.wb) / 64 AS p FROM n s JOIN n t ON s.vec_id = t.vec_id AND s.x = t.x GROUP BY ALL), f AS (SELECT vec_id, p, sum(p) OVER (PARTITION BY vec_id, i) AS pa, sum(p) OVER (PARTITION BY vec_id, j) AS pb FROM j) SELECT vec_id, 64::BIGINT AS n, round(sum(p * ln((p + 1e-7) / (pa * pb + 1e-7) + 1e-7)), 4) AS mutual_information FROM f GROUP BY vec_id")
def mutual_information(spark, sf_dir):
    a = F.transform("v", lambda x: F.least(F.greatest(x / 4 + 0.5, F.lit(0.0)), F.lit(1.0)))
    v = arrays(spark, sf_dir).select("vec_id", a.alias("a")).withColumn("b", F.transform("a", lambda x: 1 - x))
    return rounded(metrics.mutual_information(v, ["vec_id"], "a", "b"))


@query("SELECT event_type, json_object('max', max(value), 'min', min(value), 'count', count(value))::VARCHAR AS report FROM events GROUP BY event_type")
def report_json(spark, sf_dir):
    s = report.statistics(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "max", "min", "count")
    return report.report_json(s, "event_type")