"""Queries of orders, boxes and maps that only tests held before: sampler windows, interleaved patches, label boxes, displacements, orientation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import geometry, losses, metrics, pointwise, selection, volume
from gridspan.plans import graph
from gridspan.plans.catalogue import CUBE, CUBED, VOX, arrays, cube_points, query, rounded, table

V = F.col

_DRAW = "((({key}) % 2147483648 + {seed} * 7919) % 2147483648 * 1103515245 + 12345) % 2147483648"


@query(
    f"WITH c AS (SELECT o_custkey, (row_number() OVER (ORDER BY {_DRAW.format(key='o_custkey', seed=0)}, o_custkey) - 1) // 20 AS w FROM (SELECT DISTINCT o_custkey FROM orders)) "
    f"SELECT o_orderkey, row_number() OVER (ORDER BY w * 2147483648 + {_DRAW.format(key='o_custkey * 65537 + o_orderkey', seed=1)}, o_custkey, o_orderkey) - 1 AS place FROM orders JOIN c USING (o_custkey)"
)
def sampler_windows(spark, sf_dir):
    """Customers in drawn order, twenty at a time, and the orders of a window in drawn order."""
    return selection.windowed_order(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 20).select("o_orderkey", "place")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_linenumber, l_suppkey, l_orderkey) - 1 AS place FROM lineitem")
def interleaved_entries(spark, sf_dir):
    """Patches by start, then copy, then number: the start has seven values, and the ranges are even all the same."""
    return selection.interleaved(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_linenumber", "l_suppkey", "l_orderkey").select("l_orderkey", "l_linenumber", "place")


@query("WITH v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT user_id, user_id IN (SELECT user_id FROM v) AS validation FROM (SELECT DISTINCT user_id FROM events)")
def split_by_names(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    training, validation = selection.split_names(events.select("user_id").distinct(), events.where("event_type = 'error'"), "user_id")
    return training.withColumn("validation", F.lit(False)).unionByName(validation.withColumn("validation", F.lit(True)))


_LABELLED = f"{VOX}, {CUBED}, g AS (SELECT *, CASE WHEN value > 0.1 THEN 1 WHEN value < -0.15 THEN 2 ELSE 0 END AS label FROM v), b AS (SELECT vec_id, greatest(min(z) - 1, 0) AS z_from, least(max(z) + 2, 4) AS z_to, min(x) AS x_from, max(x) + 1 AS x_to FROM g WHERE label = 2 GROUP BY vec_id)"


def _labelled(spark, sf_dir):
    flat = volume.long_form(arrays(spark, sf_dir), ["vec_id"], "v", CUBE, ["z", "y", "x"])
    return flat.withColumn("label", F.when(V("value") > 0.1, 1).when(V("value") < -0.15, 2).otherwise(0))


@query(f"WITH {_LABELLED} SELECT * FROM b")
def label_boxes(spark, sf_dir):
    return geometry.label_boxes(_labelled(spark, sf_dir), ["vec_id"], "label", [2], ["z", "x"], {"z": 1}, {"z": 4, "x": 4})


@query(f"WITH {_LABELLED} SELECT g.vec_id, g.z - z_from AS z, g.y, g.x - x_from AS x, round(value, 4) AS value FROM g JOIN b USING (vec_id) WHERE g.z >= z_from AND g.z < z_to AND g.x >= x_from AND g.x < x_to")
def label_crop(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    boxes = geometry.label_boxes(rows, ["vec_id"], "label", [2], ["z", "x"], {"z": 1}, {"z": 4, "x": 4})
    return rounded(geometry.cropped(rows, ["vec_id"], boxes, ["z", "x"]).select("vec_id", "z", "y", "x", "value"))


@query(f"WITH {VOX}, {CUBED} SELECT p.vec_id, p.z, p.y, p.x, round(0.75 * p.value + 0.25 * q.value, 4) AS v FROM v p JOIN v q ON q.vec_id = p.vec_id AND q.z = p.z AND q.x = p.x AND q.y = least(p.y + 1, 3)")
def displace_quarter(spark, sf_dir):
    """A displacement of a quarter of a voxel along y, the edge voxel beyond the edge."""
    fields = [F.array_repeat(F.lit(step), CUBE.size) for step in (0.0, 0.25, 0.0)]
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.displace(V("v"), CUBE, fields)), "v")


_PLACE = volume.Placed(CUBE, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, z, (3 - x)::INT AS y, (3 - y)::INT AS x, round(value, 4) AS v FROM v")
def canonical_exchange(spark, sf_dir):
    """A direction that exchanges x and y: canonical by an exchange of axes and mirrors."""
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.canonical(V("v"), _PLACE)), "v")


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, z, y, x, round(value, 4) AS v FROM v")
def canonical_there_and_back(spark, sf_dir):
    there = arrays(spark, sf_dir).withColumn("v", volume.canonical(V("v"), _PLACE))
    return cube_points(there.withColumn("v", volume.from_canonical(V("v"), _PLACE)), "v")


@query("WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, round(avg(v), 4) AS mean FROM s GROUP BY vec_id")
def volume_mean(spark, sf_dir):
    return rounded(arrays(spark, sf_dir).select("vec_id", pointwise.mean_of(V("v")).alias("mean")))


@query("SELECT event_type, round(avg(value), 4) AS value FROM events GROUP BY event_type")
def rank_means(spark, sf_dir):
    return rounded(losses.rank_means(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag <> l_linestatus)::INT AS differs FROM lineitem")
def disagreement_map(spark, sf_dir):
    return metrics.disagreement_map(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select("l_orderkey", "l_linenumber", "differs")


@query(f"WITH {VOX} SELECT vec_id, x, round((least(greatest(value, -0.2e0), 0.3e0) - 0.05e0) / 0.5e0, 4) AS value FROM vox")
def clip_normalize(spark, sf_dir):
    held = arrays(spark, sf_dir).withColumn("v", pointwise.clip_normalize(V("v"), -0.2, 0.3, 0.05, 0.5))
    return rounded(held.select("vec_id", F.posexplode("v").alias("x", "value")))


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, z, x, y FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, z, x ORDER BY value DESC, y) AS r FROM v) WHERE r = 1")
def graph_argmax(spark, sf_dir):
    held = arrays(spark, sf_dir).select("vec_id", graph.argmax(V("v"), CUBE, 1).alias("v"))
    flat = held.select("vec_id", F.posexplode("v").alias("i", "y"))
    return flat.select("vec_id", F.floor(V("i") / 4).cast("int").alias("z"), (V("i") % 4).cast("int").alias("x"), V("y").cast("int").alias("y"))


@query(f"WITH {VOX}, {CUBED}, h AS (SELECT * FROM v WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0), s AS (SELECT vec_id, z, y, x, 1 / (1 + exp(-(greatest(2 * value - 0.5 * value, 0) - greatest(-value + value * 1.5 + 0.1, 0)))) AS share FROM h) SELECT v.vec_id, v.z, v.y, v.x, round(v.value * s.share, 4) AS v FROM v JOIN s ON s.vec_id = v.vec_id AND s.z = v.z - v.z % 2 AND s.y = v.y - v.y % 2 AND s.x = v.x - v.x % 2")
def attention_gate(spark, sf_dir):
    """One channel gated by itself at half resolution, through two inner channels."""
    held = arrays(spark, sf_dir)
    low, _ = graph.select(V("v"), CUBE, [(0, 4, 2)] * 3)
    gated = held.withColumn("g", low).withColumn("v", graph.attention_gate(V("v"), V("g"), CUBE, [[2.0], [-1.0]], [[-0.5], [1.5]], [1.0, -1.0], ([0.0, 0.1], [0.0, 0.0], 0.0)))
    return cube_points(gated, "v")
