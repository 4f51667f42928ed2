"""Queries of volumes with three axes, their patches, warps and copies: cubes of 4 x 4 x 4 from ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspan.operators import augment, histograms, intervals, metrics, pointwise, volume
from gridspan.plans import chain, graph
from gridspan.plans.catalogue import CUBE, CUBED, VOX, arrays, beside, bell, copies, cube_points, draw, query, rounded, table

V = F.col


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, (3 - z)::INT AS z, y, (3 - x)::INT AS x, round(value, 4) AS v FROM v")
def volume_flip(spark, sf_dir):
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.flip(V("v"), CUBE, (0, 2))), "v")


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, x AS z, z AS y, y AS x, round(value, 4) AS v FROM v")
def volume_permute(spark, sf_dir):
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.permute(V("v"), CUBE, (2, 0, 1))), "v")


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, z - 1 AS z, y, x - 2 AS x, round(value, 4) AS v FROM v WHERE z BETWEEN 1 AND 2 AND x >= 2")
def volume_crop(spark, sf_dir):
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.crop(V("v"), CUBE, (1, 0, 2), (3, 4, 4))), "v", grid=volume.Grid((2, 4, 2)))


def _pad_sql(place: str) -> str:
    axis = lambda n, before, name: f"{name} AS (SELECT range::INT AS o, {place.format(c=f'(range - {before})')} AS s FROM range({n}))"
    return f"WITH {VOX}, {CUBED}, {axis(5, 1, 'az')}, {axis(5, 0, 'ay')}, {axis(7, 2, 'ax')} SELECT v.vec_id, az.o AS z, ay.o AS y, ax.o AS x, round(v.value, 4) AS v FROM az, ay, ax, v WHERE v.z = az.s AND v.y = ay.s AND v.x = ax.s"


@query(_pad_sql("(CASE WHEN {c} < 0 THEN -{c} WHEN {c} > 3 THEN 6 - {c} ELSE {c} END)"))
def volume_pad_reflect(spark, sf_dir):
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.pad(V("v"), CUBE, (1, 0, 2), (0, 1, 1), "reflect")), "v", grid=volume.Grid((5, 5, 7)))


@query(_pad_sql("least(greatest({c}, 0), 3)"))
def volume_pad_replicate(spark, sf_dir):
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.pad(V("v"), CUBE, (1, 0, 2), (0, 1, 1), "replicate")), "v", grid=volume.Grid((5, 5, 7)))


def _taps(name: str, n: int, m: int) -> str:
    """(o, s, w): the source voxels of each output voxel along an axis, and their weights."""
    return f"{name}p AS (SELECT range::INT AS o, greatest({n}e0 / {m} * (range + 0.5e0) - 0.5e0, 0) AS p FROM range({m})), {name} AS (SELECT o, floor(p)::INT AS s, 1 - (p - floor(p)) AS w FROM {name}p UNION ALL SELECT o, least(floor(p)::INT + 1, {n - 1}), p - floor(p) FROM {name}p)"


@query(f"WITH {VOX}, {CUBED}, {_taps('tz', 4, 3)}, {_taps('ty', 4, 5)}, {_taps('tx', 4, 6)} SELECT v.vec_id, tz.o AS z, ty.o AS y, tx.o AS x, round(sum(tz.w * ty.w * tx.w * v.value), 4) AS v FROM v JOIN tz ON tz.s = v.z JOIN ty ON ty.s = v.y JOIN tx ON tx.s = v.x GROUP BY ALL")
def volume_resample_linear(spark, sf_dir):
    out = volume.Grid((3, 5, 6))
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.resample(V("v"), CUBE, out)), "v", grid=out)


@query(f"WITH {VOX}, {CUBED}, o AS (SELECT a.range::INT AS z, b.range::INT AS y, c.range::INT AS x FROM range(2) a, range(8) b, range(4) c) SELECT v.vec_id, o.z, o.y, o.x, round(v.value, 4) AS v FROM o JOIN v ON v.z = o.z * 2 AND v.y = o.y // 2 AND v.x = o.x")
def volume_resample_resolution(spark, sf_dir):
    # Spacing 1 x 2 x 1.5 (x, y, z) to 1 x 1 x 3: 2 planes, 8 rows, 4 columns.
    out = volume.grid_of_spacing(CUBE, [1.0, 2.0, 1.5], [0.0, 1.0, 3.0])
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.resample(V("v"), CUBE, out, labels=True)), "v", grid=out)


@query(f"WITH {VOX}, {CUBED}, b AS (SELECT a.vec_id, a.z, a.y, a.x, avg(v.value) AS m FROM v a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) i CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) j CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) k JOIN v ON v.vec_id = a.vec_id AND v.z = least(greatest(a.z + i.d, 0), 3) AND v.y = least(greatest(a.y + j.d, 0), 3) AND v.x = least(greatest(a.x + k.d, 0), 3) GROUP BY ALL) SELECT vec_id, z, y, x, round(m, 4) AS v FROM b")
def volume_box_mean(spark, sf_dir):
    return cube_points(arrays(spark, sf_dir).withColumn("v", volume.box_mean(V("v"), CUBE, 1)), "v")


_PAIRED = "s AS (SELECT a.vec_id, unnest(range(64)) AS i, unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), q AS (SELECT vec_id, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, a, b FROM s)"


@query(f"WITH {_PAIRED}, c AS (SELECT e.range AS cz, f.range AS cy, g.range AS cx FROM range(2) e, range(2) f, range(2) g), w AS (SELECT vec_id, cz, cy, cx, avg(a) AS mx, avg(b) AS my, avg(a * a) AS xx, avg(b * b) AS yy, avg(a * b) AS xy FROM q JOIN c ON z BETWEEN cz AND cz + 2 AND y BETWEEN cy AND cy + 2 AND x BETWEEN cx AND cx + 2 GROUP BY ALL) SELECT vec_id, round(avg((2 * mx * my + 0.0004e0) * (2 * 27e0 / 26 * (xy - mx * my) + 0.0036e0) / ((mx * mx + my * my + 0.0004e0) * (27e0 / 26 * (xx - mx * mx + yy - my * my) + 0.0036e0))), 4) AS ssim FROM w GROUP BY vec_id")
def volume_ssim(spark, sf_dir):
    return rounded(beside(spark, sf_dir, 1).select("vec_id", volume.structural_similarity(V("v0"), V("v1"), CUBE, 2.0, 3).alias("ssim")))


@query("WITH e AS (SELECT o_orderkey, [(o_orderkey % 9 + 1)::INT, (o_orderkey % 7 + 3)::INT, 5] AS shape FROM orders), p AS (SELECT *, [least(4, shape[1]), shape[2], 3] AS p FROM e), n AS (SELECT *, CASE WHEN shape[1] <= p[1] THEN 1 ELSE ceil((shape[1] - p[1]) / (p[1] - 1.0))::INT + 1 END AS a, 2 AS c FROM p), g AS (SELECT *, unnest(range(a * c)) AS k FROM n) SELECT o_orderkey, k AS patch_idx, ((k // c) * (p[1] - 1))::INT AS z0, 0 AS y0, ((k % c) * 2)::INT AS x0, least((k // c) * (p[1] - 1) + p[1], shape[1])::INT AS z1, shape[2]::INT AS y1, least((k % c) * 2 + 3, 5)::INT AS x1 FROM g")
def volume_patch_grid(spark, sf_dir):
    shape = F.array((V("o_orderkey") % 9 + 1).cast("int"), (V("o_orderkey") % 7 + 3).cast("int"), F.lit(5))
    grid = volume.patch_grid(table(spark, sf_dir, "orders"), ["o_orderkey"], shape, F.array(F.lit(4), F.lit(0), F.lit(3)), F.array(F.lit(1), F.lit(0), F.lit(1)))
    return grid.select("o_orderkey", "patch_idx", *[F.get(c, F.lit(k)).alias(f"{a}{n}") for n, c in enumerate(("start", "stop")) for k, a in enumerate("zyx")])


_CELLS = "k AS (SELECT a.range AS i, b.range AS j, c.range AS l, a.range * 4 + b.range * 2 + c.range AS k FROM range(2) a, range(2) b, range(2) c), off AS (SELECT a.range AS oz, b.range AS oy, c.range AS ox FROM range(3) a, range(3) b, range(3) c)"


@query(f"WITH {VOX}, {CUBED}, {_CELLS}, t AS (SELECT e.vec_id, k, oz, oy, ox, i * 2 + oz AS z, j * 2 + oy AS y, l * 2 + ox AS x FROM (SELECT vec_id FROM embeddings) e, k, off) SELECT t.vec_id, t.k::BIGINT AS patch_idx, (oz * 9 + oy * 3 + ox)::INT AS offset, round(coalesce(v.value, -2.0), 4) AS value FROM t LEFT JOIN v ON v.vec_id = t.vec_id AND v.z = t.z AND v.y = t.y AND v.x = t.x")
def volume_patch_extract(spark, sf_dir):
    p = volume.patches(arrays(spark, sf_dir), ["vec_id"], "v", CUBE, (3, 3, 3), (1, 1, 1), -2.0)
    return rounded(p.select("vec_id", V("patch_idx").cast("long").alias("patch_idx"), F.posexplode("v").alias("offset", "value")))


def _blended(kind):
    def run(spark, sf_dir):
        p = volume.patches(arrays(spark, sf_dir), ["vec_id"], "v", CUBE, (3, 3, 3), (1, 1, 1), 0.0).withColumn("v", F.transform("v", lambda x: x + F.col("patch_idx")))
        return cube_points(volume.blend(p, ["vec_id"], "v", CUBE, (3, 3, 3), (1, 1, 1), kind), "v")

    return run


_HELD = f"{_CELLS}, h AS (SELECT v.vec_id, v.z, v.y, v.x, k, v.value + k AS value, oz, oy, ox FROM v, k, off WHERE v.z = i * 2 + oz AND v.y = j * 2 + oy AND v.x = l * 2 + ox)"
_RAMP = "(CASE WHEN {o} = 1 THEN 1 ELSE sin(0.5e0 * pi() / 2) ** 2 END)"
_BELL = "exp(-(({o} - 1) ** 2) / (2 * 0.375e0 * 0.375e0))"
for _kind, _w in (("cosinus", _RAMP), ("gaussian", _BELL)):
    _weight = " * ".join(_w.format(o=o) for o in ("oz", "oy", "ox"))
    _f = _blended(_kind)
    _f.__name__ = f"volume_blend_{_kind}"
    query(f"WITH {VOX}, {CUBED}, {_HELD} SELECT vec_id, z, y, x, round(sum({_weight} * value) / sum({_weight}), 4) AS v FROM h GROUP BY vec_id, z, y, x")(_f)
_f = _blended(None)
_f.__name__ = "volume_blend_last"
query(f"WITH {VOX}, {CUBED}, {_HELD} SELECT vec_id, z, y, x, round(arg_max(value, k), 4) AS v FROM h GROUP BY vec_id, z, y, x")(_f)


def _linear(z: str, y: str, x: str) -> str:
    """Trilinear taps at fractional places of the cube, all inside."""
    taps = []
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                w = " * ".join(f"({c} - floor({c}))" if d else f"(1 - ({c} - floor({c})))" for c, d in ((z, dz), (y, dy), (x, dx)))
                taps.append(f"{w} * coalesce(v[((floor({z}) + {dz}) * 16 + (floor({y}) + {dy}) * 4 + floor({x}) + {dx})::INT + 1], 0)")
    return " + ".join(taps)


def _mirrored(c: str) -> str:
    return f"(CASE WHEN floor(abs({c}) / 3)::INT % 2 = 0 THEN abs({c}) % 3 ELSE 3 - abs({c}) % 3 END)"


_COPIED = "c AS (SELECT vec_id, unnest(range(3)) AS copy, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id, copy, unnest(range(64)) AS i, v FROM c), g AS (SELECT *, (i // 16)::INT AS z, (i // 4 % 4)::INT AS y, (i % 4)::INT AS x FROM d)"


def _copy_points(df):
    flat = df.select("vec_id", "copy", F.posexplode("v").alias("i", "value"))
    return rounded(flat.select("vec_id", "copy", *[c.alias(a) for c, a in zip(CUBE.coordinates(V("i")), "zyx", strict=True)], "value"))


@query(f"WITH {_COPIED}, s AS (SELECT *, 2 ** (0.2e0 * {bell(10)}) AS f FROM g), u AS (SELECT *, ((z / 1.5e0 - 1) * f + 1) * 1.5e0 AS pz, ((y / 1.5e0 - 1) * f + 1) * 1.5e0 AS py, ((x / 1.5e0 - 1) * f + 1) * 1.5e0 AS px FROM s), m AS (SELECT *, {_mirrored('pz')} AS qz, {_mirrored('py')} AS qy, {_mirrored('px')} AS qx FROM u) SELECT vec_id, copy, z, y, x, round({_linear('qz', 'qy', 'qx')}, 4) AS value FROM m")
def augment_scale(spark, sf_dir):
    c = copies(spark, sf_dir).withColumn("f", F.pow(F.lit(2.0), augment.normal(V("vec_id"), V("copy"), 10) * 0.2))
    return _copy_points(c.withColumn("v", augment.euler(V("v"), CUBE, augment.scaling(V("f"), 3))))


@query(f"WITH {_COPIED}, s AS (SELECT *, {draw(12)} * 4 - 2 AS t FROM g), m AS (SELECT *, {_mirrored('(x + t)')} AS qx FROM s) SELECT vec_id, copy, z, y, x, round({_linear('z::DOUBLE', 'y::DOUBLE', 'qx')}, 4) AS value FROM m")
def augment_shift(spark, sf_dir):
    c = copies(spark, sf_dir).withColumn("t", augment.between(V("vec_id"), V("copy"), 12, -2.0, 2.0))
    return _copy_points(c.withColumn("v", augment.euler(V("v"), CUBE, augment.translation([V("t"), F.lit(0.0), F.lit(0.0)], CUBE))))


@query(f"WITH {_COPIED} SELECT vec_id, copy, (3 - y)::INT AS z, z AS y, x, round(v[i + 1], 4) AS value FROM g")
def augment_quarter_turn(spark, sf_dir):
    c = copies(spark, sf_dir)
    return _copy_points(c.withColumn("v", augment.quarter_turn(V("v"), CUBE, (0, 1), 1)[0]))


_RGB = "c AS (SELECT vec_id, unnest(range(3)) AS copy, embedding::DOUBLE[] AS v FROM embeddings), g AS (SELECT vec_id, copy, unnest(range(21)) AS i, v FROM c), p AS (SELECT *, v[i + 1] AS r, v[i + 22] AS gr, v[i + 43] AS b FROM g)"


@query(f"WITH {_RGB}, s AS (SELECT *, 2 ** (0.3e0 * {bell(14)}) AS f, (r + gr + b) / 3 AS m FROM p) SELECT vec_id, copy, i::INT AS i, round(m + f * (r - m), 4) AS red, round(m + f * (b - m), 4) AS blue FROM s")
def augment_saturation(spark, sf_dir):
    c = copies(spark, sf_dir).withColumn("v", augment.colour(F.slice("v", 1, 63), 3, augment.saturation(F.pow(F.lit(2.0), augment.normal(V("vec_id"), V("copy"), 14) * 0.3))))
    flat = c.select("vec_id", "copy", F.posexplode(F.arrays_zip(F.slice("v", 1, 21).alias("red"), F.slice("v", 43, 21).alias("blue"))).alias("i", "s"))
    return rounded(flat.select("vec_id", "copy", "i", "s.red", "s.blue"))


@query(f"WITH {_RGB}, s AS (SELECT *, ({draw(16)} * 2 - 1) * pi() * 0.25e0 AS t, (r + gr + b) / 3 AS m FROM p) SELECT vec_id, copy, i::INT AS i, round(cos(t) * r + (1 - cos(t)) * m + sin(t) / sqrt(3e0) * (b - gr), 4) AS red FROM s")
def augment_hue(spark, sf_dir):
    angle = (augment.uniform(V("vec_id"), V("copy"), 16) * 2 - 1) * math.pi * 0.25
    c = copies(spark, sf_dir).withColumn("v", augment.colour(F.slice("v", 1, 63), 3, augment.hue(angle)))
    return rounded(c.select("vec_id", "copy", F.posexplode(F.slice("v", 1, 21)).alias("i", "red")))


@query(f"WITH {_RGB}, s AS (SELECT *, floor({draw(18)} * 2) AS f, (r + gr + b) / 3 AS m FROM p) SELECT vec_id, copy, i::INT AS i, round(r - 2 * f * m, 4) AS red FROM s")
def augment_luma_flip(spark, sf_dir):
    flipped = F.floor(augment.uniform(V("vec_id"), V("copy"), 18) * 2)
    c = copies(spark, sf_dir).withColumn("v", augment.colour(F.slice("v", 1, 63), 3, augment.luma_flip(flipped)))
    return rounded(c.select("vec_id", "copy", F.posexplode(F.slice("v", 1, 21)).alias("i", "red")))


@query(f"WITH {_COPIED} SELECT vec_id, copy, z, y, x, round(CASE WHEN abs((z + 0.5e0) / 4 - {draw(20)}) < 0.25e0 AND abs((y + 0.5e0) / 4 - {draw(21)}) < 0.25e0 AND abs((x + 0.5e0) / 4 - {draw(22)}) < 0.25e0 THEN -9 ELSE v[i + 1] END, 4) AS value FROM g")
def augment_cut_box(spark, sf_dir):
    centre = [augment.uniform(V("vec_id"), V("copy"), s) for s in (20, 21, 22)]
    drawn = copies(spark, sf_dir).withColumns({f"c{k}": c for k, c in enumerate(centre)})
    return _copy_points(drawn.withColumn("v", augment.cut_box(V("v"), CUBE, [V(f"c{k}") for k in range(3)], 0.5, -9.0)))


@query("WITH c AS (SELECT vec_id, unnest(range(4)) AS k, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, k, floor(v[k + 1] * 2)::INT % 3 AS a, floor(v[k + 5] * 2)::INT % 4 AS b, floor(v[k + 9] * 2)::INT % 3 AS c FROM c) SELECT vec_id, k::INT AS i, (CASE WHEN c <> 0 THEN c + 5 WHEN b <> 0 THEN b + 2 ELSE a END)::INT AS merged, (a + CASE WHEN b <> 0 THEN b + 2 ELSE 0 END + CASE WHEN c <> 0 THEN c + 3 ELSE 0 END)::INT AS summed FROM m")
def label_merge_arrays(spark, sf_dir):
    part = lambda start, n: F.transform(F.slice("v", start, 4), lambda x: (F.floor(x * 2).cast("int") % n))
    e = arrays(spark, sf_dir).select("vec_id", F.concat(part(1, 3), part(5, 4), part(9, 3)).alias("l"))
    both = F.arrays_zip(pointwise.merge_labels(V("l"), [3, 4, 3]).alias("merged"), pointwise.sum_labels(V("l"), 3, [3, 4, 3]).alias("summed"))
    return e.select("vec_id", F.posexplode(both).alias("i", "s")).select("vec_id", "i", V("s.merged").cast("int").alias("merged"), V("s.summed").cast("int").alias("summed"))


@query("WITH s AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS v, unnest(b.embedding)::DOUBLE AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), k AS (SELECT vec_id, avg(v) AS m, stddev_samp(v) AS s FROM s WHERE m > 0 GROUP BY 1), x AS (SELECT a.vec_id, unnest(range(64))::INT AS x, unnest(a.embedding)::DOUBLE AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT x.vec_id, x.x, round((value - k.m) / k.s, 4) AS value FROM x JOIN k USING (vec_id)")
def standardize_masked(spark, sf_dir):
    mask = F.transform("v1", lambda m: (m > 0).cast("int"))
    b = beside(spark, sf_dir, 1).withColumn("v", pointwise.standardize(V("v0"), mask))
    return rounded(b.select("vec_id", F.posexplode("v").alias("x", "value")))


@query(f"WITH {VOX}, {CUBED}, f AS (SELECT vec_id, z, y, x, round(2 * (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) + -1, 4) AS value FROM v WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, x AS z, y, (3 - z)::INT AS x, value AS v FROM f")
def chain_apply(spark, sf_dir):
    steps = chain.from_config([{"Normalize": {}}, {"Flip": {"dims": [0]}}, {"Permute": {"dims": [2, 1, 0]}}])
    return cube_points(steps.apply(arrays(spark, sf_dir), "v", CUBE), "v")


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, z, y, x, round(value, 4) AS v FROM v")
def chain_undo(spark, sf_dir):
    steps = chain.from_config([{"Flip": {"dims": [0, 1]}}, {"Padding": {"before": [1, 0, 2], "after": [0, 1, 0]}}, {"Permute": {"dims": [1, 2, 0]}}])
    there = steps.apply(arrays(spark, sf_dir), "v", CUBE)
    return cube_points(steps.undo(there, "v", CUBE), "v")


@query("WITH s AS (SELECT a.vec_id, unnest(range(64))::INT AS x, unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, x, round(-((a + b) * a), 4) AS value FROM s")
def graph_branches(spark, sf_dir):
    flow = graph.Flow((graph.Node("sum", graph.add, ("left", "right"), "both"), graph.Node("scaled", graph.multiply, ("both", "0"), "both"), graph.Node("minus", graph.negative, ("both",), "out")))
    b = flow.run(beside(spark, sf_dir, 1), {"left": "v0", "right": "v1"})
    return rounded(b.select("vec_id", F.posexplode("branch_out").alias("x", "value")))


@query(f"WITH {VOX}, {CUBED} SELECT vec_id, (z // 2)::INT AS z, (y // 2)::INT AS y, (x // 4)::INT AS x, round(max(value), 4) AS most, round(avg(value), 4) AS mean FROM v GROUP BY ALL")
def graph_pool(spark, sf_dir):
    most, grid = graph.pool(V("v"), CUBE, (2, 2, 4))
    return cube_points(arrays(spark, sf_dir).withColumns({"most": most, "mean": graph.pool(V("v"), CUBE, (2, 2, 4), "mean")[0]}), "most", "mean", grid=grid)


@query(f"WITH {VOX}, {CUBED} SELECT a.vec_id, a.z, a.y, a.x, round(sum((CASE WHEN b.z = a.z THEN 2 ELSE 0.5 END) * (CASE WHEN b.x = a.x THEN 1 ELSE -0.25 END) * b.value) + 0.1, 4) AS v FROM v a JOIN v b ON b.vec_id = a.vec_id AND abs(a.z - b.z) <= 1 AND a.y = b.y AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def graph_convolve(spark, sf_dir):
    kernel = [[[a * b for b in (-0.25, 1.0, -0.25)]] for a in (0.5, 2.0, 0.5)]
    return cube_points(arrays(spark, sf_dir).withColumn("v", graph.convolve(V("v"), CUBE, kernel, 0.1)), "v")


@query("WITH t AS (SELECT vec_id, unnest(range(4)) AS t, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id, q.t, k.t AS s, list_sum(list_transform(range(1, 5), lambda j: q.v[q.t * 4 + j] * q.v[16 + k.t * 4 + j])) / 2 AS score, q.v AS v FROM t q JOIN t k USING (vec_id)), w AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id, t) AS w FROM p), o AS (SELECT vec_id, t, unnest(range(4)) AS j, s, w, v FROM w) SELECT vec_id, (t * 4 + j)::INT AS i, round(sum(w * v[32 + s * 4 + j + 1]), 4) AS value FROM o GROUP BY ALL")
def graph_attention(spark, sf_dir):
    q, k, v = (F.slice("v", a, 16) for a in (1, 17, 33))
    e = arrays(spark, sf_dir).withColumns({"q": q, "k": k, "w": v})
    return rounded(e.select("vec_id", F.posexplode(graph.attention(V("q"), V("k"), V("w"), 4, 4)).alias("i", "value")))


@query("WITH s AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), g AS (SELECT vec_id, i.range AS i, j.range AS j, list_sum(list_transform(range(1, 17), lambda k: a[i.range * 16 + k] * a[j.range * 16 + k])) / 64 AS x, list_sum(list_transform(range(1, 17), lambda k: b[i.range * 16 + k] * b[j.range * 16 + k])) / 64 AS y FROM s, range(4) i, range(4) j) SELECT vec_id, round(sum(abs(x - y)), 4) AS loss FROM g GROUP BY vec_id")
def gram_loss(spark, sf_dir):
    return rounded(beside(spark, sf_dir, 1).select("vec_id", pointwise.gram_distance(V("v0"), V("v1"), 4).alias("loss")))


@query("WITH v AS (SELECT (vec_id % 5)::INT AS grp, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE label END AS target, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE (vec_id * 7 % 10)::INT END AS output FROM embeddings), l AS (SELECT range AS label FROM range(10)), c AS (SELECT grp, label, sum((target = label)::INT) AS t, sum((output = label)::INT) AS o, sum((target = label AND output = label)::INT) AS c FROM v, l WHERE label IN (2, 3, 4) GROUP BY ALL), d AS (SELECT grp, (2 * c + 1e-6) / (o + t + 1e-6) AS dice FROM c WHERE t > 0) SELECT grp, round(1 - avg(dice), 6) AS loss FROM d GROUP BY grp")
def dice_loss_masked(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select((V("vec_id") % 5).cast("int").alias("grp"), V("label").alias("target"), (V("vec_id") * 7 % 10).cast("int").alias("output"), (V("vec_id") % 3 != 0).cast("int").alias("mask"))
    return rounded(metrics.dice_loss(metrics.dice(v, ["grp"], "output", "target", "mask", [2, 3, 4]), ["grp"]), 6)


@query("WITH p AS (SELECT l_returnflag, l_linestatus, sum(abs(l_quantity * p_retailprice - l_extendedprice)) AS a, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT l_returnflag, sum(n)::BIGINT AS n, round(sum(a) / sum(n), 4) AS mae FROM p GROUP BY 1")
def metric_partials(spark, sf_dir):
    from gridspan.plans.catalogue import pairs

    parts = metrics.partial_regression(pairs(spark, sf_dir), ["l_returnflag"], "l_linestatus", V("output"), V("target"))
    return rounded(metrics.combine_regression(parts, ["l_returnflag"]).select("l_returnflag", "n", "mae"))


@query("WITH v AS (SELECT (vec_id % 7)::INT AS grp, embedding::DOUBLE[] AS v, label FROM embeddings), l AS (SELECT grp, label + 1 AS w, v[label + 1] - ln(list_sum(list_transform(v[1:10], lambda x: exp(x)))) AS lp FROM v) SELECT grp, round(sum(-lp * w) / sum(w), 4) AS loss FROM l GROUP BY grp")
def cross_entropy_weighted(spark, sf_dir):
    e = arrays(spark, sf_dir).withColumn("grp", (V("vec_id") % 7).cast("int"))
    return rounded(metrics.weighted_cross_entropy(e, ["grp"], F.slice("v", 1, 10), V("label"), [float(k + 1) for k in range(10)]))



@query(f"WITH {VOX}, {CUBED} SELECT vec_id, z, y, x, round(value, 4) AS v, 3::BIGINT AS attributes FROM v")
def chain_undo_statistics(spark, sf_dir):
    """Normalised, standardised and padded, each pushing what it saw, and undone by popping it: the volume and its own attributes are back."""
    steps = chain.from_config([{"Normalize": {}}, {"Standardize": {}}, {"Padding": {"before": [1, 0, 2], "after": [0, 1, 0]}}, {"Normalize": {"min_value": 0.0, "max_value": 5.0}}])
    own = arrays(spark, sf_dir).withColumn("attributes", F.create_map(*[F.lit(x) for k, v in {"Origin": "[0 0 0]", "Spacing": "[1 1 2]", "Direction": "[1 0 0 0 1 0 0 0 1]"}.items() for x in (k, v)]))
    own = own.withColumn("attributes", F.transform_values("attributes", lambda _, v: F.array(v)))
    back = steps.undo_recorded(steps.apply_recorded(own, "v", CUBE), "v", CUBE)
    held = back.select("vec_id", F.size(F.flatten(F.map_values("attributes"))).cast("long").alias("attributes"))
    return cube_points(back, "v").join(held, "vec_id")


def _knots_sql(name: str, value: str) -> str:
    """Least value, mean, the middle of the values above the mean by 256 bins, and greatest value of a column."""
    return (
        f"e{name} AS (SELECT vec_id, min({value}) AS k0, avg({value}) AS k1, max({value}) AS k3 FROM s GROUP BY vec_id), "
        f"b{name} AS (SELECT vec_id, least(floor(({value} - k1) / ((k3 - k1) / 256)), 255) AS bin, count(*) AS c FROM s JOIN e{name} USING (vec_id) WHERE {value} >= k1 GROUP BY 1, 2), "
        f"u{name} AS (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY vec_id) AS total FROM b{name}), "
        f"k{name} AS (SELECT vec_id, k0, k1, k1 + (bin + (total * 0.5e0 - (upto - c)) / c) * (k3 - k1) / 256 AS k2, k3 FROM u{name} JOIN e{name} USING (vec_id) WHERE upto >= total * 0.5e0 AND upto - c < total * 0.5e0)"
    )


def _segment(j: int) -> str:
    return f"q.k{j} + (a - p.k{j}) / (p.k{j + 1} - p.k{j}) * (q.k{j + 1} - q.k{j})"


@query(
    "WITH s AS (SELECT a.vec_id, unnest(range(64))::INT AS x, unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), "
    f"{_knots_sql('a', 'a')}, {_knots_sql('b', 'b')} SELECT s.vec_id, x, round(CASE WHEN a >= p.k3 THEN q.k3 WHEN a >= p.k2 THEN {_segment(2)} WHEN a >= p.k1 THEN {_segment(1)} ELSE {_segment(0)} END, 4) AS value FROM s JOIN ka p USING (vec_id) JOIN kb q USING (vec_id)"
)
def histogram_match(spark, sf_dir):
    """Each vector's values matched to the next one's by histograms of 256 levels, counted over rows of voxels."""
    both = beside(spark, sf_dir, 1)
    long = lambda c: both.select("vec_id", F.posexplode(c).alias("x", "value"))
    return rounded(histograms.match(long("v0"), long("v1"), ["vec_id"], "value"))


_SPANS = "i AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 60000000::BIGINT * (1 + CASE WHEN event_id % 50 = 0 THEN 50000 WHEN event_id % 7 = 0 THEN 900 ELSE 0 END) AS b FROM events)"


@query(f"WITH {_SPANS} SELECT l.event_id, count(*) AS met, sum(r.event_id)::BIGINT AS ids FROM i l JOIN i r ON l.user_id = r.user_id AND l.a < r.b AND r.a < l.b GROUP BY l.event_id")
def interval_join(spark, sf_dir):
    """Spans of a user's events, from a minute to a month, and the spans that each overlaps, its own included."""
    events = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    long = F.when(F.col("event_id") % 50 == 0, 50_000).when(F.col("event_id") % 7 == 0, 900).otherwise(0)
    left = events.select("user_id", "event_id", start.alias("a"), (start + (long + 1).cast("long") * 60_000_000).alias("b"))
    right = left.select("user_id", F.col("event_id").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = intervals.overlapping(left, right, ["user_id"], [intervals.Axis(("a", "b"), ("c", "d"))])
    return met.groupBy("event_id").agg(F.count("*").alias("met"), F.sum("other").alias("ids"))
