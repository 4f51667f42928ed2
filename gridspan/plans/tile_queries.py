"""Queries of tiled volumes: all of ``embeddings`` as one volume, a plane of 8 x 8 for each vector in the order of ids, which no row holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.operators import tiles
from gridspan.operators.tiles import Tiling
from gridspan.plans import chain
from gridspan.plans.catalogue import half_up, query, table

#: Voxels of the stack, by z, y and x.
STACK = "o AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS z, embedding FROM embeddings), s AS (SELECT z::INT AS z, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS value FROM o), v AS (SELECT z, (i // 8)::INT AS y, (i % 8)::INT AS x, value FROM s)"
TILE = (48, 5, 6)


def stack(spark, sf_dir):
    """Tiles of the stack and their tiling. A plane's place is its id's rank: ids are counted from their least one."""
    own = table(spark, sf_dir, "embeddings")
    n, least = own.agg(F.count("*"), F.min("vec_id")).first()
    tiling = Tiling((n, 8, 8), TILE)
    planes = own.select(F.lit(0).alias("case"), (F.col("vec_id") - F.lit(least)).alias("z"), F.col("embedding").alias("v"))
    return tiles.from_planes(planes, ["case"], "z", ["v"], tiling), tiling


def voxels(table_, tiling, *columns, digits=4):
    long = tiles.long_form(table_, ["case"], list(columns), tiling, ["z", "y", "x"])
    return long.select("z", "y", "x", *[half_up(F.col(c), digits).alias(c) for c in columns])


def _beside(name: str, source: str, value: str, merge: str) -> str:
    """Axis by axis, a merge over the window of a frame."""
    steps, held = [], source
    for k, (axis, others) in enumerate((("z", "y, x"), ("y", "z, x"), ("x", "z, y"))):
        steps.append(f"{name}{k} AS (SELECT z, y, x, {merge.format(v=value if k == 0 else 'value', w=f'OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS value FROM {held})")
        held = f"{name}{k}"
    return ", ".join(steps)


@query(f"WITH {STACK}, {_beside('d', 'v', '(value > 0.25)::INT', 'max({v}) {w}')} SELECT z, y, x, value::DOUBLE AS v FROM d2")
def tiled_dilate(spark, sf_dir):
    own, tiling = stack(spark, sf_dir)
    above = tiles.map_tiles(own, ["case"], ["v"], tiling, lambda x: [x - 0.25])
    return voxels(tiles.dilate(above, ["case"], "v", tiling, 2), tiling, "v")


_GRADIENT = "g AS (SELECT z, y, x, sqrt((1 / (1 + exp(-3 * dz))) ** 2 + (1 / (1 + exp(-3 * dy))) ** 2 + (1 / (1 + exp(-3 * dx))) ** 2) AS value FROM (SELECT z, y, x, {differences} FROM {source}))"


def _gradient(source: str) -> str:
    d = lambda axis, others: f"coalesce(lead(value) OVER (PARTITION BY {others} ORDER BY {axis}) - value, 0) AS d{axis}"
    return _GRADIENT.format(source=source, differences=", ".join((d("z", "y, x"), d("y", "z, x"), d("x", "z, y"))))


@query(f"WITH {STACK}, {_gradient('v')} SELECT z, y, x, round(value, 4) AS v FROM g")
def tiled_gradient(spark, sf_dir):
    own, tiling = stack(spark, sf_dir)
    return voxels(tiles.gradient(own, ["case"], "v", tiling), tiling, "v")


@query(f"WITH {STACK}, n AS (SELECT max(z) + 1 AS n FROM v), h AS (SELECT z, y, x, value, greatest(z - 1, 0) AS za, least(z + 1, n - 1) AS zb FROM v, n), a AS (SELECT h.z, h.y, h.x, (p.value + h.value + q.value) / 3 AS value FROM h JOIN v p ON p.z = h.za AND p.y = h.y AND p.x = h.x JOIN v q ON q.z = h.zb AND q.y = h.y AND q.x = h.x), b AS (SELECT a.z, a.y, a.x, (p.value + a.value + q.value) / 3 AS value FROM a JOIN a p ON p.z = a.z AND p.x = a.x AND p.y = greatest(a.y - 1, 0) JOIN a q ON q.z = a.z AND q.x = a.x AND q.y = least(a.y + 1, 7)) SELECT b.z, b.y, b.x, round((p.value + b.value + q.value) / 3, 4) AS v FROM b JOIN b p ON p.z = b.z AND p.y = b.y AND p.x = greatest(b.x - 1, 0) JOIN b q ON q.z = b.z AND q.y = b.y AND q.x = least(b.x + 1, 7)")
def tiled_box_mean(spark, sf_dir):
    own, tiling = stack(spark, sf_dir)
    return voxels(tiles.box_mean(own, ["case"], "v", tiling, 1), tiling, "v")


def _axis(name: str, source: str, target: str) -> str:
    """For each target place along an axis its two taps and their weights."""
    at = f"greatest((o + 0.5e0) * ({source} * 1e0 / {target}) - 0.5e0, 0e0)"
    return f"{name} AS (SELECT o, least(floor({at})::INT, {source} - 1) AS a, least(floor({at})::INT + 1, {source} - 1) AS b, least({at}, {source} - 1e0) - floor(least({at}, {source} - 1e0)) AS w FROM (SELECT unnest(range({target}))::INT AS o))"


@query(f"WITH {STACK}, n AS (SELECT (max(z) + 1)::INT AS n FROM v), {_axis('az', '(SELECT n FROM n)', '(SELECT n * 3 // 4 FROM n)')}, {_axis('ay', '8', '11')}, {_axis('ax', '8', '5')}, rz AS (SELECT az.o AS z, p.y, p.x, p.value * (1 - w) + q.value * w AS value FROM az JOIN v p ON p.z = az.a JOIN v q ON q.z = az.b AND q.y = p.y AND q.x = p.x), ry AS (SELECT p.z, ay.o AS y, p.x, p.value * (1 - w) + q.value * w AS value FROM ay JOIN rz p ON p.y = ay.a JOIN rz q ON q.y = ay.b AND q.z = p.z AND q.x = p.x) SELECT p.z, p.y, ax.o AS x, round(p.value * (1 - w) + q.value * w, 4) AS v FROM ax JOIN ry p ON p.x = ax.a JOIN ry q ON q.x = ax.b AND q.z = p.z AND q.y = p.y")
def tiled_resample(spark, sf_dir):
    own, tiling = stack(spark, sf_dir)
    target = Tiling((max(1, tiling.shape[0] * 3 // 4), 11, 5), (30, 4, 5))
    return voxels(tiles.resample(own, ["case"], "v", tiling, target), target, "v")


def _window_sums(value: str, name: str) -> str:
    """Sums over boxes of 7, at their first voxel."""
    steps, held = [], "w"
    for k, (axis, others) in enumerate((("z", "y, x"), ("y", "z, x"), ("x", "z, y"))):
        steps.append(f"{name}{k} AS (SELECT z, y, x, sum({value if k == 0 else 'value'}) OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS value FROM {held})")
        held = f"{name}{k}"
    return ", ".join(steps)


_M = {"p": "a", "q": "b", "pp": "a * a", "qq": "b * b", "pq": "a * b"}


@query(
    f"WITH {STACK}, w AS (SELECT v.z, v.y, v.x, v.value AS a, u.value AS b FROM v JOIN v u ON u.z = v.z AND u.y = 7 - v.y AND u.x = v.x), {', '.join(_window_sums(e, n) for n, e in _M.items())}, m AS (SELECT p2.value / 343 AS ux, q2.value / 343 AS uy, pp2.value / 343 AS xx, qq2.value / 343 AS yy, pq2.value / 343 AS xy FROM p2 JOIN q2 USING (z, y, x) JOIN pp2 USING (z, y, x) JOIN qq2 USING (z, y, x) JOIN pq2 USING (z, y, x) WHERE y <= 1 AND x <= 1 AND z <= (SELECT max(z) - 6 FROM v)), "
    "c AS (SELECT ux, uy, 343e0 / 342 * (xx - ux * ux) AS vx, 343e0 / 342 * (yy - uy * uy) AS vy, 343e0 / 342 * (xy - ux * uy) AS vxy FROM m) SELECT 0 AS \"case\", round(avg((2 * ux * uy + 0.0001e0) * (2 * vxy + 0.0009e0) / ((ux * ux + uy * uy + 0.0001e0) * (vx + vy + 0.0009e0))), 4) AS ssim FROM c"
)
def tiled_ssim(spark, sf_dir):
    own, tiling = stack(spark, sf_dir)
    mirrored = tiles.flip(own, ["case"], ["v"], tiling, (1,)).withColumnRenamed("v", "w")
    scored = tiles.structural_similarity(own.join(mirrored, ["case", "tile"]), ["case"], "v", "w", tiling, 1.0)
    return scored.select("case", half_up(F.col("ssim"), 4).alias("ssim"))


@query(f"WITH {STACK}, c AS (SELECT z, y, x, least(greatest(value, -0.2e0), 0.2e0) AS value FROM v), {_gradient('c')}, m AS (SELECT min(value) AS a, max(value) AS b FROM g) SELECT z + 1 AS z, y, 7 - x AS x, round(2 * (value - a) / (b - a) - 1, 4) AS v FROM g, m UNION ALL SELECT 0 AS z, y, 7 - x, round(2 * (value - a) / (b - a) - 1, 4) FROM g, m WHERE z = 1")
def tiled_chain(spark, sf_dir):
    """Clipped and differentiated in one exchange, normalised by the whole volume's ends, mirrored, and padded by a reflected plane."""
    own, tiling = stack(spark, sf_dir)
    steps = chain.from_config([{"Clip": {"min_value": -0.2, "max_value": 0.2}}, {"Gradient": {}}, {"Normalize": {}}, {"Flip": {"dims": [2]}}, {"Padding": {"before": [1, 0, 0], "after": [0, 0, 0], "mode": "reflect"}}])
    done, out = steps.apply_tiles(own, ["case"], "v", tiling)
    return voxels(done, out, "v")


@query(f"WITH {STACK} SELECT 0 AS \"case\", round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM v")
def tiled_statistics(spark, sf_dir):
    own, tiling = stack(spark, sf_dir)
    return tiles.statistics(own, ["case"], "v", tiling).select("case", *[half_up(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std")])
