"""Interval joins, histogram matching, stored transforms and their inverses, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import augment, histograms, intervals, tiles, volume
from gridspan.operators.intervals import Axis
from gridspan.operators.tiles import Tiling


@pytest.mark.parametrize("sizes", [None, [1.0, 1.0], [500.0, 2.0]])
def test_boxes_overlap_once(spark, sizes):
    """Skewed extents from a point to everything, negative places, a crowded cell, empty boxes and nulls."""
    rng = np.random.default_rng(1)

    def boxes(n, offset):
        out = []
        for i in range(n):
            a = rng.integers(-300, 300, 2) if i % 3 else np.array([5, 5])
            b = a + np.maximum(0, (10.0 ** rng.uniform(-0.3, 3, 2)).astype(int))
            out.append((offset + i, int(i % 2) if i % 11 else None, float(a[0]), float(b[0]), float(a[1]), float(b[1])))
        return [*out, (offset + n, 1, None, 3.0, 0.0, 3.0)]

    left, right = boxes(120, 0), boxes(90, 1000)
    a = spark.createDataFrame(left, "i long, k int, x0 double, x1 double, y0 double, y1 double")
    b = spark.createDataFrame(right, "j long, k int, u0 double, u1 double, v0 double, v1 double")
    got = sorted(tuple(r) for r in intervals.overlapping(a, b, ["k"], [Axis(("x0", "x1"), ("u0", "u1")), Axis(("y0", "y1"), ("v0", "v1"))], sizes).select("i", "j").collect())
    over = lambda s, t: None not in (s[2], t[2]) and all(s[c] < t[c + 1] and t[c] < s[c + 1] and s[c] < s[c + 1] and t[c] < t[c + 1] for c in (2, 4))
    assert got == sorted((s[0], t[0]) for s in left for t in right if s[1] is not None and s[1] == t[1] and over(s, t)) and len(got) > 200


def test_no_cartesian_plan(spark, capsys):
    a = spark.createDataFrame([(1, 0, 3), (1, 2, 900)], "k int, a int, b int")
    df = intervals.overlapping(a, a.select("k", F.col("a").alias("c"), F.col("b").alias("d")), ["k"], [Axis(("a", "b"), ("c", "d"))])
    df.explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan and df.count() == 4
    assert intervals.overlapping(a.limit(0), a.select("k", F.col("a").alias("c"), F.col("b").alias("d")), ["k"], [Axis(("a", "b"), ("c", "d"))]).count() == 0


def plain_match(x, r, levels=256, points=1):
    def knots(v):
        v = v[~np.isnan(v)]
        mean, most = v.mean(), v.max()
        if most == mean:
            return np.array([v.min(), mean, *[mean] * points, most])
        counts, edges = np.histogram(v[v >= mean], levels, (mean, most))
        upto = np.cumsum(counts)
        inner = []
        for j in range(points):
            need = upto[-1] * (j + 1) / (points + 1)
            b = int(np.searchsorted(upto, need))
            inner.append(edges[b] + (need - upto[b] + counts[b]) / counts[b] * (edges[b + 1] - edges[b]))
        return np.array([v.min(), mean, *inner, most])

    return np.interp(x, knots(x), knots(r))


@pytest.mark.parametrize("levels, points", [(256, 1), (8, 3)])
def test_histograms_match(spark, levels, points):
    rng = np.random.default_rng(2)
    shape = (5, 6, 7)
    a, b = {k: rng.normal(size=210) ** 3 for k in "pq"}, {k: rng.exponential(size=210) for k in "pq"}
    make = lambda d: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], "case string, v array<double>")
    long = lambda df: df.select("case", F.posexplode("v").alias("i", "v"))
    out = histograms.match(long(make(a)), long(make(b)), ["case"], "v", levels, points)
    got = {k: np.zeros(210) for k in a}
    for r in out.collect():
        got[r["case"]][r["i"]] = r["v"]
    tiling, other = Tiling(shape, (2, 4, 7)), Tiling((210,), (50,))
    cut, ref = tiles.cut_rows(make(a), ["case"], ["v"], tiling), tiles.cut_rows(make(b), ["case"], ["v"], other)
    tiled = {r["case"]: np.array(r["v"]) for r in tiles.joined_rows(histograms.match_tiles(cut, ref, ["case"], "v", tiling, other, levels, points), ["case"], ["v"], tiling).collect()}
    for k in a:
        want = plain_match(a[k], b[k], levels, points)
        np.testing.assert_allclose(got[k], want, atol=1e-9)
        np.testing.assert_allclose(tiled[k], want, atol=1e-9)


def test_histograms_of_odd_volumes(spark):
    rows = [("flat", 2.0), ("flat", 2.0), ("some", 1.0), ("some", None), ("some", float("nan")), ("some", 3.0), (None, 5.0), (None, 6.0), ("alone", 1.0)]
    df = spark.createDataFrame(rows, "case string, v double")
    ref = spark.createDataFrame([("flat", 7.0), ("flat", 9.0), ("some", 10.0), ("some", 30.0), (None, 0.0), (None, 1.0)], "case string, v double")
    got = sorted((tuple(r) for r in histograms.match(df, ref, ["case"], "v").collect()), key=repr)
    # A constant volume has one knot, its greatest value: it goes to the reference's.
    assert [r[0] for r in got].count("flat") == 2 and {r[1] for r in got if r[0] == "flat"} == {9.0}
    assert {repr(r[1]) for r in got if r[0] == "some"} == {"10.0", "None", "nan", "30.0"} and sorted(r[1] for r in got if r[0] is None) == [0.0, 1.0]
    assert not [r for r in got if r[0] == "alone"] and histograms.match(df.limit(0), ref, ["case"], "v").count() == 0


GRID = volume.Grid((14, 12, 10))


def test_a_transform_and_its_inverse(spark):
    """Points that go by a stored spline and come back by its inverse are within a tenth of a voxel, away from the edge."""
    cells = (3, 2, 2)
    points = augment.spline_basis(GRID, cells).shape[1]
    rng = np.random.default_rng(8)
    rows = [(k, *[(rng.uniform(-4, 4, points)).tolist() for _ in range(3)]) for k in range(3)] + [(9, None, [0.0] * points, [0.0] * points)]
    df = spark.createDataFrame(rows, "k int, c0 array<double>, c1 array<double>, c2 array<double>")
    df = df.withColumn("f", volume.spline_field([F.col(f"c{i}") for i in range(3)], GRID, cells))
    df = df.withColumns({f"f{i}": F.col(f"f.f{i}") for i in range(3)})
    df = df.withColumn("b", volume.inverse_field([F.col(f"f{i}") for i in range(3)], GRID))
    there_and_back = volume.composed_field([F.col(f"b.f{i}") for i in range(3)], [F.col(f"f{i}") for i in range(3)], GRID)
    out = {r["k"]: r for r in df.select("k", "f", there_and_back.alias("left")).collect()}
    assert out[9]["left"] is None
    inner = (slice(4, -4), slice(4, -4), slice(4, -4))
    for k in range(3):
        moved = np.abs([np.array(out[k]["f"][f"f{i}"]).reshape(GRID.shape)[inner] for i in range(3)]).max()
        rest = np.sqrt(sum(np.array(out[k]["left"][f"f{i}"]).reshape(GRID.shape)[inner] ** 2 for i in range(3))).max()
        assert moved > 0.5 and rest < 0.1, (k, moved, rest)


def test_composites_of_affine_maps_are_exact(spark):
    one, two = ([[float(x) for x in row] for row in m] for m in ([[1, 0, 0, 1], [0, 1, 0, -2], [0, 0, 1, 0.5]], [[0.9, 0, 0, 0.3], [0, 1.1, 0, 0], [0, 0, 1, -1]]))
    df = spark.createDataFrame([(one, two)], "a array<array<double>>, b array<array<double>>").withColumns({"f": volume.affine_field(F.col("a"), GRID), "g": volume.affine_field(F.col("b"), GRID)})
    got = df.select(volume.composed_field([F.col(f"f.f{i}") for i in range(3)], [F.col(f"g.f{i}") for i in range(3)], GRID).alias("h")).first()["h"]
    places = np.stack(np.meshgrid(*[np.arange(n) for n in GRID.shape], indexing="ij"))
    at = places + np.array([1.0, -2.0, 0.5]).reshape(3, 1, 1, 1)
    want = np.stack([0.9 * at[0] + 0.3, 1.1 * at[1], at[2] - 1.0]) - places
    inner = (slice(2, -2), slice(3, -3), slice(2, -2))
    for i in range(3):
        np.testing.assert_allclose(np.array(got[f"f{i}"]).reshape(GRID.shape)[inner], want[i][inner], atol=1e-9)


def test_oblique_directions_become_canonical(spark):
    """A volume turned by 30 degrees comes out upright with its centre kept, and goes back; a straight one goes by exchange alone."""
    import math

    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    grid = volume.Grid((9, 21, 21))
    oblique = volume.Placed(grid, (5.0, -3.0, 2.0), (1.0, 1.0, 2.0), (c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0))
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, n) for n in grid.shape], indexing="ij")
    blob = np.exp(-(((x - 0.3) / 0.4) ** 2) - (y / 0.3) ** 2 - z**2)
    df = spark.createDataFrame([(blob.ravel().tolist(),), (None,)], "v array<double>")
    done = df.withColumn("v", volume.canonical(F.col("v"), oblique))
    there, back = (next(np.array(r["v"]).reshape(grid.shape) for r in d.collect() if r["v"]) for d in (done, done.withColumn("v", volume.from_canonical(F.col("v"), oblique))))
    place = volume.canonical_place(oblique)
    assert place.grid == grid and place.direction == (-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0) and place.spacing == oblique.spacing
    centre = lambda p: np.array(p.origin) + np.array(p.direction).reshape(3, 3) @ ((np.array(p.grid.shape[::-1]) - 1) / 2 * np.array(p.spacing))
    np.testing.assert_allclose(centre(place), centre(oblique), atol=1e-9)
    # What lay on the volume's own x axis lies where that axis points in space.
    turn = np.diag([-1.0, -1.0, 1.0]) @ np.array(oblique.direction).reshape(3, 3)
    top = np.unravel_index(there.argmax(), grid.shape)
    want = turn @ np.array([0.3, 0.0, 0.0])
    np.testing.assert_allclose(np.array([top[2], top[1], top[0]]) / np.array([10, 10, 4]) - 1, want, atol=0.11)
    inner = (slice(None), slice(6, -6), slice(6, -6))
    # Two interpolations blur the peak.
    assert np.abs(back - blob)[inner].max() < 0.1 and np.abs(there - blob)[inner].max() > 0.3
    straight = volume.Placed(grid, (0.0,) * 3, (1.0,) * 3, (0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    exact = df.where("v is not null").select(volume.from_canonical(volume.canonical(F.col("v"), straight), straight).alias("v")).first()["v"]
    assert exact == blob.ravel().tolist()


def test_attention_gate(spark):
    from gridspan.plans import graph

    rng = np.random.default_rng(6)
    grid = volume.Grid((4, 6))
    x, g = rng.normal(size=(2, 4, 6)), rng.normal(size=(3, 2, 3))
    wx, wg, psi = rng.normal(size=(5, 2)), rng.normal(size=(5, 3)), rng.normal(size=5)
    bias = (rng.normal(size=5).tolist(), rng.normal(size=5).tolist(), 0.25)
    df = spark.createDataFrame([(x.ravel().tolist(), g.ravel().tolist()), (None, g.ravel().tolist())], "x array<double>, g array<double>")
    got = [r["o"] for r in df.select(graph.attention_gate(F.col("x"), F.col("g"), grid, wx.tolist(), wg.tolist(), psi.tolist(), bias).alias("o")).collect()]
    want = np.zeros_like(x)
    for i, j in np.ndindex(4, 6):
        inner = wx @ x[:, i // 2 * 2, j // 2 * 2] + bias[0] + wg @ g[:, i // 2, j // 2] + bias[1]
        want[:, i, j] = x[:, i, j] / (1 + np.exp(-(psi @ np.maximum(inner, 0) + 0.25)))
    assert got[1] is None
    np.testing.assert_allclose(np.array(got[0]).reshape(x.shape), want, atol=1e-12)
