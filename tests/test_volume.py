"""Volumes of two and three axes against NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.functions import arrays, parse
from gridspan.operators import augment, metrics, pointwise, schedules, volume
from gridspan.plans import chain, graph
from gridspan.plans.registry import Choices, Range, Registry

GRID = volume.Grid((3, 4, 5))


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).normal(size=GRID.shape).round(3)


@pytest.fixture(scope="module")
def one(spark, cube):
    return spark.createDataFrame([(1, cube.ravel().tolist(), (cube * 2 + 1).ravel().tolist())], "case long, v array<double>, w array<double>")


def values(df, *columns):
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def close(got, want):
    np.testing.assert_allclose(np.array(got, float), np.asarray(want, float).ravel(), atol=1e-9)


def test_orientation_padding_and_regions(one, cube):
    v = F.col("v")
    got = values(
        one, volume.flip(v, GRID, (0, 2)), volume.permute(v, GRID, (2, 0, 1)), volume.crop(v, GRID, (1, 0, 2), (3, 4, 4)), volume.pad(v, GRID, (1, 0, 2), (0, 1, 1), "constant", -7.0),
        volume.pad(v, GRID, (1, 0, 2), (0, 1, 1), "reflect"), volume.pad(v, GRID, (1, 0, 2), (0, 1, 1), "replicate"), augment.quarter_turn(v, GRID, (0, 1), 1)[0], augment.quarter_turn(v, GRID, (1, 2), 3)[0], augment.quarter_turn(v, GRID, (0, 2), 2)[0],
    )
    widths = ((1, 0), (0, 1), (2, 1))
    want = [cube[::-1, :, ::-1], cube.transpose(2, 0, 1), cube[1:3, :, 2:4], np.pad(cube, widths, constant_values=-7), np.pad(cube, widths, mode="reflect"), np.pad(cube, widths, mode="edge")]
    for g, w in zip(got[:6], want, strict=True):
        close(g, w)
    for g, k, axes in ((got[6], 1, (0, 1)), (got[7], 3, (1, 2)), (got[8], 2, (0, 2))):
        close(g, np.rot90(cube, k, axes))
    with pytest.raises(ValueError):
        volume.pad(v, GRID, (3, 0, 0), (0, 0, 0), "reflect")
    with pytest.raises(ValueError):
        volume.permute(v, GRID, (0, 0, 1))
    assert volume.inverse_dims((2, 0, 1)) == (1, 2, 0)


def test_long_and_flat_forms(one, cube):
    long = volume.long_form(one, ["case"], "v", GRID, ["z", "y", "x"])
    rows = {(r["z"], r["y"], r["x"]): r["value"] for r in long.collect()}
    assert rows == {at: cube[at] for at in np.ndindex(*GRID.shape)}
    back = volume.flat_form(long.where("value > 0"), ["case"], "value", GRID, ["z", "y", "x"]).first()["value"]
    assert back == [x if x > 0 else None for x in cube.ravel().tolist()]


def test_canonical_orientation_and_origins(spark):
    turned = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    dims, flips = volume.orientation(turned, (1.0, 1.0, 1.0))
    assert sorted(dims) == [0, 1, 2] and set(flips) <= {0, 1, 2}
    origin, spacing, direction = volume.canonical_geometry((3, 4, 5), [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], turned, dims, (1.0, 1.0, 1.0))
    # The set of corner points stays what it was.
    corner = lambda o, s, d, n: {tuple(round(o[i] + sum(d[i * 3 + k] * s[k] * c[k] for k in range(3)), 6) for i in range(3)) for c in itertools.product(*[(0, m - 1) for m in n])}
    size = [5, 4, 3]
    after = [size[2 - dims[2 - j]] for j in range(3)]
    assert corner([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], turned, size) == corner(origin, spacing, direction, after)
    c, s = math.cos(0.3), math.sin(0.3)
    assert volume.orientation([c, -s, 0, s, c, 0, 0, 0, 1]) is None
    df = spark.createDataFrame([([10.0, 20.0, 30.0], [0.5, 1.5, 2.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [3.0, 2.0, 1.0])], "o array<double>, s array<double>, d array<double>, a array<double>")
    assert df.select(volume.shifted_origin(F.col("o"), F.col("s"), F.col("d"), F.col("a"))).first()[0] == [11.5, 23.0, 32.0]


def trilinear(cube, at, border):
    out = 0.0
    for corner in itertools.product((0, 1), repeat=3):
        w, where = 1.0, []
        for c, b, n in zip(at, corner, cube.shape, strict=True):
            if border == "border":
                c = min(max(c, 0), n - 1)
            if border == "reflection" and n > 1:
                turns, rest = divmod(abs(c), n - 1)
                c = rest if turns % 2 == 0 else n - 1 - rest
            low = math.floor(c)
            w *= (c - low) if b else 1 - (c - low)
            where.append(low + b)
        if all(0 <= i < n for i, n in zip(where, cube.shape, strict=True)):
            out += w * cube[tuple(where)]
    return out


def test_resampling_and_its_regions(one, cube):
    out = volume.Grid((5, 3, 7))
    scales = [n / m for n, m in zip(GRID.shape, out.shape, strict=True)]
    want = np.array([trilinear(cube, [max(s * (o + 0.5) - 0.5, 0) for s, o in zip(scales, at, strict=True)], "border") for at in np.ndindex(*out.shape)])
    start, stop = (1, 0, 2), (4, 2, 6)
    window = volume.source_window(start, stop, scales, GRID.shape)
    cut = tuple(slice(a, b) for a, b in window)
    part = F.array(*map(F.lit, cube[cut].ravel().tolist()))
    got = values(one, volume.resample(F.col("v"), GRID, out), volume.resample(F.col("v"), GRID, out, labels=True), volume.resample_region(part, window, start, stop, scales, GRID.shape))
    close(got[0], want)
    close(got[1], [cube[tuple(min(int(o * s), n - 1) for o, s, n in zip(at, scales, cube.shape, strict=True))] for at in np.ndindex(*out.shape)])
    close(got[2], want.reshape(out.shape)[tuple(slice(a, b) for a, b in zip(start, stop, strict=True))])
    assert volume.grid_of_spacing(volume.Grid((10, 10, 10)), [1.0, 1.0, 2.0], [2.0, 0.0, 1.0]).shape == (20, 10, 5)
    assert volume.grid_of_shape(GRID, (0, 9, 0)).shape == (3, 9, 5)


def test_warps(one, cube):
    m = volume.rigid_affine([0.3, -0.2, 0.5], [0.1, 0.0, -0.2])
    affine = F.array(*[F.array(*map(F.lit, row)) for row in m])
    back = augment.inverse_of(affine)
    drawn = augment.rotation([F.lit(0.3), F.lit(-0.2), F.lit(0.5)])
    zeros = np.zeros(GRID.size)
    fields = [np.linspace(-1, 2, GRID.size), zeros, np.full(GRID.size, 0.25)]
    columns = [F.array(*map(F.lit, f.tolist())) for f in fields]
    got = values(one, volume.warp(F.col("v"), GRID, affine), volume.displace(F.col("v"), GRID, columns), back, drawn)

    def image(at):
        unit = [2 * c / (n - 1) - 1 for c, n in zip(at, GRID.shape, strict=True)][::-1]
        there = [sum(a * u for a, u in zip(row, unit, strict=False)) + row[3] for row in m][::-1]
        return [(c + 1) / 2 * (n - 1) for c, n in zip(there, GRID.shape, strict=True)]

    close(got[0], [trilinear(cube, image(at), "reflection") for at in np.ndindex(*GRID.shape)])
    close(got[1], [trilinear(cube, [c + f[k] for c, f in zip(at, fields, strict=True)], "border") for k, at in enumerate(np.ndindex(*GRID.shape))])
    full = np.vstack([m, [0, 0, 0, 1]])
    np.testing.assert_allclose(np.vstack([got[2], [0, 0, 0, 1]]) @ full, np.eye(4), atol=1e-9)
    np.testing.assert_allclose(np.array(got[3])[:, :3], np.array(m)[:, :3], atol=1e-9)


def test_neighbourhoods(one, cube):
    got = values(one, volume.dilate(F.col("v"), GRID, 1), volume.gradient(F.col("v"), GRID), volume.box_mean(F.col("v"), GRID, 1), volume.structural_similarity(F.col("v"), F.col("w"), GRID, 2.0, 3))
    wide, edge = np.pad((cube > 0).astype(float), 1), np.pad(cube, 1, mode="edge")
    around = lambda a: [a[tuple(slice(o, o + n) for o, n in zip(off, cube.shape, strict=True))] for off in itertools.product(range(3), repeat=3)]
    close(got[0], np.max(around(wide), 0))
    close(got[2], np.mean(around(edge), 0))
    steps = [np.concatenate([np.diff(cube, axis=k), np.zeros_like(np.take(cube, [0], k))], k) for k in range(3)]
    close(got[1], np.sqrt(sum((1 / (1 + np.exp(-3 * s))) ** 2 for s in steps)))
    b, terms = cube * 2 + 1, []
    for at in itertools.product(*[range(n - 2) for n in cube.shape]):
        x, y = (a[tuple(slice(o, o + 3) for o in at)].ravel() for a in (cube, b))
        cov = np.cov(x, y)
        terms.append((2 * x.mean() * y.mean() + 4e-4) * (2 * cov[0, 1] + 3.6e-3) / ((x.mean() ** 2 + y.mean() ** 2 + 4e-4) * (cov[0, 0] + cov[1, 1] + 3.6e-3)))
    assert got[3] == pytest.approx(np.mean(terms))


def test_self_similarity(spark):
    grid = volume.Grid((4, 4))
    x = np.random.default_rng(1).normal(size=grid.shape)
    df = spark.createDataFrame([(x.ravel().tolist(),)], "v array<double>")
    got = np.array(volume.self_similarity(df, "v", grid, "m", 1, 1).first()["m"])
    scaled = (x - x.min()) / (x.max() - x.min() + 1e-6)
    edge = np.pad(scaled, 1, mode="edge")
    shift = lambda d: edge[1 + d[0] : 5 + d[0], 1 + d[1] : 5 + d[1]]
    pairs = volume.mind_pairs(2)
    assert len(pairs) == 4 and len(volume.mind_pairs(3)) == 12
    ssd = []
    for a, b in pairs:
        sq = np.pad((shift(a) - shift(b)) ** 2, 1, mode="edge")
        ssd.append(sum(sq[i : i + 4, j : j + 4] for i in range(3) for j in range(3)) / 9)
    m = np.stack(ssd) - np.min(ssd, 0)
    var = m.mean(0)
    var = np.clip(var, var.mean() * 0.001, var.mean() * 1000)
    np.testing.assert_allclose(got.T.reshape(4, 4, 4), np.exp(-m / var), atol=1e-9)


def test_patches_come_together(one, cube):
    patch, overlap = (2, 3, 4), (1, 1, 2)
    pieces = volume.patches(one, ["case"], "v", GRID, patch, overlap, None)
    cells = volume.cells(GRID.shape, patch, overlap)
    rows = {r["patch_idx"]: np.array(r["v"]).reshape(patch) for r in pieces.collect()}
    assert sorted(rows) == list(range(len(cells)))
    for k, (a, b) in enumerate(cells):
        held = cube[tuple(slice(x, y) for x, y in zip(a, b, strict=True))]
        want = np.full(patch, held.min())
        want[tuple(slice(0, n) for n in held.shape)] = held
        np.testing.assert_allclose(rows[k], want)
    twice = pieces.unionByName(pieces.where("patch_idx = 0"))
    for kind in ("mean", "cosinus", "gaussian", None):
        close(volume.blend(twice, ["case"], "v", GRID, patch, overlap, kind).first()["v"], cube)
    planes = volume.patches(one, ["case"], "v", GRID, (1, 4, 5), (0, 0, 0), 0.0, context=1)
    stacked = {r["patch_idx"]: np.array(r["v"]).reshape(3, 4, 5) for r in planes.collect()}
    np.testing.assert_allclose(stacked[0], cube[[1, 0, 1]])
    np.testing.assert_allclose(stacked[2], cube[[1, 2, 1]])


def test_patch_sizes_and_overlaps():
    assert volume.axis_cuts(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and volume.axis_cuts(3, 4, 1) == [(0, 3)]
    assert volume.concrete_patch([0, 0, 3], [5, 122, 2], [16, 16]) == [5, 128, 2]
    assert volume.concrete_patch(None, [4, 5]) == [4, 5]
    assert volume.sized_free_axes([0, 0], [122, 64], [16, 16]) == [128, 64] and volume.sized_free_axes([0, 0], [64, 64], [16, 16]) is None
    assert volume.resolved_overlap("20%", [10, 1, 10], [30, 30, 10]) == [2, 0, 0]
    assert volume.resolved_overlap([3, 0.5], [10, 10], [30, 30]) == [3, 5]
    for bad in ("x", "20", 1.5, -1, 10, [1]):
        with pytest.raises(ValueError):
            volume.resolved_overlap(bad, [10, 10], [30, 30])
    fit = volume.budgeted_patch([0, 0, 0], [100, 100, 100], 1, 4, 8 * 50**3)
    assert 2 * 4 * math.prod(fit) <= 8 * 50**3 and min(fit) >= 48
    assert volume.budgeted_patch([0, 64], [100, 64], 1, 4, None) == [100, 64]
    with pytest.raises(ValueError):
        volume.budgeted_patch([64, 0], [64, 100], 1, 4, 10)
    assert len(volume.cells_by_count((4, 4), (2, 3), (1, 0))) == 6


def test_pointwise(one, cube):
    v, mask = F.col("v"), F.transform("w", lambda x: (x > 1).cast("int"))
    flat, chosen = cube.ravel(), cube.ravel() > 0
    got = values(
        one, pointwise.clip(v, "percentile:10", 0.5), pointwise.clip(v, "min", "max", mask), pointwise.normalize(v), pointwise.standardize(v, mask), pointwise.norm(v, 3), pointwise.channel_sum(v, 3),
        pointwise.by_channel(v, 3, lambda p: pointwise.normalize(p, 0.0, 1.0), [1]), pointwise.standardize(F.array(F.lit(2.0), F.lit(2.0))), pointwise.normalize(F.array(F.lit(2.0), F.lit(2.0))), pointwise.channel_variance(v, 3),
        pointwise.merge_labels(F.array(*map(F.lit, [1, 0, 2, 0, 1, 0])), [3, 2]), pointwise.gram_distance(v, F.col("w"), 3),
    )
    close(got[0], np.clip(flat, np.percentile(flat, 10), 0.5))
    close(got[1], np.clip(flat, flat[chosen].min(), flat[chosen].max()))
    close(got[2], (flat - flat.min()) / (flat.max() - flat.min()) * 2 - 1)
    close(got[3], (flat - flat[chosen].mean()) / flat[chosen].std(ddof=1))
    close(got[4], np.linalg.norm(cube, axis=0))
    close(got[5], cube.sum(0))
    part = cube.copy()
    part[1] = (part[1] - part[1].min()) / (part[1].max() - part[1].min())
    close(got[6], part)
    assert got[7] == [0, 0] and got[8] == [-1, -1]
    assert got[9] == pytest.approx(cube.var(0, ddof=1).mean())
    assert got[10] == [1, 3, 2]
    gram = lambda a: a.reshape(3, -1) @ a.reshape(3, -1).T / a.size
    assert got[11] == pytest.approx(np.abs(gram(cube) - gram(cube * 2 + 1)).sum())


def test_pointwise_odd_rows(spark):
    df = spark.createDataFrame([(None,), ([],), ([float("nan"), 1.0, None, 3.0],)], "v array<double>")
    rows = df.select(pointwise.normalize(F.col("v")).alias("n"), pointwise.standardize(F.col("v")).alias("s"), pointwise.image_statistics(F.col("v")).alias("t"), arrays.quantile(F.col("v"), 0.5).alias("q")).collect()
    assert rows[0]["n"] is None and rows[1]["n"] == [] and rows[1]["q"] is None
    assert rows[2]["n"][1:] == [-1.0, None, 1.0] and math.isnan(rows[2]["n"][0]) and rows[2]["q"] == 2.0
    assert tuple(rows[2]["t"]) == (1.0, 3.0, 2.0, pytest.approx(math.sqrt(2)))


def test_running_folds_by_blocks(spark):
    for n in (0, 1, 255, 256, 257, 3000):
        xs = list(range(n))
        df = spark.createDataFrame([(xs,)], "v array<long>")
        got = df.select(arrays.running(F.col("v"), F.lit(0).cast("long"), lambda a, b: a + b)).first()[0]
        assert got == [0, *np.cumsum(xs).tolist()][:n]


def test_colour_and_draws(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 6))
    df = spark.createDataFrame([(1, 2, x.ravel().tolist())], "case long, copy long, v array<double>")
    v = F.col("v")
    maps = [augment.brightness(F.lit(0.3)), augment.contrast(F.lit(1.5)), augment.luma_flip(F.lit(1.0)), augment.hue(F.lit(0.7)), augment.saturation(F.lit(0.4))]
    got = df.select(*[augment.colour(v, 3, m).alias(f"c{k}") for k, m in enumerate(maps)], *[m.alias(f"m{k}") for k, m in enumerate(maps)], augment.colour(F.slice(v, 1, 6), 1, maps[1]).alias("grey"), augment.noise(v, F.col("case"), F.col("copy"), F.lit(0), 1.0).alias("still")).first()
    for k in range(5):
        m = np.array(got[f"m{k}"], float)
        close(got[f"c{k}"], m[:3, :3] @ x + m[:3, 3:])
    grey = np.array([[0.5] * 6] * 3)
    h = np.array(got["m3"], float)
    np.testing.assert_allclose(h[:3, :3] @ grey, grey)
    np.testing.assert_allclose(h[:3, :3] @ h[:3, :3].T, np.eye(3), atol=1e-9)
    close(got["grey"], x[0] * 1.5)
    assert got["still"] == x.ravel().tolist()
    assert augment.spline_basis(volume.Grid((5, 6)), (2, 2)).sum(1) == pytest.approx(np.ones(30))


def test_elastic_foreign_and_masks(spark, one, cube):
    base = one.withColumn("copy", F.lit(0).cast("long"))
    still = augment.elastic(base, "v", GRID, "case", "copy", 2, 0.0).first()["v"]
    close(still, cube)
    a, b = (augment.elastic(base, "v", GRID, "case", "copy", 2, 1.0).first()["v"] for _ in range(2))
    assert a == b and a != still
    moved = base.select(augment.foreign(lambda x, rng: x + rng.integers(0, 9), F.col("v"), F.col("case"), F.col("copy")).alias("v")).first()["v"]
    assert len({round(m - x, 6) for m, x in zip(moved, cube.ravel(), strict=True)}) == 1
    mask = np.array([[[1, 0], [1, 1]]])
    placed = base.select(augment.placed_mask(F.col("v"), GRID, F.array(*map(F.lit, mask.ravel().tolist())), volume.Grid(mask.shape), [F.lit(1), F.lit(2), F.lit(3)], -5.0).alias("v")).first()["v"]
    close(placed, np.where(mask == 1, cube[1:2, 2:4, 3:5], -5))
    swapped, grid = augment.permuted_copy(F.col("v"), GRID, True, True)
    close(base.select(swapped.alias("v")).first()["v"], cube.transpose(1, 0, 2).transpose(2, 0, 1))
    assert grid.shape == (5, 4, 3)


def test_schedules():
    levels = schedules.signal_levels(100)
    assert levels[0] == 1 and abs(levels[-1]) < 1e-12 and all(a > b for a, b in zip(levels, levels[1:], strict=False))
    betas = schedules.cosine_betas(50)
    assert len(betas) == 50 and all(0.0001 <= b <= 0.9999 for b in betas)


def test_early_stop_with_gains_and_gaps(spark):
    scores = [("a", k, v) for k, v in enumerate([5.0, 4.0, 3.95, float("nan"), None, 3.0])] + [("b", k, 1.0) for k in range(3)]
    df = spark.createDataFrame(scores, "run string, step int, score double")
    got = {r["run"]: (r["best"], r["stop_step"]) for r in schedules.early_stop(df, "run", "step", "score", 3, 0.1).collect()}
    assert got == {"a": (4.0, 4), "b": (1.0, None)}
    both = spark.createDataFrame([("r", 0, "x", 1.0), ("r", 0, "y", 2.0), ("r", 1, "x", 5.0)], "run string, step int, key string, v double")
    assert [tuple(r) for r in schedules.monitored(both, "run", "step", "key", "v", ["x", "y"]).collect()] == [("r", 0, 3.0)]


def test_frechet_and_axes(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 3)) @ np.diag([3, 1, 0.5]), rng.normal(size=(50, 3)) + 1
    da, db = (spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>") for x in (a, b))
    mean, axes = metrics.principal_axes(da, "v", 2)
    np.testing.assert_allclose(mean, a.mean(0))
    values_, vectors = np.linalg.eigh(np.cov(a.T))
    np.testing.assert_allclose(np.abs(np.array(axes) @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-9)
    root = lambda m: (lambda w, u: u @ np.diag(np.sqrt(np.clip(w, 0, None))) @ u.T)(*np.linalg.eigh(m))
    ca, cb = np.cov(a.T), np.cov(b.T)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.trace(root(root(ca) @ cb @ root(ca)))
    assert metrics.frechet_distance(da, db, "v") == pytest.approx(want)
    np.testing.assert_allclose(da.select(metrics.project(F.col("v"), mean, axes).alias("p")).first()["p"], (a[0] - a.mean(0)) @ np.array(axes).T)
    doubled = db.select(metrics.features_of(lambda x: x * 2, F.col("v")).alias("f")).collect()
    np.testing.assert_allclose([r["f"] for r in doubled], b * 2)


def test_chains(one, cube):
    steps = chain.from_config([{"Clip": {"min_value": -1.0, "max_value": 1.0}}, {"Dilate": {"dilate": 2}}, {"Gradient": {}}])
    own = steps.locality(3)
    assert own.kind is chain.Kind.HALO and own.halo == (3, 3, 3)
    assert steps.window((5, 5, 5), (6, 6, 6), volume.Grid((20, 6, 20))) == [(2, 9), (2, 6), (2, 9)]
    with pytest.raises(ValueError):
        steps.undo(one, "v", GRID)
    with pytest.raises(ValueError):
        chain.check_patch_steps(list(steps.steps), GRID)
    with pytest.raises(ValueError):
        chain.check_patch_steps([chain.padding_step([1, 0, 0], [0, 0, 0])], GRID)
    with pytest.raises(ValueError):
        chain.check_patch_steps([chain.standardize_step()], GRID, at_prediction=True)
    with pytest.raises(KeyError):
        chain.from_config([{"Nothing": {}}])
    with pytest.raises(ValueError):
        chain.from_config([{"Clip": {"minimum": 1}}])
    doubled = chain.Chain((chain.foreign_step(lambda a: a * 2),))
    close(doubled.apply(one, "v", GRID).first()["v"], cube * 2)
    resized = chain.from_config([{"ResampleToShape": {"shape": [0, 8, 0]}}])
    assert resized.grids(GRID)[-1].shape == (3, 8, 5) and resized.locality(3).kind is chain.Kind.RESCALE
    answered = chain.inference(one, "v", GRID, lambda x: x.sum((1, 2, 3), keepdims=True), "sum").first()["sum"]
    assert answered == [pytest.approx(cube.sum())]
    out = chain.fan_out(one.withColumn("grp", F.lit("CT")), "grp", "v", {"CT": {"a": chain.Chain((chain.flip_step([0]),)), "b": chain.Chain(())}}, GRID)
    rows = {r["dest"]: r["v"] for r in out.collect()}
    close(rows["a"], cube[::-1])
    close(rows["b"], cube)


def test_flows(one, cube):
    v = F.col("v")
    flow = graph.Flow((graph.Node("n", graph.negative, ("left",), "x"), graph.Node("s", graph.add, ("x", "7"), "x")))
    close(flow.run(one, {"left": "v", "right": "w"}).first()["branch_x"], cube * 0)
    with pytest.raises(ValueError):
        graph.Flow((graph.Node("n", graph.negative, ("nothing",)),)).run(one, {"left": "v"})
    with pytest.raises(ValueError):
        graph.Flow((graph.Node("n", graph.negative), graph.Node("n", graph.negative))).run(one, {"left": "v"})
    cut, grid = graph.select(v, GRID, [(0, 3, 2), (1, 4, 1), (0, 5, 3)])
    got = values(one, cut, graph.argmax(v, GRID, 1), graph.to_channels(v, GRID)[0], graph.to_features(v, GRID)[0], graph.pool(v, GRID, (1, 2, 2))[0], graph.residual(v, lambda x: F.transform(x, lambda y: y * 0.5)))
    close(got[0], cube[::2, 1:4, ::3])
    close(got[1], cube.argmax(1))
    close(got[2], np.moveaxis(cube, -1, 0))
    close(got[3], np.moveaxis(cube, 0, -1))
    close(got[4], cube[:, :, :4].reshape(3, 2, 2, 2, 2).max((2, 4)))
    close(got[5], np.maximum(cube * 1.5, 0))
    assert grid.shape == (2, 3, 2) and graph.view(GRID, [-1, 5]).shape == (12, 5) and graph.squeeze(graph.unsqueeze(GRID, 1), 1) == GRID
    with pytest.raises(ValueError):
        graph.view(GRID, [7, -1])


def test_registry_and_settings():
    registry = Registry()
    registry.register("criterion")(abs)
    assert registry.find("criterion", "abs") is abs and registry.find("reduction", "math:fsum") is math.fsum
    with pytest.raises(ValueError):
        registry.add("criterion", "abs", sum)
    with pytest.raises(ValueError):
        registry.add("nonsense", "abs", sum)
    with pytest.raises(KeyError):
        registry.find("criterion", "sum")
    Range(0, 1).check(0.5)
    for bad in (lambda: Range(0, 1).check(2), lambda: Choices(("a",)).check("b")):
        with pytest.raises(ValueError):
            bad()


def test_parsing(spark):
    assert parse.path_spec("data/x:a:nii.gz") == ("data/x", "a", "nii.gz") and parse.path_spec("C:\\data:omezarr@2") == ("C:\\data", None, "omezarr@2") and parse.path_spec("x") == ("x", None, "mha")
    assert parse.format_level("omezarr@2") == ("omezarr", 2)
    for bad in ("x:b:mha", "x:what", "x:a:b:c", "x:omezarr@z"):
        with pytest.raises(ValueError):
            parse.path_spec(bad)
    rows = [("24GB",), ("1.5 MiB",), ("3",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(parse.memory_bytes(F.col("s"))).collect()] == [24 << 30, 3 << 19, 3 << 30, None, None]
    one = spark.range(1).select(F.create_map(F.lit("Spacing"), F.array(F.lit("[1. 2.]"))).alias("a"))
    pushed = parse.push(F.col("a"), "Spacing", F.lit("[3. 4.]"))
    r = one.select(parse.numbers(parse.peek(pushed, "Spacing")), parse.peek(parse.pop(pushed, "Spacing"), "Spacing"), F.size(parse.pop(F.col("a"), "Spacing")), parse.peek(parse.push(F.col("a"), "k_1", F.lit(5)), "k_1"), parse.truth(F.lit("Yes"))).first()
    assert tuple(r) == ([3.0, 4.0], "[1. 2.]", 0, "5", True)
