"""Tiles against whole arrays: every operator gives the same voxels on any tiling, and on volumes that no row holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.functions import parse
from gridspan.operators import kernels, tiles, volume
from gridspan.operators.tiles import Tiling
from gridspan.plans import chain

SHAPE = (7, 9, 8)


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(0)
    data = {k: rng.normal(size=SHAPE) for k in ("a", "b")}
    df = spark.createDataFrame([(k, 1, x.ravel().tolist(), (x * 0.5 + 0.1).ravel().tolist()) for k, x in data.items()], "case string, grp int, v array<double>, w array<double>").repartition(2)
    return data, df


def whole(df, shape, column="v"):
    return {r["case"]: np.array(r[column]).reshape(shape) for r in df.collect()}


KEYS = ["case", "grp"]
TILINGS = [Tiling(SHAPE, (3, 4, 5)), Tiling(SHAPE, (1, 9, 8)), Tiling(SHAPE, (8, 2, 3))]


@pytest.mark.parametrize("tiling", TILINGS)
def test_operators_equal_whole_arrays(cases, tiling):
    data, df = cases
    cut = tiles.cut_rows(df, KEYS, ["v", "w"], tiling)
    assert cut.count() == 2 * np.prod(tiling.counts)
    back = tiles.joined_rows(cut, KEYS, ["v", "w"], tiling)
    assert all((whole(back, SHAPE)[k] == x).all() for k, x in data.items())
    one = cut.drop("w")
    checks = [
        (tiles.dilate(one, KEYS, "v", tiling, 2), tiling, lambda x: kernels.dilate(x, 2)),
        (tiles.box_mean(one, KEYS, "v", tiling, 1), tiling, lambda x: kernels.box_mean(x, 1)),
        (tiles.gradient(one, KEYS, "v", tiling), tiling, kernels.gradient),
        (tiles.flip(one, KEYS, ["v"], tiling, (0, 2)), tiling, lambda x: np.flip(x, (0, 2))),
    ]
    other = Tiling((8, 7, 9), (2, 3, 4))
    checks.append((tiles.permute(one, KEYS, ["v"], tiling, other, (2, 0, 1)), other, lambda x: np.transpose(x, (2, 0, 1))))
    part = Tiling((4, 5, 6), (3, 2, 5))
    checks.append((tiles.crop(one, KEYS, ["v"], tiling, part, (2, 1, 0)), part, lambda x: x[2:6, 1:6, :6]))
    wide = Tiling((12, 13, 11), (2, 5, 4))
    for mode, how in (("constant", {"constant_values": -2.0}), ("reflect", {}), ("replicate", {})):
        checks.append((tiles.pad(one, KEYS, ["v"], tiling, wide, (3, 4, 1), mode, -2.0), wide, lambda x, m=mode, h=how: np.pad(x, ((3, 2), (4, 0), (1, 2)), {"replicate": "edge"}.get(m, m), **h)))
    for i, (got, t, want) in enumerate(checks):
        rows = whole(tiles.joined_rows(got, KEYS, ["v"], t), t.shape)
        for k, x in data.items():
            np.testing.assert_allclose(rows[k], want(x), atol=1e-12, err_msg=str(i))


@pytest.mark.parametrize("out", [(14, 5, 8), (3, 20, 16), (7, 9, 1)])
@pytest.mark.parametrize("labels", [False, True])
def test_resampling_equals_the_array_form(cases, out, labels):
    data, df = cases
    want = whole(df.withColumn("v", volume.resample(F.col("v"), volume.Grid(SHAPE), volume.Grid(out), labels)), out)
    source, target = TILINGS[0], Tiling(out, (4, 3, 3))
    got = whole(tiles.joined_rows(tiles.resample(tiles.cut_rows(df, KEYS, ["v"], source), KEYS, "v", source, target, labels), KEYS, ["v"], target), out)
    for k in data:
        np.testing.assert_allclose(got[k], want[k], atol=1e-12)


def test_kernels_equal_the_array_form(cases):
    data, df = cases
    grid, v = volume.Grid(SHAPE), F.col("v")
    forms = {"dilate": (volume.dilate(v, grid, 1), lambda x: kernels.dilate(x, 1)), "mean": (volume.box_mean(v, grid, 2), lambda x: kernels.box_mean(x, 2)), "gradient": (volume.gradient(v, grid), kernels.gradient)}
    rows = {r["case"]: r for r in df.select("case", *[f.alias(n) for n, (f, _) in forms.items()]).collect()}
    for n, (_, kernel) in forms.items():
        for k, x in data.items():
            np.testing.assert_allclose(np.array(rows[k][n]).reshape(SHAPE), kernel(x), atol=1e-12)


def test_similarity_statistics_and_planes(spark, cases):
    data, df = cases
    tiling = TILINGS[0]
    planes = df.select(*KEYS, F.posexplode(F.array(*[F.slice("v", 72 * z + 1, 72) for z in range(7)])).alias("z", "v"))
    cut = tiles.from_planes(planes, KEYS, "z", ["v"], tiling)
    assert all((x == data[k]).all() for k, x in whole(tiles.joined_rows(cut, KEYS, ["v"], tiling), SHAPE).items())
    both = tiles.cut_rows(df, KEYS, ["v", "w"], tiling)
    want = {r["case"]: r["s"] for r in df.select("case", volume.structural_similarity(F.col("v"), F.col("w"), volume.Grid(SHAPE), 2.0, 5).alias("s")).collect()}
    got = {r["case"]: r["ssim"] for r in tiles.structural_similarity(both, KEYS, "v", "w", tiling, 2.0, 5).collect()}
    stats = {r["case"]: r for r in tiles.statistics(cut, KEYS, "v", tiling).collect()}
    for k, x in data.items():
        assert got[k] == pytest.approx(want[k], abs=1e-12)
        assert [stats[k][c] for c in ("min", "max", "mean", "std")] == pytest.approx([x.min(), x.max(), x.mean(), x.std(ddof=1)])
    voxels = {(r["z"], r["y"], r["x"]): r["v"] for r in tiles.long_form(cut.where("case = 'a'"), KEYS, ["v"], tiling, ["z", "y", "x"]).collect()}
    assert voxels == {i: v for i, v in np.ndenumerate(data["a"])}


@pytest.mark.parametrize("kind", ["mean", "cosinus", "gaussian", None])
def test_patches_blend_into_tiles(cases, kind):
    data, df = cases
    patch, overlap = (4, 5, 4), (2, 1, 2)
    pieces = volume.patches(df, KEYS, "v", volume.Grid(SHAPE), patch, overlap)
    noisy = pieces.withColumn("v", F.zip_with("v", F.transform("v", lambda x: F.col("patch_idx") * 0.01), lambda x, y: x + y))
    want = whole(volume.blend(noisy, KEYS, "v", volume.Grid(SHAPE), patch, overlap, kind), SHAPE)
    tiling = Tiling(SHAPE, (3, 4, 5))
    got = whole(tiles.joined_rows(tiles.blend(noisy.unionByName(noisy), KEYS, "v", tiling, patch, overlap, kind), KEYS, ["v"], tiling), SHAPE)
    same = whole(volume.blend(pieces, KEYS, "v", volume.Grid(SHAPE), patch, overlap, kind), SHAPE)
    for k, x in data.items():
        np.testing.assert_allclose(got[k], want[k], atol=1e-12)
        np.testing.assert_allclose(same[k], x, atol=1e-12)
        assert not np.allclose(want[k], x)


def test_odd_tiles(spark):
    tiling = Tiling((2, 3), (2, 2))
    df = spark.createDataFrame([("n", None, "t"), ("x", [1.0, None, 3.0, 4.0, 5.0, float("nan")], "t")], "case string, v array<double>, tile string")
    cut = tiles.cut_rows(df, ["case"], ["v"], tiling)
    rows = {r["case"]: r["v"] for r in tiles.joined_rows(cut, ["case"], ["v"], tiling).collect()}
    assert repr(rows["x"]) == repr([1.0, float("nan"), 3.0, 4.0, 5.0, float("nan")]) and all(np.isnan(rows["n"]))
    assert tiles.statistics(cut, ["case"], "v", tiling).where("case = 'x'").first()["max"] == 5.0
    empty = tiles.cut_rows(df.limit(0), ["case"], ["v"], tiling)
    assert tiles.gradient(empty, ["case"], "v", tiling).count() == 0


def test_chain_on_tiles(cases):
    data, df = cases
    tiling = TILINGS[0]
    steps = chain.from_config([{"Clip": {"min_value": -1.5, "max_value": 1.5}}, {"Gradient": {}}, {"Normalize": {}}, {"Flip": {"dims": [1]}}, {"Padding": {"before": [1, 0, 2], "after": [0, 1, 0]}}, {"Dilate": {"dilate": 1}}, {"ResampleToShape": {"shape": [4, 4, 4]}}, {"Permute": {"dims": [1, 2, 0]}}, {"Standardize": {}}])
    want = whole(steps.apply(df, "v", volume.Grid(SHAPE)), (4, 4, 4))
    table, out = steps.apply_tiles(tiles.cut_rows(df, KEYS, ["v"], tiling), KEYS, "v", tiling)
    got = whole(tiles.joined_rows(table, KEYS, ["v"], out), out.shape)
    assert out.shape == (4, 4, 4)
    for k in data:
        np.testing.assert_allclose(got[k], want[k], atol=1e-10)
    with pytest.raises(ValueError, match="no way on tiles"):
        chain.Chain((chain.foreign_step(lambda x: x),)).apply_tiles(table, KEYS, "v", out)


def test_a_volume_that_no_task_holds(spark):
    """400 x 512 x 512 doubles are 839 MB; tiles of 2 MB go through tasks that never hold more than a window."""
    tiling = Tiling((400, 512, 512), (16, 128, 128))
    rows = spark.range(0, 400, 1, 16).select(F.lit("big").alias("case"), F.col("id").alias("tile"), F.transform(F.sequence(F.lit(0), F.lit(512 * 512 - 1)), lambda i: ((i * 7 + F.col("id") * 13) % 1009).cast("double")).alias("v"))
    planes = rows.select("case", F.col("tile").alias("z"), "v")
    cut = tiles.from_planes(planes, ["case"], "z", ["v"], tiling)
    got = tiles.statistics(tiles.box_mean(cut, ["case"], "v", tiling, 1), ["case"], "v", tiling).first()
    assert got["min"] >= 0 and got["max"] <= 1008 and got["mean"] == pytest.approx(504, abs=1)


def test_recorded_chains_return_to_the_input(cases):
    data, df = cases
    grid = volume.Grid(SHAPE)
    geometry = F.create_map(*[F.lit(x) for k, v in {"Origin": "[1.0 2.0 3.0]", "Spacing": "[0.5 1.0 2.0]", "Direction": "[1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0]"}.items() for x in (k, v)])
    rows = df.withColumn("attributes", F.transform_values(geometry, lambda _, v: F.array(v)))
    steps = chain.from_config([{"Normalize": {}}, {"Clip": {"min_value": -5.0, "max_value": 5.0}}, {"Standardize": {}}, {"Flip": {"dims": [0]}}, {"Padding": {"before": [1, 0, 2], "after": [0, 1, 0]}}, {"Normalize": {"min_value": 0.0, "max_value": 3.0}}])
    there = steps.apply_recorded(rows, "v", grid)
    seen = there.where("case = 'a'").first()["attributes"]
    assert len(seen["Min"]) == 2 and float(seen["Min"][0]) == data["a"].min() and float(seen["Mean"][0]) == pytest.approx(((data["a"] - data["a"].min()) / np.ptp(data["a"]) * 2 - 1).mean())
    # Two voxels of 0.5 before the first along x, one of 2.0 along z.
    assert [float(x) for x in seen["Origin"][-1].strip("[]").split()] == [0.0, 2.0, 1.0]
    back = steps.undo_recorded(there, "v", grid)
    for r in back.collect():
        np.testing.assert_allclose(np.array(r["v"]).reshape(SHAPE), data[r["case"]], atol=1e-12)
        assert r["attributes"].keys() == {"Origin", "Spacing", "Direction"} and r["attributes"]["Origin"] == ["[1.0 2.0 3.0]"]
    with pytest.raises(ValueError, match="Clip"):
        steps.undo_recorded(there, "v", grid, strict=True)
    kept = chain.Chain((chain.normalize_step(inverse=False),))
    assert kept.undo_recorded(kept.apply_recorded(df, "v", grid), "v", grid).select(F.array_max("v").alias("m")).first()["m"] == 1.0


def test_outputs_take_the_place_of_a_group(spark, cases):
    data, df = cases
    grid = volume.Grid(SHAPE)
    steps = chain.from_config([{"Standardize": {}}])
    sources = steps.apply_recorded(df.withColumn("grp", F.lit("CT")), "v", grid).withColumn("attributes", parse.push(parse.push(F.col("attributes"), "Origin", F.lit("[1 2 3]")), "Spacing", F.lit("[1.5 1.5 3]")))
    outputs = sources.select("case", "v").unionByName(spark.createDataFrame([("none", [0.0])], "case string, v array<double>"))
    done = {r["case"]: r for r in chain.same_as_group(outputs, sources, ["case"], "grp", "CT", "v", steps, grid).collect()}
    assert done.keys() == data.keys()
    for k, x in data.items():
        np.testing.assert_allclose(np.array(done[k]["v"]).reshape(SHAPE), x, atol=1e-12)
        assert done[k]["origin"] == [1.0, 2.0, 3.0] and done[k]["spacing"] == [1.5, 1.5, 3.0] and done[k]["direction"] is None


def test_batches_are_worked_on_in_slices_of_some_bytes():
    import pyarrow as pa

    rows = [np.full(1000, float(i)) for i in range(3000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), tiles.kernels.list_column(rows)], names=["tile", "v"])
    parts = list(tiles.sliced(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 5 and all(p.nbytes <= tiles.SENT for p in parts)
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [x is None or x[0] for p in parts for x in tiles.kernels.rows_of(p.column(1))] == [*map(float, range(3000)), True]
