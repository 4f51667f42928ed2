"""Configured parts by name: built-in ones, those of other modules, and settings that no part has."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import volume
from gridspan.operators.tiles import Tiling
from gridspan.plans import extensions as ext

#: Parts of another library, found by module:attribute.
OWN = __name__


def largest_error(df, keys, output, target, scale=1.0):
    return df.groupBy(*keys).agg((F.max(F.abs(F.col(output) - F.col(target))) * scale).alias("value"))


def ramp(patch, overlap, power=1):
    return [float(min(i + 1, patch - i)) ** power for i in range(patch)]


def test_criteria_and_reductions(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.0), ("b", 5.0, 4.0)], "k string, o double, t double")
    got = {(r["k"], r["metric"]): r["value"] for r in ext.evaluate(df, ["k"], "o", "t", ["MAE", {"MSE": None}, "Accuracy", {f"{OWN}:largest_error": {"scale": 10.0}}]).collect()}
    assert got == {("a", "MAE"): 1.0, ("b", "MAE"): 1.0, ("a", "MSE"): 2.0, ("b", "MSE"): 1.0, ("a", "Accuracy"): 0.5, ("b", "Accuracy"): 0.0, ("a", f"{OWN}:largest_error"): 20.0, ("b", f"{OWN}:largest_error"): 10.0}
    assert {r["k"]: r["o"] for r in ext.reduced(df, ["k"], "o", "Mean").collect()} == {"a": 1.5, "b": 5.0}
    with pytest.raises(ValueError, match="criterion MAE"):
        ext.evaluate(df, ["k"], "o", "t", [{"MAE": {"nonsense": 1}}])
    with pytest.raises(KeyError, match="known"):
        ext.reduced(df, ["k"], "o", "Nothing")


def test_schedules_selectors_and_augmentations(spark):
    steps = ext.scheduled(spark.range(4), "id", "f", [{"Constant": {"value": 2.0}}, {"Warmup": {"steps": 2}}]).orderBy("id").collect()
    assert steps[0]["f"] < steps[-1]["f"] == 2.0
    cases = spark.createDataFrame([("p1",), ("p2",), ("q1",), (None,)], "case string")
    assert [r["case"] for r in ext.selected(cases, "case", [{"Matching": {"pattern": "^p"}}, {"Without": {"cases": ["p1"]}}]).collect()] == ["p2"]
    grid = volume.Grid((2, 3))
    x = np.arange(6.0)
    df = spark.createDataFrame([(c, k, x.tolist()) for c in range(40) for k in range(2)], "case int, copy int, v array<double>")
    rows = ext.augmented(df, "v", grid, "case", "copy", [{"Flip": {"axes": [1]}}], 0.5).collect()
    flipped = x.reshape(2, 3)[:, ::-1].ravel().tolist()
    assert all(r["v"] == x.tolist() for r in rows if r["copy"] == 0)
    share = np.mean([r["v"] == flipped for r in rows if r["copy"] == 1])
    assert 0.2 < share < 0.8 and all(r["v"] in (flipped, x.tolist()) for r in rows)
    foreign = ext.augmented(df, "v", grid, "case", "copy", [{"Foreign": {"function": lambda v, rng: v + 1}}, {"Scale": {"deviation": 0.0}}]).where("copy = 1").first()
    np.testing.assert_allclose(foreign["v"], x + 1)


def test_blendings_sources_and_sinks(spark, tmp_path):
    tiling, patch, overlap = Tiling((6, 5), (6, 5)), (4, 3), (2, 1)
    x = np.random.default_rng(0).normal(size=(6, 5))
    df = spark.createDataFrame([("a", x.ravel().tolist())], "case string, v array<double>")
    pieces = volume.patches(df, ["case"], "v", volume.Grid((6, 5)), patch, overlap)
    for config in ("Mean", "Gaussian", {f"{OWN}:ramp": {"power": 2}}):
        done = ext.blended(pieces, ["case"], "v", tiling, patch, overlap, config).first()
        np.testing.assert_allclose(np.array(done["v"]).reshape(6, 5), x, atol=1e-12)
    rows = df.select("case", F.lit("CT").alias("grp"), F.array(*map(F.lit, (1, 6, 5))).alias("shape"), F.lit("<f8").alias("dtype"), *[F.array(*map(F.lit, v)).alias(n) for n, v in (("origin", (0.0, 0.0)), ("spacing", (1.0, 1.0)), ("direction", (1.0, 0.0, 0.0, 1.0)))], F.col("v").alias("values"))
    ext.write(rows, str(tmp_path), "mha")
    assert ext.read(spark, str(tmp_path), "Volumes").first()["values"] == x.ravel().tolist()
    assert ext.read(spark, str(tmp_path), {"Planes": {"rows": (1, 2)}}).first()["values"] == x[1].tolist()
    assert sys.modules[OWN]
