"""Registrations scored by image, labels and landmarks, against plain NumPy."""

import numpy as np
import pytest

from gridspan.operators.volume import Grid
from gridspan.plans import registration

GRID = Grid((6, 7, 8))


def test_each_modality_that_is_there(spark):
    rng = np.random.default_rng(1)
    fixed = rng.normal(size=GRID.shape)
    moving = np.roll(fixed, 2, axis=2)
    seg = (rng.random(GRID.shape) > 0.5).astype(int) + (np.arange(8) > 4)
    shift = [np.zeros(GRID.size).tolist(), np.zeros(GRID.size).tolist(), np.full(GRID.size, 2.0).tolist()]
    mask = np.zeros(GRID.shape)
    mask[:, :, :6] = 1
    points = rng.uniform(1, 5, (4, 3))
    flat = lambda x: np.ravel(x).astype(float).tolist()
    there = (points + [0, 0, 2]).tolist()
    rows = [
        ("moved", flat(fixed), flat(moving), flat(seg), flat(np.roll(seg, 2, axis=2)), flat(mask), points.tolist(), there, *shift),
        ("identity", flat(fixed), flat(moving), None, flat(seg), flat(mask), points.tolist(), there, None, None, None),
        ("none", None, flat(moving), None, None, None, [], None, *shift),
    ]
    df = spark.createDataFrame(rows, "k string, f array<double>, m array<double>, fs array<double>, ms array<double>, w array<double>, fp array<array<double>>, mp array<array<double>>, d0 array<double>, d1 array<double>, d2 array<double>")
    out = registration.evaluate(df, ["k"], GRID, ["d0", "d1", "d2"], ("f", "m"), ("fs", "ms"), ("fp", "mp"), "w")
    got = {(r["k"], r["metric"]): r["value"] for r in out.collect()}
    assert set(got) == {("moved", "MAE"), ("moved", "Dice"), ("moved", "TRE"), ("identity", "MAE"), ("identity", "TRE")}
    assert got["moved", "MAE"] == pytest.approx(0, abs=1e-12) and got["moved", "TRE"] == pytest.approx(0, abs=1e-12)
    assert got["identity", "MAE"] == pytest.approx(np.abs(fixed - moving)[:, :, :6].mean()) and got["identity", "TRE"] == pytest.approx(2.0)
    # Two planes come from beyond the volume: background.
    seen = seg.copy()
    seen[:, :, 6:] = 0
    assert got["moved", "Dice"] == pytest.approx(np.mean([2 * ((seg == v) & (seen == v)).sum() / ((seg == v).sum() + (seen == v).sum()) for v in (1, 2)]))
    with pytest.raises(ValueError, match="nothing"):
        registration.evaluate(df, ["k"], GRID, ["d0", "d1", "d2"])
