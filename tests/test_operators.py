"""Catalogue, report, metric, geometry and feature operators on rows that no table holds."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import features, geometry, losses, metrics, ordering, reductions, report, selection, transforms
from gridspan.operators.volume import Grid


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_order_by_ranges(spark):
    values = [(i % 7, float(v)) for i, v in enumerate(np.random.default_rng(1).permutation(500).tolist() + [3.0] * 100)] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(values, "k int, v double")
    got = ordering.with_rank(df.where("v is not null and not isnan(v)"), ["v"], ["k"], "r", 5)
    for k in range(7):
        own = sorted((r["r"], r["v"]) for r in got.where(F.col("k") == k).collect())
        assert [r for r, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    q = {r["k"]: (r["a"], r["b"]) for r in ordering.quantiles(df, ["k"], "v", [0.25, 0.9], ["a", "b"]).collect()}
    for k in range(7):
        held = [v for i, v in values if i == k and v is not None and not math.isnan(v)]
        assert q[k] == pytest.approx(tuple(np.percentile(held, [25, 90])))
    total = ordering.with_running_sum(spark.range(300).withColumn("w", F.col("id") % 5), ["id"], "w", "s", 7)
    assert [r["s"] for r in total.orderBy("id").collect()] == np.cumsum([i % 5 for i in range(300)]).tolist()
    assert ordering.with_rank(df.limit(0), ["v"]).count() == 0 and ordering.quantiles(df.where("v is null"), ["k"], "v", [0.5], ["m"]).count() == 0


def test_order_with_few_first_keys_and_odd_values(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 90).alias("b"), F.col("id").alias("c"))
    ranged = df.withColumn("r", ordering.range_of(df, ["a", "b", "c"], 8))
    sizes = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1200
    want = {tuple(r): i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])))}
    assert all(want[(r["a"], r["b"], r["c"])] == r["rank"] for r in ordering.with_rank(df, ["a", "b", "c"], ranges=8).collect())


def test_quantiles_of_odd_values(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"wide": list(rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)), "ties": [1.0] * 900 + [2.0] * 100, "signs": [-0.0, 0.0, -1.5, 1.5, -3.0], "one": [7.0], "close": list(1e9 + rng.random(400)), "ends": [float("inf"), 1.0, 2.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 5.0), (None, 6.0), ("none", None), ("none", float("nan")), ("one", float("nan"))]
    qs = [0.0, 0.1, 0.5, 0.97, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in ordering.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", qs, [f"q{i}" for i in range(5)]).collect()}
    assert got.keys() == {*groups, None} and got[None] == pytest.approx([5, 5.1, 5.5, 5.97, 6])
    for k, vs in groups.items():
        if k != "ends":
            np.testing.assert_allclose(got[k], np.quantile(vs, qs), rtol=1e-12, err_msg=k)
    assert got["ends"][0] == 1.0 and got["ends"][2] == 2.0 and got["ends"][4] == float("inf")


def test_blocks_of_a_long_log(spark):
    log = spark.range(250).select(F.lit("a").alias("k"), F.col("id").alias("step"), F.when(F.col("id") == 9, float("nan")).otherwise(F.col("id").cast("double")).alias("v"))
    blocks = ordering.last_of(log, ["k"], ["step"], 4, block=20)
    assert {r["n"] for r in blocks.groupBy("block").agg(F.count("*").alias("n")).collect()} <= {20, 23, 13, 3}
    means = {r["step"]: r["mean"] for r in losses.last_values(log, ["k"], "step", "v", 4).collect()}
    assert sorted(means) == list(range(3, 250)) and means[12] == (10 + 11 + 12) / 3 and means[249] == 247.5


def test_selectors(spark):
    df = spark.createDataFrame([("b",), ("a",), ("d",), ("c",), ("a",), (None,)], "case string")
    files = {"some.txt": spark.createDataFrame([("b",), ("x",)], "name string")}
    pick = lambda s: [r[0] for r in selection.select_cases(df, "case", s, files).orderBy("case").collect()]
    assert pick(None) == ["a", "b", "c", "d"] and pick([]) == [] and pick("~a") == ["b", "c", "d"] and pick(1) == ["b"]
    assert pick("0:2") == ["a", "b"] and pick("-3:99") == ["a", "b", "c", "d"] and pick("some.txt") == ["b"] and pick("~some.txt") == ["a", "c", "d"]
    assert pick(["a", "2:4", "~d"]) == ["a", "c"] and pick(["~a", "~b"]) == ["c", "d"] and pick("nothing") == []


def test_names_from_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a\n\n b \na\n")
    assert rows(selection.names_in(spark, str(tmp_path / "names.txt"), "case"), "case") == [("a",), ("b",)]


def test_splits_and_orders(spark):
    df = spark.range(40).withColumnRenamed("id", "case")
    folds = selection.kfold(df.union(df.limit(3)), "case", 4, 7)
    assert Counter(r["fold"] for r in folds.collect()) == {k: 10 for k in range(4)}
    assert rows(selection.kfold(df, "case", 4, 7), "case", "fold") == rows(folds, "case", "fold") != rows(selection.kfold(df, "case", 4, 8), "case", "fold")
    with pytest.raises(ValueError):
        selection.kfold(df, "case", 1)
    train, held = selection.split_names(df, df.where("case < 5"), "case")
    assert train.count() == 35 and held.count() == 5
    entries = df.select("case", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("patch"))
    order = [(r["case"], r["patch"]) for r in selection.windowed_order(entries, "case", "patch", 5, 1).orderBy("place").collect()]
    assert len(set(order)) == 120 and all(len({c for c, _ in order[k : k + 15]}) == 5 for k in range(0, 120, 15))
    loads = Counter()
    for r in selection.dealt(df.withColumn("w", F.col("case") % 9 + 1), "case", "w", 3).collect():
        loads[r["worker"]] += r["w"]
    assert max(loads.values()) - min(loads.values()) <= 9
    shards = selection.shards(df.limit(10), ["case"], 4).collect()
    assert Counter(r["shard"] for r in shards) == {k: 3 for k in range(4)} and sum(r["padding"] for r in shards) == 2
    inter = selection.interleaved(spark.createDataFrame([(0, 1, 0), (2, 0, 1), (0, 0, 0), (2, 1, 1)], "start int, copy int, patch int"), "start", "copy", "patch")
    assert [r["copy"] for r in inter.orderBy("place").collect()] == [0, 1, 0, 1]


def test_roots_aliases_and_sources(spark):
    paths = [f"data/set/{c}/{g}.mha" for c in "abc" for g in ("CT", "SEG")] + ["data/set/a/extra/x.mha", "data/other/z/CT.mha", "top.txt"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    roots = [(r["root"], r["cases"], r["groups"]) for r in selection.candidate_roots(files, "path").collect()]
    assert roots[0] == ("data/set", 3, 2) and ("data/set/a", 1, 1) not in roots
    assert rows(selection.browse(files, "path", 2), "entry", "files") == [("data", 8), ("data/other", 1), ("data/set", 7)]
    present = spark.createDataFrame([("a", "CT"), ("b", "CT"), ("b", "SEG")], "case string, grp string")
    renamed, missing = selection.aliased(present, "case", "grp", {"SEG": "LABEL"})
    assert rows(renamed, "case", "grp") == [("a", "CT"), ("b", "CT"), ("b", "LABEL")] and rows(missing, "case", "grp") == [("a", "SEG")]
    with pytest.raises(ValueError):
        selection.aliased(present, "case", "grp", {"CT": "X", "SEG": "X"})
    both = spark.createDataFrame([(None, 1, "p"), (None, 0, "q"), ("a", 1, "r"), ("a", 1, "s")], "case string, n int, v string")
    assert rows(selection.priority_source(both, "case", "n"), "case", "v") == [("a", "r"), (None, "q")]
    assert rows(selection.last_source(both, "case", "n"), "case", "v") == [("a", "s"), (None, "p")]


def test_label_maps(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 0), (2, 1, 0), (3, 0, 2), (3, 1, 0)], "voxel int, model int, label int")
    assert rows(reductions.merge_labels(df, ["voxel"], "model", "label", {0: 3, 1: 4}), "voxel", "label") == [(1, 4), (2, 0), (3, 2)]
    got = {r["voxel"]: r["disagreement"] for r in reductions.disagreement(df, ["voxel"], "label").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.5}
    only = {r["voxel"]: r["disagreement"] for r in reductions.disagreement(df, ["voxel"], "label", True).collect()}
    assert only == {1: 0.5, 2: 0.0, 3: 0.0}
    single = df.where("model = 0")
    assert {r["disagreement"] for r in reductions.disagreement(single, ["voxel"], "label").collect()} == {0.0}
    assert {r["variance"] for r in reductions.variance(single, ["voxel"], "label").collect()} == {0.0}
    channels = spark.createDataFrame([(c,) for c in range(5)], "c int")
    assert rows(reductions.split_members(channels, "c", [2, 3]), "member", "c") == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    stack = {r["voxel"]: (r["stack"], r["label"]) for r in reductions.inference_stack(df.withColumn("label", F.col("label").cast("double")), ["voxel"], "model", "label", "median").collect()}
    assert stack[1] == ([1.0, 2.0], 1.0)


def test_metrics_on_odd_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1), ("a", None, 1.0, 1), ("a", float("nan"), 1.0, 1), ("a", 5.0, 1.0, 0), ("b", None, None, 1)], "g string, o double, t double, m int")
    got = {r["g"]: (r["n"], r["mae"]) for r in metrics.regression_report(df, ["g"], F.col("o"), F.col("t"), F.col("m") == 1).collect()}
    assert got == {"a": (1, 1.0), "b": (0, None)}
    masked = {r["g"]: r["value"] for r in metrics.image_masked_mean(df.where("o is not null and not isnan(o)"), ["g"], F.col("o"), F.col("t"), F.col("m"), lambda a, b: F.abs(a - b)).collect()}
    assert masked == {"a": 0.5}
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 2, 0), (0, 3, 1), (3, 0, 1)], "o int, t int, m int")
    coefficients = {r["label"]: r["dice"] for r in metrics.dice(labels, [], "o", "t", "m").collect()}
    assert coefficients == {1: pytest.approx((2 + 1e-6) / (3 + 1e-6)), 2: pytest.approx(1e-6 / (1 + 1e-6)), 3: pytest.approx(1e-6 / (2 + 1e-6))}
    assert metrics.dice(labels, [], "o", "t", None, [7]).count() == 0
    soft = spark.createDataFrame([([0.2, 0.8], 1), ([0.9, 0.1], 0)], "s array<double>, t int")
    assert metrics.soft_dice(soft, [], F.col("s"), F.col("t"), [1]).first()["dice"] == pytest.approx((1.6 + 1e-6) / (1.9 + 1e-6))
    assert metrics.regression_report(df.limit(0), ["g"], F.col("o"), F.col("t")).count() == 0
    errors = metrics.error_map(df, "o", "t", "m").collect()
    assert errors[0]["error"] == 1.0 and errors[3]["error"] == 0.0


def test_statistics_of_nan_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", 5.0), ("b", float("nan")), (None, 2.0)], "g string, v double")
    got = {r["g"]: r for r in report.statistics(df, ["g"], "v").collect()}
    a = got["a"]
    assert (a["count"], a["mean"], a["q25"], a["q50"], a["q75"]) == (3, 3.0, 2.0, 3.0, 4.0) and a["std"] == pytest.approx(math.sqrt(8 / 3))
    assert got["b"]["count"] == 0 and got["b"]["q50"] is None and got[None]["max"] == 2.0


def test_reports(spark):
    names = spark.createDataFrame([("A:DiceLoss",), ("A:Dice",), ("A:MAE",), ("A:thing",), (None,)], "m string")
    assert [r["d"]["direction"] for r in names.select(report.direction(F.col("m")).alias("d")).collect()] == ["min", "max", "min", "min", "min"]
    declared = spark.createDataFrame([("MAE", "max"), ("Dice", "what")], "m string, d string")
    assert [tuple(r["x"]) for r in declared.select(report.direction(F.col("m"), F.col("d")).alias("x")).collect()] == [("max", "declared"), ("max", "heuristic:max")]
    files = spark.createDataFrame([("/r/a/Metric_TRAIN.json", 3), ("/r/b/Metric_TRAIN.json", 5), ("/r/b/Metric_TEST.json", 1), ("/r/x.json", 9)], "path string, t int")
    assert rows(report.splits(files, "path"), "split") == [("TEST",), ("TRAIN",)]
    assert [r["path"] for r in report.newest_files(files, "path", "t", "TRAIN").collect()] == ["/r/b/Metric_TRAIN.json", "/r/a/Metric_TRAIN.json"]
    metrics_ = spark.createDataFrame([("P:CT:MAE",), ("P:CT:MSE",), ("P:CT:",)], "m string")
    assert report.common_prefix(metrics_, "m").first()["prefix"] == "P:CT" and report.matching(metrics_, "m", "MAE").count() == 1
    logs = spark.createDataFrame([("r", 1, "fine"), ("r", 2, "Traceback (most recent call last):"), ("r", 3, "  at x"), ("r", 4, "ValueError: bad"), ("s", 1, "fine")], "run string, n int, text string")
    assert rows(report.error_excerpt(logs, "run", "n", "text"), "run", "error") == [("r", "Traceback (most recent call last):\n  at x\nValueError: bad")]
    record = report.run_record(spark.createDataFrame([("r",), ("q",)], "run string"), spark.createDataFrame([("r", "MAE", 0.5)], "run string, m string, v double"), logs, "run", "m", "v", "n", "text", 2)
    got = {r["run"]: (r["metrics"], r["log_tail"]) for r in record.collect()}
    assert got == {"r": ({"MAE": 0.5}, ["  at x", "ValueError: bad"]), "q": ({}, [])}
    assert report.flattened({"a": {"b": 1, "c": {"d": None}}, "e": [1]}) == [("a.b", "1"), ("a.c.d", "None"), ("e", "[1]")]
    points = spark.createDataFrame([("r", 0, 2.0), ("r", 1, 2.0), ("r", 2, float("nan"))], "run string, step int, v double")
    assert report.best_checkpoint(points, "run", "step", "v", True).first()["step"] == 0
    plane = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, 9.0)], "case string, z int, x int, v double")
    assert rows(report.preview(plane, ["case"], "z", 0, "v", ["x"]), "x", "v") == [(0, 0.0), (1, 1.0)]
    assert rows(report.preview(plane, ["case"], "z", None, "v", ["x"]), "x", "v") == [(0, 1.0), (1, 0.0)]
    assert report.filtered_tags(plane.withColumn("tag", F.lit("loss/train")), "tag", ["train"]).count() == 3
    new, last = report.latest_per_stage(logs.withColumn("stage", F.col("run")), "stage", "n", 2)
    assert rows(new, "stage", "n") == [("r", 4), ("s", 1)] and last.count() == 2


def test_long_form_transforms(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 3.0), (None, 0, 5.0)], "case string, x int, value double")
    assert rows(transforms.standardize(df, "case", "value"), "case", "value")[:2] == [("a", 0.0), ("a", 0.0)]
    assert {r["value"] for r in transforms.normalize(df, "case", "value", 0.0, 1.0).collect()} == {0.0, 1.0}
    cube = spark.createDataFrame([("a", z, x, float(z == 2 and x == 0)) for z in range(5) for x in range(3)], "case string, z int, x int, value double")
    grown = transforms.dilate(cube, "case", ["z", "x"], "value", 1)
    assert {(r["z"], r["x"]) for r in grown.where("value > 0").collect()} == {(z, x) for z in (1, 2, 3) for x in (0, 1)}


def test_spatial_transforms(spark):
    turn = [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0]]
    stretch = [[2.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.5, 0.0], [0.0, 0.0, 1.0, -1.0]]
    df = spark.createDataFrame([([turn, stretch], 1.0, 2.0, 3.0)], "t array<array<array<double>>>, x double, y double, z double")
    whole = df.withColumn("m", geometry.composed(F.col("t")))
    want = (np.vstack([stretch, [0, 0, 0, 1]]) @ np.vstack([turn, [0, 0, 0, 1]]))[:3]
    np.testing.assert_allclose(whole.first()["m"], want)
    moved = geometry.moved_points(whole, ["x", "y", "z"], F.col("m")).first()
    np.testing.assert_allclose([moved[c] for c in "xyz"], want @ [1, 2, 3, 1])
    from gridspan.operators.volume import rigid_affine

    m = rigid_affine([0.2, -0.3, 0.4], [1.0, 2.0, 3.0])
    r = spark.createDataFrame([(m, [5.0, 6.0, 7.0], np.eye(3).ravel().tolist())], "m array<array<double>>, o array<double>, d array<double>")
    got = r.select(geometry.rigid_parameters(F.col("m")).alias("p"), geometry.moved_geometry(F.col("o"), F.col("d"), F.col("m")).alias("g")).first()
    np.testing.assert_allclose(got["p"], [0.2, -0.3, 0.4, 1, 2, 3])
    a = np.array(m)
    np.testing.assert_allclose(got["g"]["origin"], a[:, :3].T @ (np.array([5, 6, 7]) - a[:, 3]))
    np.testing.assert_allclose(np.array(got["g"]["direction"]).reshape(3, 3), a[:, :3].T)
    text = '(Transform "EulerTransform")\n// note\n(TransformParameters 0.1 0.2 0.3 1 2 3)\n(CenterOfRotationPoint 4 5 6)\n'
    e = spark.createDataFrame([(text,), ('(Transform "TranslationTransform")\n(TransformParameters 7 8 9)',), ('(Transform "Other")',)], "s string").withColumn("p", geometry.parameter_map(F.col("s")))
    found = [x["t"] for x in e.select(geometry.transform_of_parameters(F.col("p")).alias("t")).collect()]
    c = np.array([4, 5, 6])
    np.testing.assert_allclose(np.array(found[0])[:, :3] @ c + np.array(found[0])[:, 3], c + [1, 2, 3])
    np.testing.assert_allclose(np.array(found[0])[:, :3] @ np.array(found[0])[:, :3].T, np.eye(3), atol=1e-12)
    np.testing.assert_allclose(np.array(found[1])[:, 3], [7, 8, 9])
    assert found[2] is None
    spacing, size = geometry.resized_spacing([1.0, 0.5, 2.0], [10, 20, 5])
    assert spacing == [0.5] * 3 and size == [20, 20, 20]


def test_boxes_of_labels(spark):
    df = spark.createDataFrame([("a", z, x, int(z in (2, 3) and x == 4)) for z in range(6) for x in range(6)] + [("b", 0, 0, 0)], "case string, z int, x int, label int")
    boxes = geometry.label_boxes(df, ["case"], "label", [1], ["z", "x"], {"x": 3}, {"z": 6, "x": 6})
    assert [tuple(r) for r in boxes.collect()] == [("a", 2, 1, 4, 6)]
    cut = geometry.cropped(df, ["case"], boxes, ["z", "x"])
    assert cut.columns == df.columns and rows(cut.where("label = 1"), "z", "x") == [(0, 3), (1, 3)] and cut.count() == 10


def test_feature_criteria(spark):
    def network(x):
        return [x * 2, x[:, :2] ** 2]

    data = [(k, [float(k + i) for i in range(4)], [float(i) for i in range(4)]) for k in range(5)]
    df = spark.createDataFrame([*data, (9, None, [0.0] * 4)], "k int, a array<double>, b array<double>")
    got = {r["k"]: r["loss"] for r in features.perceptual(df, network, "a", "b", [1.0, 0.5]).collect()}
    for k, a, b in data:
        a, b = np.array(a), np.array(b)
        assert got[k] == pytest.approx(np.abs(2 * a - 2 * b).mean() + 0.5 * np.abs(a[:2] ** 2 - b[:2] ** 2).mean())
    assert got[9] is None
    styled = features.style(df.where("k = 1"), network, "a", "b", [1.0, 0.0], [2, 1]).first()["loss"]
    gram = lambda x: x.reshape(2, -1) @ x.reshape(2, -1).T / x.size
    assert styled == pytest.approx(np.abs(gram(2 * np.array(data[1][1])) - gram(2 * np.array(data[1][2]))).sum())
    tiles = features.tiled(df.where("k < 5"), ["k"], lambda x: x, "a", "b", Grid((2, 2)), (1, 2), [1.0])
    assert {r["k"]: r["loss"] for r in tiles.collect()} == {k: float(k) for k in range(5)}
    assert features.projected(df.where("k < 5"), lambda x: x, "a", "a", 1).agg(F.max("loss")).first()[0] == 0
    assert features.frechet(df.where("k < 5"), df.where("k < 5"), lambda x: x, "a") == pytest.approx(0, abs=1e-6)


def test_mutual_information_of_blocks(spark, monkeypatch):
    """A volume in one row or in many blocks, over more groups than a worker holds; null arrays and keys."""
    monkeypatch.setattr(metrics, "HELD", 3)
    rng = np.random.default_rng(5)
    data = {k: (rng.random(60), rng.random(60)) for k in [*range(9), None]}
    whole = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in data.items()] + [(99, None, [0.5])], "k int, a array<double>, b array<double>")
    blocks = spark.createDataFrame([(k, a[i : i + 7].tolist(), b[i : i + 7].tolist()) for k, (a, b) in data.items() for i in range(0, 60, 7)], "k int, a array<double>, b array<double>").repartition(5)

    def plain(a, b, bins=11):
        t, width = np.linspace(0, 1, bins), 0.5 / (bins - 1)
        wa, wb = (np.exp(-((v[:, None] - t) ** 2) / (2 * width**2)) for v in (a, b))
        p = (wa / wa.sum(1, keepdims=True)).T @ (wb / wb.sum(1, keepdims=True)) / len(a)
        return sum(p[i, j] * math.log((p[i, j] + 1e-7) / (p[i].sum() * p[:, j].sum() + 1e-7) + 1e-7) for i in range(bins) for j in range(bins))

    for df in (whole, blocks):
        got = {r["k"]: (r["n"], r["mutual_information"]) for r in metrics.mutual_information(df, ["k"], "a", "b", 11).collect()}
        assert got.keys() == data.keys() and all(got[k] == (60, pytest.approx(plain(*v))) for k, v in data.items())
    assert metrics.mutual_information(whole.limit(0), ["k"], "a", "b").count() == 0
