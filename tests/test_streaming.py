"""Streams: windows with late data, volumes put together from patches, alignment, publication, log tails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import volume
from gridspan.sources import logs
from gridspan.operators import kernels
from gridspan.streaming import control, slabs, windows


def stream(spark, folder, schema, batches):
    """A file stream that takes one file a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def drained(df, folder, mode="append", name="out"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/check-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query, df.sparkSession.table(name).collect()


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_windows_leave_out_late_events(spark, tmp_path):
    batches = [[("a", at(1), 1.0), ("a", at(8), 2.0)], [("a", at(40), 4.0)], [("a", at(41), 8.0)], [("a", at(2), 99.0)], [("a", at(90), 16.0)]]
    events = windows.late_safe(stream(spark, tmp_path, "key string, ts timestamp, value double", batches), "ts", "5 minutes")
    query, rows = drained(windows.tumbling(events, "ts", ["key"], "value", "10 minutes"), tmp_path, name="tumbling")
    assert sorted((r["start"].minute, r["n"], r["total"]) for r in rows) == [(0, 2, 3.0), (40, 2, 12.0)]
    _, rows = drained(windows.sliding(events, "ts", ["key"], "value", "20 minutes", "10 minutes"), tmp_path, name="sliding")
    assert {(r["start"].minute, r["total"]) for r in rows} >= {(0, 3.0), (30, 12.0), (40, 12.0)}
    _, rows = drained(windows.session(events, "ts", ["key"], "value", "15 minutes"), tmp_path, name="session")
    assert sorted((r["n"], r["total"]) for r in rows) == [(2, 3.0), (2, 12.0)]


def test_repeats_and_newest(spark, tmp_path):
    batches = [[("x", at(1), 1.0), ("x", at(1), 1.0)], [("x", at(1), 1.0), ("y", at(3), 2.0)]]
    events = stream(spark, tmp_path, "key string, ts timestamp, value double", batches)
    _, rows = drained(windows.once(events, "ts", "1 hour", ["key"]), tmp_path, name="once")
    assert sorted(r["key"] for r in rows) == ["x", "y"]
    _, rows = drained(slabs.revisions(events, "key", "ts"), tmp_path, name="revisions")
    assert sorted(r["key"] for r in rows) == ["x", "y"]
    _, rows = drained(windows.newest(events, ["key"], "ts", ["value"]), tmp_path, "complete", "newest")
    assert sorted((r["key"], r["value"]) for r in rows) == [("x", 1.0), ("y", 2.0)]


SHAPE, PATCH, OVERLAP = (5, 3, 4), (2, 3, 3), (1, 0, 2)


def pieces():
    cube = np.random.default_rng(7).normal(size=SHAPE)
    out = []
    for k, (a, b) in enumerate(volume.cells(SHAPE, PATCH, OVERLAP)):
        own = np.zeros(PATCH)
        held = cube[tuple(slice(x, y) for x, y in zip(a, b, strict=True))]
        own[tuple(slice(0, n) for n in held.shape)] = held + k
        out.append((k, own.ravel().tolist()))
    return out


def whole(kind, spark):
    rows = spark.createDataFrame([("a", *p) for p in pieces()], "case string, patch_idx int, values array<double>")
    return np.array(volume.blend(rows, ["case"], "values", volume.Grid(SHAPE), PATCH, OVERLAP, kind).first()["values"]).reshape(SHAPE)


@pytest.mark.parametrize("kind", ["cosinus", None])
def test_slabs_come_as_they_are_final(spark, tmp_path, kind):
    all_pieces = pieces()
    batches = [[(c, *p) for c in "ab" for p in all_pieces[k : k + 3]] for k in range(0, len(all_pieces), 3)]
    batches[1].append(("a", *all_pieces[3]))
    patches = stream(spark, tmp_path, "case string, patch_idx int, values array<double>", batches)
    _, rows = drained(slabs.assembled(patches, SHAPE, PATCH, OVERLAP, kind), tmp_path, name=f"slabs_{kind}")
    want = whole(kind, spark)
    for case in "ab":
        own = sorted((r["start"], r["stop"], r["values"]) for r in rows if r["case"] == case)
        assert own[0][0] == 0 and own[-1][1] == SHAPE[0] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and len(own) > 2
        np.testing.assert_allclose(np.concatenate([np.array(v).reshape(-1, *SHAPE[1:]) for _, _, v in own]), want, atol=1e-9)


def test_late_patches_are_counted_or_errors(spark, tmp_path):
    all_pieces = pieces()
    order = [p for p in all_pieces if p[0] != 1] + [all_pieces[1]]
    batches = [[("a", *p)] for p in order]
    patches = stream(spark, tmp_path, "case string, patch_idx int, values array<double>", batches)
    query, _ = drained(slabs.assembled(patches, SHAPE, PATCH, OVERLAP, "mean", strict=False), tmp_path, name="late")
    assert query.exception() is None
    with pytest.raises(Exception, match="final"):
        drained(slabs.assembled(patches, SHAPE, PATCH, OVERLAP, "mean"), tmp_path, name="strict")


def test_alignment_waits_for_all_streams(spark, tmp_path):
    batches = [[("a", 0, 0, [1.0]), ("a", 0, 1, [2.0]), ("a", 1, 1, [5.0])], [("a", 1, 0, [4.0])], [("a", 0, 2, [3.0])]]
    planes = stream(spark, tmp_path, "case string, stream int, z int, values array<double>", batches)
    _, rows = drained(slabs.aligned(planes, "stream", 2), tmp_path, name="aligned")
    assert sorted((r["z"], r["values"]) for r in rows) == [(0, [[1.0], [4.0]]), (1, [[2.0], [5.0]])]
    ends = spark.createDataFrame([("a", 0, 4), ("a", 0, 6), ("a", 1, 5)], "case string, stream int, stop int")
    assert [tuple(r) for r in slabs.frontier(ends, ["case"], "stream", "stop").collect()] == [("a", 5, 2)]


def test_contract_and_halos(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 2), ("a", 2, 1), ("a", 3, 9), ("b", 0, 3)], "case string, n int, start int")
    assert sorted((r["case"], r["n"]) for r in slabs.out_of_contract(rows, ["case"], "n", "start", 4).collect()) == [("a", 2), ("a", 3), ("b", 0)]
    planes = spark.createDataFrame([("a", z, [float(z)]) for z in range(4)], "case string, z int, values array<double>")
    assert [r["near"] for r in slabs.halo_planes(planes, ["case"], "z", "values", 1).orderBy("z").collect()][:2] == [[[0.0], [1.0]], [[0.0], [1.0], [2.0]]]


def test_publication_is_repeatable(spark, tmp_path):
    batches = [[("a", at(1), 1.0)], [("b", at(2), 2.0)]]
    events = stream(spark, tmp_path, "key string, ts timestamp, value double", batches)
    sink = slabs.publish(str(tmp_path / "out"))
    for _ in range(2):
        # A second run without its checkpoint sends the batches again.
        events.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{_}")).start().awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_metrics_of_a_stream(spark, tmp_path):
    batches = [[("a", 1.0, 2.0), ("a", 3.0, 3.0)], [("a", 0.0, 4.0)]]
    voxels = stream(spark, tmp_path, "case string, o double, t double", batches)
    _, rows = drained(slabs.streamed_metrics(voxels, ["case"], "o", "t"), tmp_path, "complete", "metrics")
    assert [tuple(r) for r in rows] == [("a", 3, pytest.approx(5 / 3), pytest.approx(17 / 3))]


def test_log_tail(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    line = "Training : Loss (Net(0.1) : MAE(1.00) : {v}) CPU (1.00 %):  10% {s}/20 [00:01<00:31,  1.81it/s]"
    for k in range(3):
        (tmp_path / "logs" / f"{k}.txt").write_text(line.format(v=0.5 - k / 10, s=k + 1) + "\n")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path / "logs"))
    live = logs.live(lines, "value").withColumn("loss", F.try_element_at("metrics", F.lit("Net:MAE"))).select("stage", "step", "loss")
    _, rows = drained(windows.newest(live, ["stage"], "step", ["loss"]), tmp_path, "complete", "tail")
    assert [tuple(r) for r in rows] == [("Training", 3, pytest.approx(0.3))]


def test_a_region_stage_on_planes(spark, tmp_path):
    """A streamed box mean equals the whole one, planes out of order and repeated ones included; state holds 2 r + 1 planes; a restart goes on."""
    depth, shape, radius = 9, (3, 4), 1
    cube = np.random.default_rng(3).normal(size=(depth, *shape))
    pieces = [("a", z, cube[z].ravel().tolist()) for z in range(depth)]
    batches = [pieces[:2], [pieces[3], pieces[2]], [pieces[2]], pieces[4:8]]
    produce = lambda window, z, a: kernels.box_mean(window, radius)[z - a]
    planes = stream(spark, tmp_path, "case string, z int, values array<double>", batches)
    done = slabs.region_stage(planes, depth, shape, slabs.halo(depth, radius), produce)

    def run():
        query = done.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return {r["z"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert sorted(run()) == list(range(7))
    spark.createDataFrame(pieces[8:], "case string, z int, values array<double>").write.mode("append").parquet(f"{tmp_path}/in/9")
    rows = run()
    assert sorted(rows) == list(range(depth)) and max(r["held"] for r in rows.values()) <= 2 * radius + 1
    want = kernels.box_mean(cube, radius)
    for z, r in rows.items():
        np.testing.assert_allclose(np.array(r["values"]).reshape(shape), want[z], atol=1e-12)


def test_a_stream_stops_after_its_patience(spark, tmp_path):
    scores = [3.0, 2.0, 2.5, 2.4, 1.0, 0.9, 0.95, 0.99, 0.5, 0.4]
    rows = stream(spark, tmp_path, "loss double", [[(s,)] for s in scores])
    watch = control.Patience(spark, f"{tmp_path}/memory", F.avg("loss"), patience=2)
    query = rows.writeStream.foreachBatch(watch.watch).option("checkpointLocation", f"{tmp_path}/check").start()
    listener = control.stop_when(query, watch.over)
    try:
        assert query.awaitTermination(120)
    finally:
        spark.streams.removeListener(listener)
    # 2.5 and 2.4 better nothing. What has begun meanwhile ends first.
    held = watch.state()
    assert watch.over() and held["best"] <= 2.0 and 3 <= held["batch"] < len(scores) - 1
    before = held["batch"]
    query = rows.writeStream.foreachBatch(control.Patience(spark, f"{tmp_path}/memory", F.avg("loss"), patience=100).watch).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert watch.state()["batch"] == len(scores) - 1 > before and watch.state()["best"] == 0.4


def test_a_control_file_stops_a_stream(spark, tmp_path):
    rows = stream(spark, tmp_path, "x int", [[(k,)] for k in range(6)])
    seen = []

    def take(batch, number):
        seen.append(number)
        if number == 1:
            (tmp_path / "stop").write_text("")

    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check").start()
    listener = control.stop_when(query, control.flagged(spark, f"{tmp_path}/stop"))
    try:
        assert query.awaitTermination(120) and seen[:2] == [0, 1]
    finally:
        spark.streams.removeListener(listener)
