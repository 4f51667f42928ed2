"""Volume files, landmarks, logs and saved steps: round trips, region reads, and files that are none."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.sources import headers, logs, tables, volumes

SHAPE = (1, 4, 5, 6)
GEOMETRY = ([10.0, 20.0, 30.0], [0.5, 1.5, 2.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])


@pytest.fixture(scope="module")
def volume():
    return np.arange(np.prod(SHAPE), dtype=np.float32).reshape(SHAPE)


def rows(volume, dtype="<f4", names=("CASE_000", "CASE_001")):
    return [(n, "CT", list(volume.shape), dtype, *GEOMETRY, (volume.astype(float) + k).ravel().tolist()) for k, n in enumerate(names)]


FIELDS = "case string, grp string, shape array<int>, dtype string, origin array<double>, spacing array<double>, direction array<double>, values array<double>"


@pytest.fixture(scope="module")
def root(spark, volume, tmp_path_factory):
    path = tmp_path_factory.mktemp("volumes")
    volumes.write(spark.createDataFrame(rows(volume), FIELDS), str(path))
    (path / "CASE_000" / "notes.txt").write_text("no volume")
    packed = headers.Header("mha", SHAPE, "<f4", *map(tuple, GEOMETRY))
    text = headers.meta_bytes(volume * 2, packed)
    at = text.index(b"LOCAL\n") + 6
    (path / "CASE_001" / "packed.mha").write_bytes(text[:at].replace(b"CompressedData = False", b"CompressedData = True") + zlib.compress(text[at:]))
    pair = np.concatenate([volume, volume + 500])
    (path / "CASE_001" / "pair.mha").write_bytes(headers.meta_bytes(pair.astype("<i2"), headers.Header("mha", pair.shape, "<i2", *map(tuple, GEOMETRY))))
    with open(path / "CASE_000" / "label.npy", "wb") as f:
        np.save(f, (volume % 3).astype(np.uint8))
    for name, pack in (("brain.nii", lambda b: b), ("packed_brain.nii.gz", gzip.compress)):
        head = bytearray(352)
        head[:4] = struct.pack("<i", 348)
        head[40:56] = struct.pack("<8h", 3, 6, 5, 4, 1, 1, 1, 1)
        head[70:72] = struct.pack("<h", 16)
        head[76:108] = struct.pack("<8f", 1, 0.5, 1.5, 2, 1, 1, 1, 1)
        head[108:112] = struct.pack("<f", 352)
        head[254:256] = struct.pack("<h", 1)
        head[280:328] = struct.pack("<12f", -0.5, 0, 0, -10, 0, -1.5, 0, -20, 0, 0, 2, 30)
        (path / "CASE_000" / name).write_bytes(pack(bytes(head) + volume.tobytes()))
    (path / "CASE_000" / "broken.mha").write_bytes(b"ObjectType = Image\nNDims = 3\n")
    return str(path)


def test_catalogue_from_headers(spark, root):
    table = volumes.catalog(volumes.files(spark, root))
    got = {(r["case"], r["grp"]): r for r in table.collect()}
    assert set(got) == {("CASE_000", "CT"), ("CASE_001", "CT"), ("CASE_001", "packed"), ("CASE_001", "pair"), ("CASE_000", "label"), ("CASE_000", "brain"), ("CASE_000", "packed_brain")}
    for name in ("CT", "brain", "packed_brain"):
        r = got["CASE_000", name]
        assert tuple(r["shape"]) == SHAPE and np.allclose(r["origin"], GEOMETRY[0]) and np.allclose(r["spacing"], GEOMETRY[1]) and np.allclose(r["direction"], GEOMETRY[2])
    assert got["CASE_000", "label"]["is_label"] and not got["CASE_000", "CT"]["is_label"] and got["CASE_001", "pair"]["interleaved"]
    assert {r["path"].rpartition("/")[2] for r in volumes.unreadable(volumes.files(spark, root)).collect()} == {"notes.txt", "broken.mha"}
    assert [r["case"] for r in volumes.case_names(table, "C*").collect()] == ["CASE_000", "CASE_001"] and volumes.case_names(table, "la?el").count() == 0
    assert {r["grp"]: r["cases"] for r in volumes.size(table).collect()}["CT"] == 2
    assert {r["grp"] for r in volumes.groups(table).collect()} == {"CT", "packed", "pair", "label", "brain", "packed_brain"}


def test_whole_volumes_and_planes(spark, root, volume):
    found = volumes.files(spark, root)
    got = {(r["case"], r["grp"]): np.array(r["values"]) for r in volumes.read(found).collect()}
    np.testing.assert_array_equal(got["CASE_000", "CT"], volume.ravel())
    np.testing.assert_array_equal(got["CASE_001", "CT"], volume.ravel() + 1)
    np.testing.assert_array_equal(got["CASE_001", "packed"], volume.ravel() * 2)
    np.testing.assert_array_equal(got["CASE_001", "pair"], np.concatenate([volume, volume + 500]).ravel())
    np.testing.assert_array_equal(got["CASE_000", "label"], (volume % 3).ravel())
    np.testing.assert_array_equal(got["CASE_000", "packed_brain"], volume.ravel())
    some = {(r["grp"], r["c"], r["z"]): r["values"] for r in volumes.planes(found.where("case = 'CASE_001'"), 1, 3).collect()}
    assert {k[2] for k in some} == {1, 2} and some["packed", 0, 2] == (volume[0, 2] * 2).ravel().tolist()
    assert volumes.planes(found.where("grp = 'CT'"), 9, 12).count() == 0


def test_region_reads_move_the_origin(spark, root, volume):
    r = volumes.region(volumes.files(spark, root).where("grp = 'CT' and case = 'CASE_000'"), (1, 2, 3), (3, 5, 6)).first()
    np.testing.assert_array_equal(np.array(r["values"]).reshape(2, 3, 3), volume[0, 1:3, 2:5, 3:6])
    assert list(r["origin"]) == [10 + 3 * 0.5, 20 + 2 * 1.5, 30 + 1 * 2.0]
    moved = headers.region_of(headers.Header("mha", SHAPE, "<f4", *map(tuple, GEOMETRY)), (1, 2, 3), (3, 5, 6))
    assert moved.origin == (11.5, 23.0, 32.0) and moved.shape == (1, 2, 3, 3)


def test_statistics_by_planes(spark, root, volume):
    got = {r["grp"]: r for r in volumes.statistics(volumes.files(spark, root).where("case = 'CASE_000' and grp in ('CT', 'label')")).collect()}
    assert (got["CT"]["min"], got["CT"]["max"]) == (volume.min(), volume.max()) and got["CT"]["std"] == pytest.approx(volume.std(ddof=1))
    assert got["label"]["mean"] == pytest.approx((volume % 3).mean())


def test_writes_replace_and_leave_no_staging(spark, volume, tmp_path):
    for kind in ("mha", "npy"):
        root = str(tmp_path / kind)
        for k in (0, 7):
            volumes.write(spark.createDataFrame(rows(volume + k, "<i2"), FIELDS), root, kind)
        got = volumes.read(volumes.files(spark, root)).where("case = 'CASE_000'").first()
        np.testing.assert_array_equal(got["values"], volume.ravel() + 7)
        assert got["dtype"] == "<i2" and sorted(p.name for p in (tmp_path / kind).iterdir()) == ["CASE_000", "CASE_001"]
    bad = spark.createDataFrame(rows(volume), FIELDS).withColumn("shape", F.array(F.lit(9)))
    with pytest.raises(Exception, match="(?s)reshape|Write"):
        volumes.write(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    with pytest.raises(Exception, match="(?s)not written"):
        volumes.write(bad, str(tmp_path / "h5"), "h5")


def test_zarr_stores(spark, volume, tmp_path):
    big = np.arange(1 * 20 * 3 * 4, dtype=np.float32).reshape(1, 20, 3, 4)
    volumes.write(spark.createDataFrame(rows(big), FIELDS), str(tmp_path), "zarr")
    chunks = volumes.zarr(spark, str(tmp_path)).where("case = 'CASE_000'")
    got = {tuple(r["chunk"]): r for r in chunks.collect()}
    assert set(got) == {(0, 0, 0, 0), (0, 1, 0, 0)}
    r = got[0, 1, 0, 0]
    assert tuple(r["shape"]) == big.shape and list(r["spacing"]) == GEOMETRY[1] and list(r["origin"]) == GEOMETRY[0]
    whole = np.concatenate([np.array(got[0, k, 0, 0]["values"]).reshape(1, 16, 3, 4) for k in (0, 1)], 1)[:, :20]
    np.testing.assert_array_equal(whole, big)
    assert [tuple(x["chunk"]) for x in volumes.chunk_filter(chunks, (0, 17, 0, 0), (1, 19, 3, 4), (1, 16, 3, 4)).collect()] == [(0, 1, 0, 0)]
    meta = json.loads((tmp_path / "CASE_000" / "CT.zarr" / "0" / "zarr.json").read_text())
    assert headers.zarr_header(meta, {}).shape == big.shape


def dicom_slice(pixels, z, instance, series="1.2.3", explicit=True):
    def element(group, number, vr, body):
        body += b" " * (len(body) % 2)
        if explicit or group == 2:
            size = struct.pack("<H", 0) + struct.pack("<I", len(body)) if vr in (b"OW",) else struct.pack("<H", len(body))
            return struct.pack("<HH", group, number) + vr + size + body
        return struct.pack("<HHI", group, number, len(body)) + body

    text = lambda s: s.encode()
    body = element(2, 0x10, b"UI", text("1.2.840.10008.1.2.1" if explicit else "1.2.840.10008.1.2"))
    body += element(0x18, 0x50, b"DS", text("4")) + element(0x20, 0x0E, b"UI", text(series)) + element(0x20, 0x13, b"IS", text(str(instance)))
    body += element(0x20, 0x32, b"DS", text(f"1\\2\\{z}")) + element(0x20, 0x37, b"DS", text("1\\0\\0\\0\\1\\0"))
    for number, value in ((0x10, pixels.shape[0]), (0x11, pixels.shape[1]), (0x100, 16), (0x103, 1)):
        body += element(0x28, number, b"US", struct.pack("<H", value))
    body += element(0x28, 0x30, b"DS", text("0.7\\0.5")) + element(0x28, 0x1052, b"DS", text("-10")) + element(0x28, 0x1053, b"DS", text("2"))
    return b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, b"OW", pixels.astype("<i2").tobytes())


def test_dicom_series(spark, tmp_path):
    (tmp_path / "c").mkdir()
    planes = {z: np.arange(6).reshape(2, 3) + 10 * k for k, z in enumerate((4.0, 0.0, 2.0))}
    for k, (z, p) in enumerate(planes.items()):
        (tmp_path / "c" / f"s{k}.dcm").write_bytes(dicom_slice(p, z, k, explicit=k != 1))
    (tmp_path / "c" / "odd.dcm").write_bytes(dicom_slice(planes[0.0], 9.0, 9, "9.9"))
    found = volumes.files(spark, str(tmp_path))
    got = {r["series"]: r for r in volumes.series(volumes.catalog(found)).collect()}
    r = got["1.2.3"]
    assert [s["position"] for s in r["slices"]] == [0.0, 2.0, 4.0] and r["spacing"] == 2.0 and r["even"]
    assert got["9.9"]["spacing"] == 4.0 and got["9.9"]["even"]
    scaled = {x["position"]: x["values"] for x in volumes.rescaled(found).where("series = '1.2.3'").collect()}
    assert scaled == {z: (p * 2.0 - 10).ravel().tolist() for z, p in planes.items()}


def test_landmarks(spark, tmp_path):
    points = spark.createDataFrame([("a", 1, 4.0, 5.0, 6.5), ("a", 0, 1.0, 2.0, 3.0), ("b", 0, -1.0, 0.0, 9.0)], "case string, idx int, x double, y double, z double")
    tables.write_landmarks(points, str(tmp_path / "m"))
    got = sorted((r["path"].split("case=")[1][0], r["idx"], r["x"], r["y"], r["z"]) for r in tables.read_landmarks(spark, str(tmp_path / "m")).collect())
    assert got == [("a", 0, 1.0, 2.0, 3.0), ("a", 1, 4.0, 5.0, 6.5), ("b", 0, -1.0, 0.0, 9.0)]


def test_saved_steps_tails_and_sidecars(spark, tmp_path):
    path = str(tmp_path / "step")
    assert tables.saved(spark, path) is None
    tables.save(spark.range(5), path)
    assert tables.saved(spark, path).count() == 5
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(9)], "n int, value string")
    assert [r["value"] for r in tables.tail(lines, "n", 3).collect()] == ["l6", "l7", "l8"]
    (tmp_path / "side.csv").write_text("\n".join("abcdef" for _ in range(9)))
    assert [r["line"] for r in tables.sidecar(spark, str(tmp_path / "side.csv"), 2, 3).collect()] == ["abc", "abc"]
    tables.write_report(spark.createDataFrame([("{}",)], "report string"), "report", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "{}"


LINES = [
    "Training : Loss (Net5(0.001000) : MAE(1.00) : 0.012225 Feature_L1(1.00) : 0.080258) GPU([0]) Memory GPU (19.55G (76.22 %)) | Memory (33.96G (27.60 %)):  16% 335/2130 [19:06<1:03:43,  2.13s/it]",
    "Caching Train: Memory (18.62G (15.10 %)) | Memory forecast (114.78G (93.34 %)) | CPU (23.60 %):   5%|5         | 3/60 [00:01<00:31,  1.81it/s]",
    "\x1b[32mMetric TRAIN : PRED:SEG:Dice: 0.9123 | PRED:SEG:HD95: 3.4210:  50%|#####     | 5/10 [00:04<00:04,  1.30it/s]\x1b[0m",
    "nothing here",
]


def test_live_lines(spark):
    more = ["x Training : Loss (A(0.1) : L1(1) : nan L2(2.0) : 1e-3 B(0.01) : L1(1) : 4 ) : 3% 1 / 30 [00:01<00:31, 2.0 it/s]", "Metric validation : A:B:Dice: 0.5:  10%|#| 1/10 [00:00<00:09,  1.0it/s]", "… Memory GPU (19.55G (76.22 %)) | Memory (33.96G (27.60 %)) …", "Loss (never closed", "", None, "a [b] 5% 1/x [1<2, 3it/s]", "Metric TRAIN : A:Dice: 0.5 | A:Dice: 0.75 | A:HD: -inf"]
    df = spark.createDataFrame(list(enumerate([*LINES, *more])), "n int, line string")
    a, b, c, d, *rest = logs.live(df, "line").orderBy("n").collect()
    assert (a["stage"], a["step"], a["total"], a["rate_unit"], a["memory_gpu_gb"], a["memory_gpu_percent"], a["memory_gb"], a["lr"]) == ("Training", 335, 2130, "s/it", 19.55, 76.22, 33.96, 0.001)
    assert (a["percent"], a["elapsed"], a["remaining"], a["rate"], a["memory_percent"], a["cpu_percent"]) == (16.0, "19:06", "1:03:43", 2.13, 27.6, None)
    assert a["metrics"] == {"Net5:MAE": 0.012225, "Net5:Feature_L1": 0.080258}
    assert (b["stage"], b["step"], b["percent"], b["memory_gb"], b["cpu_percent"], b["memory_gpu_gb"], b["metrics"]) == ("Caching Train", 3, 5.0, 18.62, 23.6, None, {})
    assert (c["stage"], c["label"], c["step"], c["metrics"]) == ("Evaluation", "Metric TRAIN", 5, {"PRED:SEG:Dice": 0.9123, "PRED:SEG:HD95": 3.421})
    assert d["step"] is None and d["metrics"] == {}
    e, f, g, h, i, j, k, m = rest
    assert (e["stage"], e["step"], e["total"], e["percent"], e["rate"], e["rate_unit"], e["lr"]) == ("Training", 1, 30, 3.0, 2.0, "it/s", 0.1)
    assert repr(e["metrics"]["A:L1"]) == "nan" and (e["metrics"]["A:L2"], e["metrics"]["B:L1"]) == (0.001, 4.0)
    assert (f["stage"], f["label"], f["metrics"], f["step"]) == ("Evaluation", "Metric VALIDATION", {"A:B:Dice": 0.5}, 1)
    assert (g["memory_gpu_gb"], g["memory_gpu_percent"], g["memory_gb"], g["memory_percent"]) == (19.55, 76.22, 33.96, 27.6)
    assert all(x["step"] is None and x["rate"] is None and x["metrics"] == {} for x in (h, i, j, k))
    assert m["metrics"] == {"A:Dice": 0.75, "A:HD": float("-inf")}


def test_live_lines_compute_each_part_once(spark):
    lines = spark.createDataFrame([(LINES[0],)], "line string")
    plan = logs.live(lines, "line").select("step", "metrics")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and len(plan) < 20_000


def test_balanced_parentheses(spark):
    texts = ["x Loss (a(b)c) d)", "Loss (", "Loss ()", "Loss (a(b)", "Loss ((((a)b)c)d)e", "no (a)", None, "Loss (" + "(a)" * 3000 + "é) b"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n").select(logs.balanced(F.col("t"), "Loss (")).collect()]
    assert got == ["a(b)c", None, "", None, "(((a)b)c)d", None, None, "(a)" * 3000 + "é"]
