"""Ranged reads and writes by regions: bytes are counted, lost and repeated work leaves whole files or none."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import tiles
from gridspan.sources import headers, ranges, regions, volumes

HEAD = headers.Header("mha", (1, 6, 5, 4), "<i2", (1.0, 2.0, 3.0), (1.0, 1.0, 2.0), tuple(np.eye(3).ravel()))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("volumes")
    rng = np.random.default_rng(0)
    for case in ("a", "b"):
        (root / case).mkdir()
        x = rng.integers(-100, 100, (1, 6, 5, 4)).astype("<i2")
        (root / case / "CT.mha").write_bytes(headers.meta_bytes(x, HEAD))
        two = rng.normal(size=(3, 6, 5, 4))
        (root / case / "FIELD.mha").write_bytes(headers.meta_bytes(two.astype("<f4"), headers.Header("mha", two.shape, "<f4", HEAD.origin, HEAD.spacing, HEAD.direction)))
        np.save(root / case / "NPY.npy", two)
    plain = bytearray(352)
    plain[:4] = (348).to_bytes(4, "little")
    plain[40:56] = np.array([3, 4, 5, 6, 1, 1, 1, 1], "<i2").tobytes()
    plain[70:72] = (4).to_bytes(2, "little")
    plain[76:108] = np.ones(8, "<f4").tobytes()
    plain[108:112] = np.array([352], "<f4").tobytes()
    (root / "a" / "N.nii.gz").write_bytes(gzip.compress(bytes(plain) + np.arange(120, dtype="<i2").tobytes()))
    for name, packed, big in (("RAW", False, ">"), ("PACKED", True, "<")):
        head = f"NRRD0004\n# made here\ntype: short\ndimension: 4\nspace: right-anterior-superior\nsizes: 2 4 5 6\nspace directions: none (0.5,0,0) (0,1,0) (0,0,2)\nspace origin: (1,2,3)\nendian: {'big' if big == '>' else 'little'}\nencoding: {'gzip' if packed else 'raw'}\nscanner:=x\n\n"
        body = rng.integers(-9, 9, (6, 5, 4, 2)).astype(f"{big}i2").tobytes()
        (root / "b" / f"{name}.nrrd").write_bytes(head.encode() + (gzip.compress(body) if packed else body))
    (root / "b" / "BESIDE.nhdr").write_text("NRRD0004\ntype: short\nsizes: 2 2\nencoding: raw\ndata file: x.raw\n\n")
    (root / "a" / "notes.txt").write_text("nothing")
    (root / "a" / "broken.mha").write_text("ObjectType = Image\nDimSize = x\nElementDataFile = LOCAL\n")
    return str(root)


def rows(df):
    return sorted((r["case"], r["grp"], r["c"], r["z"], tuple(r["values"])) for r in df.collect())


def test_equals_whole_reads(spark, root):
    found = volumes.files(spark, root).where(~F.col("path").endswith("broken.mha"))
    want = rows(volumes.planes(found))
    assert rows(ranges.planes(spark, root)) == want
    # Tasks of a plane or two, and files in shares.
    assert rows(ranges.planes(spark, root, task_bytes=100)) == want
    assert rows(ranges.planes(spark, root, z=(2, 4), channels=[0])) == rows(volumes.planes(found, 2, 4, [0]))
    cut = [(a, b, c, z, v[4:12]) for a, b, c, z, v in want]
    assert rows(ranges.planes(spark, root, rows=(1, 3))) == cut
    heads = {(r["case"], r["grp"]): r for r in ranges.heads(spark, root).collect()}
    own = {(r["case"], r["grp"]): r for r in volumes.catalog(found).collect()}
    assert heads.keys() == own.keys()
    assert all(heads[k][c] == own[k][c] for k in heads for c in ("shape", "dtype", "origin", "spacing", "direction", "format", "length"))


def test_nrrd_headers(spark, root):
    heads = {r["grp"]: r for r in ranges.heads(spark, root).where("case = 'b'").collect()}
    assert "BESIDE" not in heads
    for name, dtype, packed in (("RAW", ">i2", False), ("PACKED", "<i2", True)):
        h = heads[name]
        assert (h["shape"], h["dtype"], h["compressed"], h["interleaved"], h["origin"], h["spacing"]) == ([2, 6, 5, 4], dtype, packed, True, [-1.0, -2.0, 3.0], [0.5, 1.0, 2.0])
        assert h["direction"] == [-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0] and h["attributes"] == {"scanner": "x"}


def test_filters_reach_the_reader(spark, root):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = ranges.planes(spark, root).where("case = 'a' and grp in ('CT', 'N') and z > 1 and z <= 3")
        assert rows(df) == [r for r in rows(ranges.planes(spark, root)) if r[0] == "a" and r[1] in ("CT", "N") and 1 < r[3] <= 3]
        assert rows(ranges.planes(spark, root).where("c = 2 and z = 5")) == [r for r in rows(ranges.planes(spark, root)) if r[2] == 2 and r[3] == 5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file: its header and one plane are read, and a few bytes more."""
    head = headers.Header("mha", (1, 9000, 512, 512), "<i2", (0.0,) * 3, (1.0,) * 3, tuple(np.eye(3).ravel()))
    small = headers.meta_bytes(np.zeros((1, 1, 1, 1), "<i2"), head).replace(b"DimSize = 1 1 1", b"DimSize = 512 512 9000")[:-2]
    (tmp_path / "big").mkdir()
    path = tmp_path / "big" / "CT.mha"
    with open(path, "wb") as f:
        f.write(small)
        f.seek(len(small) + 8888 * 512 * 512 * 2)
        f.write(np.full(512 * 512, 7, "<i2").tobytes())
        f.truncate(len(small) + 9000 * 512 * 512 * 2)
    assert os.path.getsize(path) > 2**32
    assert ranges.heads(spark, str(tmp_path)).first()["shape"] == [1, 9000, 512, 512]
    got = ranges.planes(spark, str(tmp_path), z=(8888, 8890)).orderBy("z").collect()
    assert [set(r["values"]) for r in got] == [{7.0}, {0.0}] and sum(r["bytes_read"] for r in got) == 2 * 512 * 512 * 2
    one = ranges.planes(spark, str(tmp_path), z=(8888, 8889), rows=(10, 12)).first()
    assert one["bytes_read"] == 2 * 512 * 2 and one["values"] == [7.0] * 1024


def slabs(spark, depth=10, step=3, kind="<f4"):
    work = spark.createDataFrame([(c, "OUT", z) for c in ("p", "q") for z in range(0, depth, step)], "case string, grp string, z int")
    geometry = {"shape": [1, depth, 4, 5], "origin": [1.0, 2.0, 3.0], "spacing": [0.5, 1.0, 2.0], "direction": [float(x) for x in np.eye(3).ravel()]}

    def compute(rows):
        n = F.least(F.lit(step), F.lit(depth) - F.col("z"))
        values = F.transform(F.sequence(F.lit(0), n * 20 - 1), lambda i: (F.col("z") * 20 + i).cast("double"))
        return rows.select("case", "grp", "z", *[F.array(*map(F.lit, v)).alias(k) for k, v in geometry.items()], F.lit(kind).alias("dtype"), values.alias("values"))

    return work, compute


def test_many_tasks_write_one_volume(spark, tmp_path):
    root = str(tmp_path / "out")
    work, compute = slabs(spark)
    paths = regions.sweep(work.repartition(5), compute, root, "run")
    assert sorted(p.rpartition("/out/")[2] for p in paths) == ["p/OUT.mha", "q/OUT.mha"]
    read = volumes.read(volumes.files(spark, root)).collect()
    assert len(read) == 2 and all(r["values"] == [float(i) for i in range(200)] and r["shape"] == [1, 10, 4, 5] and r["spacing"] == [0.5, 1.0, 2.0] and r["origin"] == [1.0, 2.0, 3.0] for r in read)
    assert not os.path.exists(f"{root}/_staging/run")


def test_missing_and_repeated_slabs(spark, tmp_path):
    root = str(tmp_path / "out")
    work, compute = slabs(spark)
    regions.write_slabs(compute(work.where("z < 6")), root, "run")
    with pytest.raises(ValueError, match="missing"):
        regions.publish(spark, root, "run")
    assert not any(f.endswith(".mha") for _, _, names in os.walk(root) for f in names)

    # What is done already is not computed again; a slab written twice counts once.
    seen = []

    def counted(rows):
        seen.extend(sorted(r["z"] for r in rows.collect()))
        return compute(rows)

    regions.write_slabs(compute(work.where("z = 3")), root, "run")
    regions.sweep(work, counted, root, "run")
    assert seen == [6, 6, 9, 9]
    assert all(r["values"] == [float(i) for i in range(200)] for r in volumes.read(volumes.files(spark, root)).collect())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    work, compute = slabs(spark)
    broken = compute(work).withColumn("values", F.when((F.col("z") == 9) & (F.col("case") == "q"), F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("values")))
    with pytest.raises(Exception, match="lost"):
        regions.write_slabs(broken.repartition(4), root, "run")
    assert regions.manifest(spark, root, "run").count() == 0
    assert len(regions.sweep(work, compute, root, "run")) == 2


def test_publishing_goes_on_after_a_loss(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    work, compute = slabs(spark)
    regions.write_slabs(compute(work), root, "run")
    hadoop = regions._hadoop

    class Dying:
        def __init__(self, system):
            self.system, self.left = system, 1

        def rename(self, a, b):
            if not self.left:
                raise OSError("the driver dies")
            self.left -= 1
            return self.system.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.system, name)

    def dying(s, p):
        system, at = hadoop(s, p)
        return Dying(system), at

    monkeypatch.setattr(regions, "_hadoop", dying)
    with pytest.raises(OSError, match="dies"):
        regions.publish(spark, root, "run")
    monkeypatch.undo()
    assert len(regions.publish(spark, root, "run")) == 2
    assert volumes.read(volumes.files(spark, root)).count() == 2


def test_stores_by_chunks_and_from_tiles(spark, tmp_path):
    root = str(tmp_path / "out")
    work, compute = slabs(spark, depth=10, step=4, kind="<i2")
    with pytest.raises(Exception, match="cuts a chunk"):
        regions.write_slabs(compute(work), root, "bad", "zarr", 3)
    regions.sweep(work, compute, root, "run", "zarr", 2)
    chunks = volumes.zarr(spark, root).where("case = 'p'").orderBy(F.get("chunk", F.lit(1))).collect()
    assert [r["chunk"] for r in chunks] == [[0, k, 0, 0] for k in range(5)] and sum((r["values"] for r in chunks), []) == [float(i) for i in range(200)]
    tiling = tiles.Tiling((10, 4, 5), (3, 2, 4))
    cut = tiles.cut_rows(spark.createDataFrame([("t", [float(i) for i in range(200)])], "case string, v array<double>"), ["case"], ["v"], tiling)
    rows = regions.slabs_of(cut, ["case"], "v", tiling, 4).withColumns({"grp": F.lit("T"), "shape": F.array(*map(F.lit, (1, 10, 4, 5))), "dtype": F.lit("<f8"), **{c: F.array(*map(F.lit, getattr(HEAD, c))) for c in ("origin", "spacing", "direction")}})
    regions.write_slabs(rows, root, "tiles")
    regions.publish(spark, root, "tiles")
    assert volumes.read(volumes.files(spark, f"{root}/t")).first()["values"] == [float(i) for i in range(200)]
