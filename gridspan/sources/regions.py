"""Volumes written by regions: many tasks write slabs of one volume, and whole volumes appear or none.

A volume is never in one row. Each task writes its slabs' bytes as parts below a staging folder, under names of its own, and returns
a manifest row for each; the manifest is an ordinary Parquet table, so that Spark's own commit decides which try of a task counts. A volume
is complete when the manifest's slabs cover its planes, checked before anything is published. MetaImage parts are then strung
together, one task for each volume, as a stream; a Zarr store's parts are its chunks, where they belong at once. Publishing is a
rename through the Hadoop file system for each volume, in any store that Spark writes; ``publish`` may be called again after a loss and does the rest.

The staging folder and the root must be one folder that all executors share.
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.sources import headers
from gridspan.sources.ranges import opened

#: A slab: planes [z, z + n) of all channels of a volume, channels first, and what the volume is.
SLAB = ["case", "grp", "z", "shape", "dtype", "origin", "spacing", "direction", "values"]
MANIFEST = "case string, grp string, z int, planes int, shape array<int>, dtype string, origin array<double>, spacing array<double>, direction array<double>, part string"
#: Bytes that are copied at a time.
COPIED = 8 << 20


def _header(row: dict) -> headers.Header:
    return headers.Header("mha", tuple(row["shape"]), row["dtype"], tuple(row["origin"]), tuple(row["spacing"]), tuple(row["direction"]))


def _put(system: fs.FileSystem, path: str, body: bytes) -> None:
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(body)


def staging(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_staging/{name}"


def can_stream(kind: str, header: headers.Header) -> bool:
    """Whether volumes of this kind are written by slabs: MetaImage of one channel, or stores."""
    return kind == "zarr" or (kind == "mha" and header.shape[0] == 1 and not header.compressed)


def write_slabs(slabs: DataFrame, root: str, name: str, kind: str = "mha", chunk_planes: int = 16) -> DataFrame:
    """Parts of volumes from rows of SLAB columns; the manifest, which gains a row for each.

    ``name`` is the run's: the same name goes on where an earlier call ended. Slabs of a Zarr store begin at multiples of ``chunk_planes``.
    """
    place = staging(root, name)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(place)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(SLAB[:-1])}
                shape, dtype = row["shape"], np.dtype(row["dtype"])
                flat = batch.column(len(SLAB) - 1)[i].values.to_numpy(zero_copy_only=False)
                slab = flat.reshape(shape[0], -1, *shape[2:]).astype(dtype.newbyteorder("<"))
                n = slab.shape[1]
                if kind == "zarr":
                    if row["z"] % chunk_planes:
                        raise ValueError(f"a slab at plane {row['z']} cuts a chunk of {chunk_planes} planes")
                    part = f"{folder}/stores/{row['case']}/{row['grp']}.zarr"
                    for c in range(shape[0]):
                        for z in range(0, n, chunk_planes):
                            body = np.zeros((1, chunk_planes, *shape[2:]), slab.dtype)
                            body[0, : min(chunk_planes, n - z)] = slab[c, z : z + chunk_planes]
                            _put(system, f"{part}/0/c/{c}/{(row['z'] + z) // chunk_planes}{'/0' * (len(shape) - 2)}", gzip.compress(body.tobytes(), 1))
                else:
                    if shape[0] != 1:
                        raise ValueError("channels of a MetaImage lie side by side: its slabs are written with kind zarr")
                    # A name of its own for each try of a task.
                    part = f"{folder}/parts/{row['case']}/{row['grp']}/{row['z']:08d}-{uuid.uuid4().hex}"
                    _put(system, part, slab.tobytes())
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in SLAB[:-1]} | {"planes": n, "part": part}], schema=_MANIFEST)

    chosen = slabs.select("case", "grp", F.col("z").cast("int").alias("z"), F.col("shape").cast("array<int>").alias("shape"), "dtype", *[F.col(c).cast("array<double>").alias(c) for c in SLAB[5:]])
    chosen.mapInArrow(put, MANIFEST).write.mode("append").parquet(f"{place}/manifest")
    return manifest(slabs.sparkSession, root, name)


_MANIFEST = pa.schema([("case", pa.string()), ("grp", pa.string()), ("z", pa.int32()), ("planes", pa.int32()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("origin", pa.list_(pa.float64())), ("spacing", pa.list_(pa.float64())), ("direction", pa.list_(pa.float64())), ("part", pa.string())])


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The run's finished slabs; empty before the first."""
    path = f"{staging(root, name)}/manifest"
    system, at = _hadoop(spark, path)
    return spark.read.schema(MANIFEST).parquet(path) if system.exists(at(path)) else spark.createDataFrame([], MANIFEST)


def coverage(table: DataFrame) -> DataFrame:
    """case, grp, depth, covered, overlapping: how many planes the manifest's slabs cover; a slab that was written again counts once."""
    one = table.groupBy("case", "grp", "z").agg(F.max("planes").alias("planes"), F.first(F.get("shape", F.lit(1))).alias("depth"))
    return one.groupBy("case", "grp").agg(F.max("depth").alias("depth"), F.sum("planes").alias("covered"), F.max(F.col("z") + F.col("planes")).alias("end"), F.count_distinct("z").alias("slabs")).withColumn("complete", (F.col("covered") == F.col("depth")) & (F.col("end") == F.col("depth")))


def pending(work: DataFrame, table: DataFrame) -> DataFrame:
    """The slabs (case, grp, z) that are still to do: those without a row in the manifest."""
    return work.join(table.select("case", "grp", "z").distinct(), ["case", "grp", "z"], "left_anti")


def sweep(work: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str, name: str, kind: str = "mha", chunk_planes: int = 16) -> list[str]:
    """Compute and write the slabs of ``work`` that an earlier, broken run of this name didn't finish, then publish. ``compute`` takes pending rows to SLAB columns."""
    spark = work.sparkSession
    write_slabs(compute(pending(work, manifest(spark, root, name))), root, name, kind, chunk_planes)
    return publish(spark, root, name, kind, chunk_planes)


def publish(spark: SparkSession, root: str, name: str, kind: str = "mha", chunk_planes: int = 16) -> list[str]:
    """Move the run's volumes to root/case/grp.ending, and give their paths. A volume with planes missing or twice is an error, and none appears.

    What is there already is replaced. After a loss the call may be repeated: volumes that were moved are passed over.
    """
    table, place = manifest(spark, root, name), staging(root, name)
    broken = coverage(table).where(~F.col("complete")).select("case", "grp", "depth", "covered").limit(5).collect()
    if broken:
        raise ValueError(f"planes are missing or overlap, as in {[tuple(r) for r in broken]}")

    def string(parts: pa.Table) -> pa.Table:
        """One volume's parts in order, as a stream."""
        system, folder = opened(place)
        rows = sorted(parts.to_pylist(), key=lambda r: (r["z"], r["part"]))
        rows = list({r["z"]: r for r in rows}.values())
        row = rows[0]
        if kind == "zarr":
            final = row["part"]
            for inner, body in zarr_metadata(row, chunk_planes).items():
                _put(system, f"{final}/{inner}", json.dumps(body).encode())
        else:
            final = f"{folder}/whole/{row['case']}/{row['grp']}.mha"
            system.create_dir(final.rpartition("/")[0], recursive=True)
            head = headers.meta_bytes(np.zeros((1,) * len(row["shape"]), np.dtype(row["dtype"])), _header(row))
            sizes = " ".join(map(str, reversed(row["shape"][1:])))
            lines = [f"DimSize = {sizes}".encode() if x.startswith(b"DimSize") else x for x in head.split(b"ElementDataFile")[0].split(b"\n")]
            with system.open_output_stream(f"{final}.tmp") as out:
                out.write(b"\n".join(lines) + b"ElementDataFile = LOCAL\n")
                for r in rows:
                    with system.open_input_stream(r["part"]) as part:
                        while body := part.read(COPIED):
                            out.write(body)
            system.move(f"{final}.tmp", final)
        return pa.table({"case": [row["case"]], "grp": [row["grp"]], "final": [final]})

    whole = f"{place}/whole-table"
    system, at = _hadoop(spark, whole)
    if not system.exists(at(f"{whole}/_SUCCESS")):
        table.groupBy("case", "grp").applyInArrow(string, "case string, grp string, final string").write.mode("overwrite").parquet(whole)
    ending, out = ("zarr" if kind == "zarr" else "mha"), []
    # One rename a volume: names only reach the driver, one partition at a time.
    for r in spark.read.parquet(whole).toLocalIterator():
        target = f"{root.rstrip('/')}/{r['case']}/{r['grp']}.{ending}"
        if system.exists(at(r["final"])):
            system.mkdirs(at(target).getParent())
            system.delete(at(target), True)
            if not system.rename(at(r["final"]), at(target)):
                raise OSError(f"{target} can't be moved to its place")
        out.append(target)
    system.delete(at(place), True)
    return out


def zarr_metadata(row: dict, chunk_planes: int) -> dict[str, dict]:
    """The two metadata files of a store of one level."""
    names = ["c", "z", "y", "x"][: 1] + ["z", "y", "x"][-(len(row["shape"]) - 1) :]
    kinds = {np.dtype(v): k for k, v in headers.ZARR_TYPES.items()}
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}]
    array = {"zarr_format": 3, "node_type": "array", "shape": row["shape"], "data_type": kinds[np.dtype(row["dtype"])], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, chunk_planes, *row["shape"][2:]]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "dimension_names": names}
    steps = [{"type": "scale", "scale": [1.0, *reversed(row["spacing"])]}, {"type": "translation", "translation": [0.0, *reversed(row["origin"])]}]
    scales = [{"axes": [{"name": n} for n in names], "datasets": [{"path": "0", "coordinateTransformations": steps}]}]
    return {"zarr.json": {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": scales}}}, "0/zarr.json": array}


def slabs_of(tiles: DataFrame, keys: list[str], column: str, tiling, planes: int) -> DataFrame:
    """Slabs (keys, z, values) of tiled volumes: one shuffle, to tiles of whole planes."""
    from gridspan.operators.tiles import Tiling, retile

    out = Tiling(tiling.shape, (planes, *tiling.shape[1:]))
    return retile(tiles, keys, [column], tiling, out).select(*keys, (F.col("tile") * planes).alias("z"), F.col(column).alias("values"))


def part_bytes(shape: list[int], dtype: str, planes: int) -> int:
    return planes * math.prod(shape[2:]) * np.dtype(dtype).itemsize * shape[0]
