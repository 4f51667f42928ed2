"""Volume files as rows: header probes, region reads, and a writer that publishes whole files or none.

Files come from Spark's own ``binaryFile`` reader, so any store that Spark reads will do, and are named
``root/case/group.ending``. A probe sends a file's first bytes to Python and no more; a region read of an
uncompressed file sends the bytes of its planes (``ranges`` seeks instead). Formats: MetaImage, NIfTI-1, NRRD, NumPy arrays, uncompressed
DICOM slices, and OME-Zarr 0.5 stores (Zarr 3) with plain or gzip chunks. The metadata of older stores lies in hidden
files, which Spark's readers pass over. Files of other kinds are left out of catalogues.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gridspan.sources import headers

#: First bytes of a file that hold its header.
PROBE = 1 << 16
HEADER = "format string, shape array<int>, dtype string, origin array<double>, spacing array<double>, direction array<double>, offset long, compressed boolean, interleaved boolean, attributes map<string,string>"
_HEADER = pa.struct([("format", pa.string()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("origin", pa.list_(pa.float64())), ("spacing", pa.list_(pa.float64())), ("direction", pa.list_(pa.float64())), ("offset", pa.int64()), ("compressed", pa.bool_()), ("interleaved", pa.bool_()), ("attributes", pa.map_(pa.string(), pa.string()))])


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, case, grp, modified, length, content of every file below a root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -2).alias("case"), F.regexp_replace(F.element_at(parts, -1), r"\.(nii\.gz|[^.]*)$", "").alias("grp"), F.col("modificationTime").alias("modified"), "length", "content")


def _as_row(h: headers.Header | None) -> dict | None:
    return None if h is None else asdict(h) | {"shape": list(h.shape), "attributes": list(h.attributes.items())}


def _header_ddl() -> str:
    return f"struct<{','.join(f.strip().replace(' ', ':', 1) for f in HEADER.split(', '))}>"


def probe(path: Column | str, data: Column) -> Column:
    """The header of a file from its first bytes; null for no volume or a broken header."""

    @F.arrow_udf(_header_ddl())
    def read_headers(paths: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for name, part in zip(paths.to_pylist(), parts.to_pylist(), strict=True):
            try:
                out.append(_as_row(headers.header_of(name, part)))
            except (ValueError, KeyError, TypeError, IndexError, zlib.error, headers.struct.error):
                out.append(None)
        return pa.array(out, _HEADER)

    return read_headers(path, data)


def catalog(found: DataFrame) -> DataFrame:
    """path, case, grp, modified and the header's fields, is_label (unsigned bytes): one row a volume, in no order."""
    probed = found.select("path", "case", "grp", "modified", "length", probe("path", F.substring("content", 1, PROBE)).alias("h"))
    return probed.where(F.col("h").isNotNull()).select("path", "case", "grp", "modified", "length", "h.*", F.col("h.dtype").endswith("u1").alias("is_label"))


def unreadable(found: DataFrame) -> DataFrame:
    """path of the files that are no volumes, or whose headers do not read."""
    return found.select("path", probe("path", F.substring("content", 1, PROBE)).alias("h")).where(F.col("h").isNull()).select("path")


def case_names(table: DataFrame, group: str) -> DataFrame:
    """Distinct cases, sorted, that hold a group; the group may have * for any part of a name."""
    pattern = "^" + ".*".join(map(lambda p: r"\Q" + p + r"\E", group.split("*"))) + "$"
    return table.where(F.col("grp").rlike(pattern)).select("case").distinct().orderBy("case")


def groups(table: DataFrame) -> DataFrame:
    return table.select("grp").distinct()


def size(table: DataFrame) -> DataFrame:
    """grp, cases: how many cases hold each group."""
    return table.groupBy("grp").agg(F.count_distinct("case").alias("cases"))


def numbers(dtype: Column, data: Column) -> Column:
    """Raw bytes of a type as an array of doubles."""

    @F.arrow_udf("array<double>")
    def decode(kinds: pa.Array, raw: pa.Array) -> pa.Array:
        return pa.array([None if r is None else np.frombuffer(r, np.dtype(k)).astype(float) for k, r in zip(kinds.to_pylist(), raw.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return decode(dtype, data)


def item_bytes(dtype: Column) -> Column:
    return F.regexp_extract(dtype, r"([0-9]+)$", 1).cast("int")


def planes(found: DataFrame, start: int = 0, stop: int | None = None, channels: list[int] | None = None) -> DataFrame:
    """path, case, grp, c, z, values: planes [start, stop) along the slowest axis, each an array of its voxels.

    Of uncompressed files only the planes' bytes leave the reader's row. Compressed ones, and those whose channels lie side by
    side, are unpacked whole, one file at a time.
    """
    probed = found.withColumn("h", probe("path", F.substring("content", 1, PROBE))).where(F.col("h").isNotNull())
    shape = F.col("h.shape")
    deep = F.size(shape) > 3
    depth, rest = F.when(deep, F.get(shape, F.lit(1))).otherwise(1), F.aggregate(F.slice(shape, F.when(deep, 3).otherwise(2), F.size(shape)), F.lit(1).cast("long"), lambda n, e: n * e)
    wanted = F.array(*map(F.lit, channels)) if channels is not None else F.sequence(F.lit(0), F.get(shape, F.lit(0)) - 1)
    last = F.least(depth, F.lit(stop)) if stop is not None else depth
    plain = probed.where(~F.col("h.compressed") & ~F.col("h.interleaved") & ~(F.col("h.format") == "nii.gz"))
    width = rest * item_bytes(F.col("h.dtype"))
    one = lambda c, z: F.struct(c.alias("c"), z.alias("z"), F.substring("content", (F.col("h.offset") + (c * depth + z) * width + 1).cast("int"), width.cast("int")).alias("raw"))
    cuts = F.when(last > start, F.flatten(F.transform(wanted, lambda c: F.transform(F.sequence(F.lit(start), last - 1), lambda z: one(c, z)))))
    raw = plain.select("path", "case", "grp", F.col("h.dtype").alias("dtype"), F.inline(cuts))
    ready = raw.select("path", "case", "grp", "c", "z", numbers(F.col("dtype"), F.col("raw")).alias("values"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, case, grp, data = (batch.column(k)[i].as_py() for k in range(4))
                volume = headers.pixels(headers.header_of(path, data), data)
                volume = volume if volume.ndim > 3 else volume[:, None]
                chosen = range(volume.shape[0]) if channels is None else channels
                cut = [(c, z) for c in chosen for z in range(start, volume.shape[1] if stop is None else min(stop, volume.shape[1]))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cut)), pa.array([case] * len(cut)), pa.array([grp] * len(cut)), pa.array([c for c, _ in cut], pa.int32()), pa.array([z for _, z in cut], pa.int32()), pa.array([volume[c, z].ravel().astype(float) for c, z in cut], pa.list_(pa.float64()))], names=["path", "case", "grp", "c", "z", "values"])

    whole = probed.where(F.col("h.compressed") | F.col("h.interleaved") | (F.col("h.format") == "nii.gz")).select("path", "case", "grp", "content")
    return ready.unionByName(whole.mapInArrow(unpack, "path string, case string, grp string, c int, z int, values array<double>"))


def read(found: DataFrame) -> DataFrame:
    """case, grp, the header's fields and values, the whole volume as one array, channels first."""
    own = planes(found)
    whole = own.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "z", "values"))), lambda p: p["values"])).alias("values"))
    return catalog(found).join(whole, "path")


def region(found: DataFrame, start: tuple[int, ...], stop: tuple[int, ...]) -> DataFrame:
    """case, grp, c, values, origin, spacing, direction of the region [start, stop) of each volume, in array order; the origin is the region's."""
    rows, columns = (start[-2], stop[-2]), (start[-1], stop[-1])
    first, last = (start[0], stop[0]) if len(start) > 2 else (0, 1)
    known = catalog(found).select("path", "shape", "origin", "spacing", "direction")
    cut = planes(found, first, last).join(known, "path")
    width = F.element_at("shape", -1)
    part = F.flatten(F.transform(F.sequence(F.lit(rows[0]), F.lit(rows[1] - 1)), lambda y: F.slice("values", y * width + columns[0] + 1, F.lit(columns[1] - columns[0]))))
    n = F.size("origin")
    step = F.zip_with(F.array(*[F.lit(float(a)) for a in reversed(start)]), F.col("spacing"), lambda a, s: a * s)
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("origin", i) + F.aggregate(F.zip_with(F.slice("direction", i * n + 1, n), step, lambda d, s: d * s), F.lit(0.0), lambda a, v: a + v))
    one = cut.select("path", "case", "grp", "c", "z", part.alias("values"), moved.alias("origin"), "spacing", "direction")
    return one.groupBy("path", "case", "grp", "c").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "values"))), lambda p: p["values"])).alias("values"), F.first("origin").alias("origin"), F.first("spacing").alias("spacing"), F.first("direction").alias("direction")).drop("path")


def statistics(found: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """case, grp, min, max, mean, std (sample, 0 for one voxel) by planes: no task holds a volume of an uncompressed file."""
    v = F.explode("values").alias("v")
    voxels = planes(found, channels=channels).select("case", "grp", v)
    return voxels.groupBy("case", "grp").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))


def series(table: DataFrame) -> DataFrame:
    """series, slices (struct of position, instance, path in order), spacing and even: DICOM slices as volumes.

    Slices go by their place along the normal, then by instance. Gaps are even when they agree within 0.01 or a hundredth; one
    slice takes its own thickness.
    """
    one = table.where("format = 'dcm'").select(F.col("attributes")["series"].alias("series"), F.struct(F.col("attributes")["position"].cast("double").alias("position"), F.col("attributes")["instance"].cast("int").alias("instance"), "path").alias("slice"), F.element_at("spacing", -1).alias("thick"))
    own = one.groupBy("series").agg(F.array_sort(F.collect_list("slice")).alias("slices"), F.first("thick").alias("thick"))
    gaps = F.zip_with(F.slice("slices", F.lit(2), F.size("slices")), F.slice("slices", F.lit(1), F.greatest(F.size("slices") - 1, F.lit(0))), lambda b, a: b["position"] - a["position"])
    own = own.withColumn("gaps", gaps)
    mean = F.aggregate("gaps", F.lit(0.0), lambda s, g: s + g) / F.size("gaps")
    spaced = own.withColumn("spacing", F.when(F.size("gaps") > 0, mean).otherwise(F.col("thick")))
    even = F.forall("gaps", lambda g: F.abs(g - F.col("spacing")) <= F.greatest(F.lit(0.01), F.abs(F.col("spacing")) * 0.01))
    return spaced.select("series", "slices", "spacing", even.alias("even"))


def rescaled(found: DataFrame) -> DataFrame:
    """path, series, position, values of each DICOM slice, by its slope and intercept."""
    table = catalog(found).where("format = 'dcm'").select("path", "attributes")
    cut = planes(found).select("path", "values").join(table, "path")
    a = F.col("attributes")
    return cut.select("path", a["series"].alias("series"), a["position"].cast("double").alias("position"), F.transform("values", lambda v: v * a["slope"].cast("double") + a["intercept"].cast("double")).alias("values"))


# Zarr stores: directories of chunk files.


def zarr(spark: SparkSession, root: str, level: int = 0) -> DataFrame:
    """case, grp, chunk (its place along each axis), header fields and values: a row for each stored chunk of a level, edge chunks whole as stored.

    Stores lie at root/case/group.zarr. Chunks that are not stored have no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_extract_all("path", F.lit(r"([^/]+)/([^/]+)\.zarr/(.*)$"), F.lit(0))
    named = found.where(F.size(path) > 0).select(F.regexp_extract("path", r"([^/]+)/[^/]+\.zarr/", 1).alias("case"), F.regexp_extract("path", r"/([^/]+)\.zarr/", 1).alias("grp"), F.regexp_extract("path", r"\.zarr/(.*)$", 1).alias("inner"), "content")
    text = lambda name: F.max(F.when(F.col("inner") == name, F.col("content").cast("string")))
    small = named.where(F.col("inner").isin("zarr.json", f"{level}/zarr.json"))
    meta = small.groupBy("case", "grp").agg(text(f"{level}/zarr.json").alias("meta"), text("zarr.json").alias("attrs")).where("meta is not null")
    chunk = named.where(F.col("inner").rlike(rf"^{level}/c(/[0-9]+)+$")).select("case", "grp", F.transform(F.split(F.regexp_replace("inner", rf"^{level}/c/", ""), "/"), lambda c: c.try_cast("int")).alias("chunk"), "content")

    @F.arrow_udf("array<double>")
    def decode(metas: pa.Array, raw: pa.Array) -> pa.Array:
        out = []
        for m, r in zip(metas.to_pylist(), raw.to_pylist(), strict=True):
            info = json.loads(m)
            packed = [c["name"] for c in info["codecs"] if c["name"] != "bytes"]
            if packed not in ([], ["gzip"]):
                raise ValueError(f"chunks packed by {packed} are not read")
            out.append(np.frombuffer(gzip.decompress(r) if packed else r, np.dtype(headers.ZARR_TYPES[info["data_type"]])).astype(float))
        return pa.array(out, pa.list_(pa.float64()))

    @F.arrow_udf(_header_ddl())
    def heads(metas: pa.Array, attrs: pa.Array) -> pa.Array:
        return pa.array([_as_row(headers.zarr_header(json.loads(m), json.loads(a or "{}").get("attributes", {}), level)) for m, a in zip(metas.to_pylist(), attrs.to_pylist(), strict=True)], _HEADER)

    return chunk.join(meta.withColumn("h", heads("meta", "attrs")), ["case", "grp"]).select("case", "grp", "chunk", "h.*", decode("meta", "content").alias("values"))


def chunk_filter(chunks: DataFrame, start: tuple[int, ...], stop: tuple[int, ...], size_of: tuple[int, ...]) -> DataFrame:
    """Only the chunks that a region of the stored axes touches."""
    keep = F.lit(True)
    for k, (a, b, n) in enumerate(zip(start, stop, size_of, strict=True)):
        keep = keep & (F.get("chunk", F.lit(k)) >= a // n) & (F.get("chunk", F.lit(k)) <= (b - 1) // n)
    return chunks.where(keep)


class VolumeSink(DataSource):
    """``format("gridspan_volume")``: rows case, grp, shape, dtype, origin, spacing, direction, values to root/case/grp.mha or .npy, or a .zarr store.

    Tasks write below a staging folder of the root, which all executors must share; a commit moves files to their places one
    by one, an abort removes them. A file that is written again replaces the one before.
    """

    @classmethod
    def name(cls) -> str:
        return "gridspan_volume"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VolumeWriter(self.options)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class VolumeWriter(DataSourceWriter):
    def __init__(self, options):
        self.root, self.kind = options["path"], options.get("kind", "mha")
        if self.kind not in ("mha", "npy", "zarr"):
            raise ValueError(f"volumes are not written as {self.kind!r}")
        self.staging = os.path.join(self.root, f"_staging-{uuid.uuid4().hex}")

    def write(self, rows) -> WriterCommitMessage:
        names = []
        for r in rows:
            volume = np.array(r["values"], float).astype(np.dtype(r["dtype"])).reshape(r["shape"])
            name = os.path.join(r["case"], f"{r['grp']}.{self.kind}")
            # Tasks that are tried again write beside each other: a name of its own for each try.
            own = os.path.join(self.staging, uuid.uuid4().hex, name)
            os.makedirs(os.path.dirname(own), exist_ok=True)
            header = headers.Header("mha", tuple(r["shape"]), r["dtype"], tuple(r["origin"]), tuple(r["spacing"]), tuple(r["direction"]))
            if self.kind == "zarr":
                _write_zarr(own, volume, header)
            else:
                with open(own, "wb") as f:
                    if self.kind == "npy":
                        np.save(f, volume)
                    else:
                        f.write(headers.meta_bytes(volume, header))
            names.append((own, name))
        return Written(names)

    def commit(self, messages) -> None:
        for own, name in (pair for m in messages if m for pair in m.names):
            place = os.path.join(self.root, name)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            if os.path.isdir(place):
                shutil.rmtree(place)
            os.replace(own, place)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _write_zarr(path: str, volume: np.ndarray, header: headers.Header, planes_per_chunk: int = 16) -> None:
    """A store of one level, chunks of whole planes, gzip."""
    names = ["c", "z", "y", "x"] if volume.ndim == 4 else ["c", "y", "x"]
    chunks = [1, min(planes_per_chunk, volume.shape[1]), *volume.shape[2:]]
    os.makedirs(os.path.join(path, "0"))
    kinds = {np.dtype(v): k for k, v in headers.ZARR_TYPES.items()}
    little = volume.astype(volume.dtype.newbyteorder("<"))
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}]
    array = {"zarr_format": 3, "node_type": "array", "shape": list(volume.shape), "data_type": kinds[little.dtype], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "dimension_names": names}
    steps = [{"type": "scale", "scale": [1.0, *reversed(header.spacing)]}, {"type": "translation", "translation": [0.0, *reversed(header.origin)]}]
    scales = [{"axes": [{"name": n} for n in names], "datasets": [{"path": "0", "coordinateTransformations": steps}]}]
    group = {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": scales}}}
    for name, body in (("zarr.json", group), ("0/zarr.json", array)):
        with open(os.path.join(path, name), "w") as f:
            json.dump(body, f)
    counts = [-(-n // c) for n, c in zip(volume.shape, chunks, strict=True)]
    for at in np.ndindex(*counts):
        part = little[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunks, strict=True))]
        whole = np.zeros(chunks, little.dtype)
        whole[tuple(slice(0, n) for n in part.shape)] = part
        place = os.path.join(path, "0", "c", *map(str, at))
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(place, "wb") as f:
            f.write(gzip.compress(whole.tobytes(), 1))


def write(volumes: DataFrame, root: str, kind: str = "mha") -> None:
    """``volumes`` as files below a root that all executors share; whole files appear, or none."""
    volumes.sparkSession.dataSource.register(VolumeSink)
    chosen = volumes.select("case", "grp", F.col("shape").cast("array<int>").alias("shape"), "dtype", *[F.col(c).cast("array<double>").alias(c) for c in ("origin", "spacing", "direction", "values")])
    chosen.write.format("gridspan_volume").option("path", root).option("kind", kind).mode("append").save()
