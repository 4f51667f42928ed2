"""Small files beside volumes: landmarks, text tails, sidecars, cached steps of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, x, y, z from lines ``label,x,y,z,...``; lines with # are none. Lines that are no points are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("__line"), "value").where(~F.col("value").startswith("#"))
    cells = F.transform(F.slice(F.split("value", ","), 2, 3), lambda c: F.trim(c).try_cast("double"))
    points = lines.withColumn("p", cells).where((F.size("p") == 3) & F.forall("p", lambda c: c.isNotNull()))
    order = Window.partitionBy("path").orderBy("__line")
    return points.select("path", (F.row_number().over(order) - 1).alias("idx"), *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")])


def landmark_lines(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line: a file's text for each key, three comment lines first, points by index."""
    row = F.concat_ws(",", F.concat(F.lit("p_"), F.col("idx").cast("string")), *[F.col(c).cast("string") for c in "xyz"], F.lit("0,0,0,1,1,1,0"), F.concat(F.lit("F-"), (F.col("idx") + 1).cast("string")), F.lit(""), F.lit(""))
    head = ["# Markups fiducial file version = 4.11", "# CoordinateSystem = LPS", "# columns = id,x,y,z,ow,ox,oy,oz,vis,sel,lock,label,desc,associatedNodeID"]
    body = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", row.alias("line")))), lambda r: r["line"]).alias("rows"))
    return body.select(*keys, F.array_join(F.concat(F.array(*map(F.lit, head)), "rows"), "\n").alias("text"))


def write_landmarks(points: DataFrame, root: str) -> None:
    """A folder ``case=...`` a case, its landmarks as one text file."""
    landmark_lines(points, ["case"]).write.mode("overwrite").partitionBy("case").text(root)


def tail(lines: DataFrame, order: str, n: int) -> DataFrame:
    """The last n lines, in order."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def sidecar(spark: SparkSession, path: str, lines: int = 200, characters: int = 65536) -> DataFrame:
    """A bounded look at the head of a text file: its first lines, each cut at the characters."""
    return spark.read.text(path).limit(lines).select(F.substring("value", 1, characters).alias("line"))


def saved(spark: SparkSession, path: str) -> DataFrame | None:
    """A cached step, if it was written in full."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return None
    return spark.read.parquet(path)


def save(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a cached step and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(rows: DataFrame, text: str, path: str) -> None:
    """JSON lines as text files."""
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
