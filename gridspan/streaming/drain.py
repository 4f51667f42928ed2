"""Streams run to the end of what is there, their results as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or in a local session the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    # A pattern, since a stream takes no single file.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(df: DataFrame, name: str) -> DataFrame:
    """What an appending stream gives for all that is there, exactly once: batches that come again after a loss are known to the sink's own log."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    query = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def final(df: DataFrame, name: str) -> DataFrame:
    """The last complete result of a running aggregate: each batch writes its whole result over the one before, in a folder of its number."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last[:] = [number]

    query = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], df.schema)
