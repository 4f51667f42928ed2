"""From raw documents to training sequences: quality rules, near duplicates, personal data, packing.

Every stage reads all that the one before kept, as Parquet, and returns the columns of documents; the
last returns pieces of sequences. Nothing leaves the executors but what the operators state. Other
columns of a stage's input, whatever their names, are dropped; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import jaccard_join, packing, pii, quality_bands
from gridspan.llm.histogram_sort import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go; null ids, ties and repeated rows stay or go by their texts; very long texts are judged whole."""
    return quality_bands.keep_good(docs).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.75 connect, one with the lowest id; null ids come last, of ties and repeated rows one stays. Texts without words have no links."""
    return jaccard_join.keep_first(docs).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text, null for a null text. Repeated rows change alike, very long texts as a whole."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of at most 4096 tokens; null and empty texts are the end token alone. Texts can't forge special tokens: their strings are spelled out."""
    return packing.pack_documents(docs, spell_special=True).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Packing is no matter for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``; what each stage before returned is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
