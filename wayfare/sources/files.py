"""CSV hand-offs, image sizes, and the file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.sources.schemas import AFTER_EVENT_EXPORT, FEEDBACK, JOURNEY_EXPORT, LEXICON, USERS_ANALYTICS_EXPORT


def read_journeys(spark: SparkSession, path: str, schema: T.StructType = JOURNEY_EXPORT) -> DataFrame:
    """A journey export; blank cells come back as NULL."""
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def read_users_analytics(spark: SparkSession, path: str) -> DataFrame:
    return read_journeys(spark, path, USERS_ANALYTICS_EXPORT)


def read_after_event(spark: SparkSession, path: str) -> DataFrame:
    return read_journeys(spark, path, AFTER_EVENT_EXPORT)


def read_feedback(spark: SparkSession, path: str, schema: T.StructType = FEEDBACK) -> DataFrame:
    """Feedback texts; a text may span lines and hold quotes.

    A file whose texts span lines cannot be split, so one task reads it whole:
    hand over a folder of many files, or parquet.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON).csv(path, header=True)


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(image_url, size_bytes)`` of the files under ``path``.

    Only names and lengths are selected, so file contents are not read. The
    URL of an image is its path below ``path``, so that equal names in two
    folders stay apart.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.substring(F.col("path"), len(root) + 2, 1 << 30)
    return files.select(below.alias("image_url"), F.col("length").alias("size_bytes"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with header; group keys are plain columns."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON-lines part files."""
    df.write.mode("overwrite").json(path)
