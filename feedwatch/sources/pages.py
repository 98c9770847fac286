"""Landed bulk-metadata pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwatch import schemas
from feedwatch.operators.records import XML_OPTIONS


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file, for errors and continuation tokens."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("page_id"), F.col("value").alias("xml"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records straight from the page files; ids stay strings and keep their zeros."""
    reader = spark.read.schema(schemas.RAW_RECORD).format("xml").options(**XML_OPTIONS)
    return reader.option("rowTag", "arXivRaw").load(path)
