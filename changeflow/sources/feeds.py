"""Change feeds: decoded change rows as a batch or as a stream, the position being a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from changeflow.schemas import CHANGE_EVENT


def read_change_feed(spark: SparkSession, path: str, schema: str | StructType = CHANGE_EVENT) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_change_feed(
    spark: SparkSession, folder: str, schema: str | StructType = CHANGE_EVENT, files_per_batch: int | None = None, names: str | None = None
) -> DataFrame:
    """Files of a folder in arrival order; `files_per_batch` is the batch size of the relay."""
    reader = spark.readStream.schema(schema)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
