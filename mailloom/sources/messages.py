"""Raw-message dumps: folders of JSON lines or parquet with id, threadId, raw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.schemas import RAW_MESSAGES


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(RAW_MESSAGES).format(fmt).load(path)


def stream_messages(
    spark: SparkSession, path: str, fmt: str = "json", max_files_per_trigger: int = 1000
) -> DataFrame:
    """New files of the folder as a stream; the file limit is the pacing.

    ``arrival`` orders the messages by time and name of their file; the import adds
    the place in the file.
    """
    rows = (
        spark.readStream.schema(RAW_MESSAGES)
        .format(fmt)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return rows.withColumn("arrival", arrival)


def read_database(
    spark: SparkSession, url: str, table: str, *, key: str, lower: str, upper: str, parts: int, **options: str
) -> DataFrame:
    """A database table read in parallel ranges of ``key``, in place of paging."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
        .load()
    )
