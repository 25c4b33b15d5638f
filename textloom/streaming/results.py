"""Streams of result files: an extension for answers that arrive while a study runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import answers, envelopes


def result_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parsed answers of result lines in files that land in a folder, the first of each key.

    The key state is dropped a day after a key's file was written.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).withColumn("arrived", F.col("_metadata.file_modification_time"))
    keyed = envelopes(lines.select("arrived", F.trim("value").alias("line")).filter("line <> ''")).filter("key is not null")
    return answers(keyed.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["key"]))


def write_answers(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the answers as Parquet; whatever is there is processed, then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
