"""Line numbers over files that keep coming: a ledger says which numbers each file has, so new files never renumber old lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import readers
from .scratch import exists

LEDGER = "file string, length long, n long, first long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, n, first): the numbered files with their lines and the first one's number."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length) of the folder's files; none is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"), "length").filter("length > 0")


def take_up(spark: SparkSession, folder: str, path: str) -> int:
    """Append the folder's new files to the ledger, in the order of their names, after all numbers that were ever given; how many there were.

    Only new files are read, to count their lines.  A file that has another length than when it was numbered is an error: its lines can't keep their numbers.
    One caller at a time may take files up.
    """
    known = ledger(spark, path)
    seen = _listed(spark, folder).join(known.select(F.col("file").alias("_file"), F.col("length").alias("_length")), F.col("file") == F.col("_file"), "left")
    changed = seen.filter("_length is not null and _length <> length").select("file").head()
    if changed:
        raise ValueError(f"{changed['file']} has changed since its lines were numbered")
    new = {r["file"]: r["length"] for r in seen.filter("_length is null").select("file", "length").collect()}  # names, as any listing has them
    if not new:
        return 0
    given = known.agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0))).first()[0]
    counts = spark.read.schema("value string").text(sorted(new)).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each new file
    counts.select("file", "length", "n", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + given).alias("first")).coalesce(1).write.mode("append").parquet(path)
    return len(new)


def numbered_lines(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """(value, seq) of all lines of the files in the ledger at ``path``, after the folder's new files are taken up; ``seq`` starts at 0 and never changes."""
    take_up(spark, folder, path)
    known = ledger(spark, path).select(F.col("file").alias("_file"), "first")
    files = [r["_file"] for r in known.select("_file").collect()]
    if not files:
        return spark.createDataFrame([], "value string, seq long")
    lines = readers.in_lines(spark, files)
    return lines.join(known, F.col("file") == F.col("_file")).select("value", (F.col("first") + F.col("line_no") - 1).alias("seq"))
