"""Row numbers without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()


def in_file_order(rows: DataFrame) -> DataFrame:
    """Add ``place``, which orders the rows of a scan as they stand in the files: file name, start of the part of it, row in that part."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("place", at)


def with_seq(df: DataFrame, *order: str, name: str = "seq", start: int = 0) -> DataFrame:
    """Add gapless row numbers in the given order (a total one, for results that don't change).

    The rows are range-partitioned, sorted and numbered within partitions; the partitions' counts,
    one row each, then shift them.  So rows are shuffled once, and no task gets several partitions' rows.
    They are written as Parquet, which takes less disk than a checkpoint, and the counts read one column of it.
    """
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id_of_row", F.monotonically_increasing_id())
    part, row = F.shiftright("_id_of_row", 33), F.col("_id_of_row").bitwiseAND(F.lit((1 << 33) - 1))  # as that function is defined
    numbered = ids.withColumns({"_part": part, "_row": row}).drop("_id_of_row")
    void = any(kind == "void" for _, kind in df.dtypes)  # which Parquet can't hold
    local = _checkpointed(numbered) if void else stored(numbered, "numbered-rows")
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    joined = local.join(F.broadcast(shifts), F.col("_part") == F.col("_p"))  # a row for each partition
    return joined.withColumn(name, F.col("_row") + start + F.col("_shift")).drop("_part", "_row", "_p", "_shift")
