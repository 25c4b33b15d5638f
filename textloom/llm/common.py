"""Helpers shared by the corpus operators: words, Arrow batches, written tables, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ``bytes.translate`` table that lower-cases A-Z and leaves other bytes alone.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Keys that hold more than one row in so many are hot.
HOT_SHARE = 10_000
#: Records handed to a Python worker at once; long texts are cut further by ``pieces``.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size if the session still has Spark's default, so that long texts fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="textloom-")
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``written``; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def skew_join(rows: DataFrame, of: DataFrame, key: str, total: int, few: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``of`` that have the same key; ``of`` has unique keys under ``key`` and, as ``n``, how many rows have each.

    Keys of more than one row in ``HOT_SHARE`` of ``total`` are joined by broadcast (there are at most ``HOT_SHARE`` of them), so that no
    task gets all rows of such a key; the others are joined by a shuffle.  Up to ``few`` rows of a key aren't many for one task.
    """
    names = [c for c in of.columns if c not in (key, "n")]
    small = of.select(F.col(key).alias("_key"), F.struct(*names).alias("_of"), "n")
    cut = max(few, total // HOT_SHARE)
    if total <= cut:
        return rows.join(small.drop("n"), F.col(key) == F.col("_key")).select(*rows.columns, "_of.*")
    tagged = rows.join(F.broadcast(small.filter(F.col("n") > cut).drop("n")), F.col(key) == F.col("_key"), "left")
    hot = tagged.filter("_of is not null").select(*rows.columns, "_of.*")
    rest = tagged.filter("_of is null").select(*rows.columns).join(small.filter(F.col("n") <= cut).drop("n"), F.col(key) == F.col("_key"))
    return hot.union(rest.select(*rows.columns, "_of.*"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most`` bytes; one row is never cut.

    The column may be string or binary.  A slice has one row at least.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if i > start and held + sizes[i] > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start, n - start)


def prefix_sums(df: DataFrame, key: str, order: list[str], value: str, label: str) -> DataFrame:
    """Add ``before`` (sum of ``value`` over earlier rows of the key) and ``row`` (0-based rank).

    Rows are range-partitioned by key and order, so a key with a third of all
    rows spreads over a third of the partitions; each partition's totals are
    then summed per key.  That table has at most partitions + keys rows.
    """
    # the rows are written first: range partitioning reads its input twice, and that is the texts
    ranged = written(df, f"{label}-rows").repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id())
    stored = written(ranged, label)
    local = Window.partitionBy("_part", key).orderBy(*order)
    inner = stored.withColumns({
        "_incl": F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, 0)),
        "_row": F.row_number().over(local),
    })
    totals = stored.groupBy("_part", key).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"), F.col(key).alias("_k"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    joined = inner.join(offsets, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumns({
        "before": F.col("_incl") - F.col(value) + F.col("_sum0"),
        "row": (F.col("_row") - 1 + F.col("_n0")).cast("long"),
    }).drop("_part", "_p", "_k", "_incl", "_row", "_sum0", "_n0")
