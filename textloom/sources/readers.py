"""Readers.  Order that matters is a column (``seq``, ``scenario_id``), never the order of rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import parsed_type, strict_object, stripped
from ..operators.order import in_file_order, with_seq
from . import schemas
from .scratch import shared_path


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The scenario file, or a folder of such files, with ``scenario_id`` from 0 in the order of files and rows, and ``predicate``.

    A quoted cell may hold line breaks, so a task reads a whole file.
    Blocks of five scenarios belong to a predicate, which is also the second word of the question.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\r\n").option("enforceSchema", True).schema(schemas.SCENARIOS)
    rows = reader.csv(path)
    if len(rows.inputFiles()) == 1:
        numbered = rows.withColumn("scenario_id", F.monotonically_increasing_id())  # one file is one partition
    else:
        numbered = with_seq(in_file_order(rows), "place", name="scenario_id").drop("place")
    return numbered.withColumn("predicate", F.get(F.split("predicate_question", " "), F.lit(1)))


def slider_settings(scenario_rows: DataFrame) -> DataFrame:
    """(scenario_id, speaker, modifier, setting, value) from the packed cell; blank cells give nothing."""
    cells = F.split("packed", ",")
    entries = [F.struct(F.lit(m).alias("modifier"), F.lit(s + 1).alias("setting"), F.get(cells, F.lit(1 + 2 * k + s)).try_cast("int").alias("value")) for k, m in enumerate(fixed.MODIFIERS) for s in (0, 1)]
    return scenario_rows.filter("packed is not null").select("scenario_id", F.get(cells, F.lit(0)).alias("speaker"), F.explode(F.array(*entries)).alias("e")).select("scenario_id", "speaker", "e.*").filter("value is not null")


def utterances(spark: SparkSession, path: str, dynamic: bool = False) -> DataFrame:
    """A corpus as JSON lines: id, text, meta and the gapless ``seq``, from 0 in the order of file names and lines, as chunks need it.

    ``meta`` is a map of strings, or if ``dynamic`` a VARIANT that keeps numbers, lists and objects as they are (see ``meta_field``).
    """
    schema = schemas.DYNAMIC_UTTERANCES if dynamic else schemas.UTTERANCES
    return with_seq(in_file_order(spark.read.schema(schema).json(path)), "place").drop("place")


def score(meta: str = "meta", name: str = "Normalized Score"):
    return F.col(meta)[name].try_cast("double")


def meta_field(path: str, kind: str, meta: str = "meta") -> Column:
    """A field of a dynamic ``meta`` by its JSON path, such as ``$.user['Normalized Score']``; null where it is missing or can't be of this kind."""
    return F.try_variant_get(F.col(meta), path, kind)


def meta_fields(df: DataFrame, meta: str = "meta") -> DataFrame:
    """(field, kind, n) for each top-level field of a dynamic ``meta``: the kind of its values as a DDL type, and how many rows have it."""
    entries = F.explode(F.map_entries(F.try_variant_get(F.col(meta), "$", "map<string,variant>"))).alias("e")
    return df.select(entries).groupBy(F.col("e.key").alias("field")).agg(F.schema_of_variant_agg("e.value").alias("kind"), F.count("*").alias("n"))


def wiki_pages(spark: SparkSession, path: str | list[str], corrupt: str | None = None) -> DataFrame:
    """Pages of an XML dump (also .bz2) with their ``place``; the first revision counts, missing elements are null, white space stays.

    A malformed page fails the query; with ``corrupt``, it becomes a row of nulls with its text in the column of that name.
    """
    reader = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", False)
    if corrupt:
        schema = T.StructType([*schemas.PAGES.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).schema(schema)
    else:
        reader = reader.option("mode", "FAILFAST").schema(schemas.PAGES)
    return in_file_order(reader.load(path))


def _namespace(pages: DataFrame, namespace: str) -> DataFrame:
    return pages.filter(F.col("ns") == namespace)


def _talk_page_columns(pages: DataFrame) -> DataFrame:
    first = F.get("revision", F.lit(0))
    return pages.filter(first.isNotNull()).select(
        F.col("id").alias("page_id"), "title", first["timestamp"].alias("timestamp"), first["contributor"]["username"].alias("last_editor"), first["text"]["_VALUE"].alias("text"))


def talk_pages(pages: DataFrame, namespace: str = "3", max_pages: int | None = None) -> DataFrame:
    """page_id, title, timestamp, last_editor, text of the namespace's pages that have a revision.

    ``max_pages`` (none or 0: all) takes the first pages of the namespace by ``place``, before those without a revision go.
    """
    rows = _namespace(pages, namespace)
    return _talk_page_columns(rows.orderBy("place").limit(max_pages) if max_pages else rows)


def first_talk_pages(spark: SparkSession, path: str, max_pages: int, namespace: str = "3") -> DataFrame:
    """As ``talk_pages`` with ``max_pages``, but files after the one with the last of these pages are hardly opened."""
    return _talk_page_columns(first_found(spark, path, lambda files: _namespace(wiki_pages(spark, files), namespace), max_pages))


def first_found(spark: SparkSession, path: str, find: Callable[[list[str]], DataFrame], n: int, at_once: int = 1) -> DataFrame:
    """The first ``n`` rows that ``find`` gives over the files of ``path``, in the order of file names and of ``place`` in them.

    Files are searched in groups of ``at_once``, 2 * ``at_once``, 4 * ``at_once``, ... until there are n rows, so at most about as many files are read in vain as were
    needed; the names are listed, the rest isn't opened.  Each group's rows are written, so that none is read twice.
    """
    files = sorted(spark.read.schema("value string").text(path).inputFiles())
    out, left, start, size = shared_path(spark, "first"), n, 0, at_once
    schema = find(files[:1]).schema
    while left > 0 and start < len(files):
        group = f"{out}/group-{start}"
        find(files[start:start + size]).orderBy("place").limit(left).write.parquet(group)
        left -= spark.read.schema(schema).parquet(group).count()
        start, size = start + size, 2 * size
    if not start:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/group-*")


def in_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, line_no) of text files, also compressed ones: each line with its number in its file, from 1.

    Splits are counted first (a row for each), so that every task can number its own lines.
    """
    rows = spark.read.schema("value string").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    parts = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(F.col("file").alias("_file"), F.col("start").alias("_start"), (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("_shift"))
    joined = rows.join(shifts, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    return joined.select("value", "file", (F.col("id") + F.col("_shift")).alias("line_no"))




def talk_page_lines(spark: SparkSession, path: str | list[str], placed: bool = False) -> DataFrame:
    """Talk pages as JSON lines (also .bz2), with their ``place`` in the files if asked for.

    A malformed line fails the query; the error names the file and the line's beginning.  ``malformed_lines`` finds all of them, with their numbers.
    """
    rows = spark.read.schema("value string").text(path)
    rows = in_file_order(rows.withColumn("_file", F.col("_metadata.file_path"))) if placed else rows.withColumn("_file", F.col("_metadata.file_path"))
    failed = F.raise_error(F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 200)))
    parsed = strict_object(F.col("value"), schemas.TALK_PAGE_FIELDS)
    page = F.coalesce(parsed, failed.cast(parsed_type(schemas.TALK_PAGES)))
    return rows.filter(stripped(F.col("value")) != "").withColumn("_page", page).select(*[F.col("_page")[c].alias(c) for c in schemas.TALK_PAGES.names], *["place"] * placed)


def talk_page_records(spark: SparkSession, path: str | list[str], corrupt: str = "corrupt_record") -> DataFrame:
    """Talk pages as JSON lines with file and line_no; a malformed line gives nulls and its text in the column ``corrupt``."""
    rows = in_lines(spark, path).filter(stripped(F.col("value")) != "").withColumn("_page", strict_object(F.col("value"), schemas.TALK_PAGE_FIELDS))
    return rows.select("file", "line_no", *[F.col("_page")[c].alias(c) for c in schemas.TALK_PAGES.names], F.when(F.col("_page").isNull(), F.col("value")).alias(corrupt))


def malformed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of the lines that aren't one JSON object."""
    return talk_page_records(spark, path, "line").filter("line is not null").select("file", "line_no", "line")


def typed_talk_pages(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"page_id": F.col("page_id").try_cast("long"), "timestamp": F.try_to_timestamp("timestamp")})


def requests(spark: SparkSession, path: str) -> DataFrame:
    """(key, prompt) of a request file."""
    rows = spark.read.schema(schemas.REQUESTS).json(path)
    return rows.select("key", F.get(F.get("request.contents", F.lit(0))["parts"], F.lit(0))["text"].alias("prompt"))


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a result file without blank lines, kept raw for error output."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("line")).filter("line <> ''")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant relation; the whole of it is in the program's text, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def modifiers(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    return inline(spark, list(enumerate(names or fixed.MODIFIERS)), "modifier_no int, modifier string")


def scales(spark: SparkSession) -> DataFrame:
    rows = [(p, k, o) for p, options in fixed.SCALES.items() for k, o in enumerate(options)]
    return inline(spark, rows, "predicate string, option_no int, label string")


def secret(name: str) -> str | None:
    """A provider's key, read from the environment when it is needed and never put into a plan."""
    return os.environ.get(name)
