"""Writers for tables, requests and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.order import with_seq
from . import schemas


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With header, doubled quotes and UTF-8; ``one_file`` is for small results."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_scenarios(rows: DataFrame, path: str, files: int = 1) -> None:
    """A scenario table in the file's own form, ordered by ``scenario_id``: CRLF line ends, in cells too.

    One file, as the study has it, is made by one task; more files, for larger tables, hold ranges of the ids in the order of their names.
    """
    ordered = (rows.repartition(1) if files == 1 else rows.repartitionByRange(files, "scenario_id")).sortWithinPartitions("scenario_id")
    cells = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in schemas.SCENARIOS.names]
    ordered.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def envelope(key: Column, prompt: Column) -> Column:
    """{key, request: {contents: [{parts: [{text}]}]}}."""
    part = F.array(F.struct(prompt.alias("text")))
    contents = F.array(F.struct(part.alias("parts")))
    return F.struct(key.alias("key"), F.struct(contents.alias("contents")).alias("request"))


def write_requests(requests: DataFrame, path: str) -> None:
    """(key, prompt) as request lines."""
    requests.select(F.to_json(envelope(F.col("key"), F.col("prompt"))).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str, bzip2: bool = False) -> None:
    """JSON lines with explicit nulls."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.option("compression", "bzip2") if bzip2 else writer).json(path)


def swap_flags(requests: DataFrame) -> DataFrame:
    """One row with the flags of paired requests in request order, as an array, for a design of a few thousand requests (see ``swap_flag_rows``)."""
    by = F.array_sort(F.collect_list(F.struct("request_no", "swapped")))
    return requests.agg(F.transform(by, lambda x: x["swapped"]).alias("swapped"))


def swap_flag_rows(requests: DataFrame) -> DataFrame:
    """(place, swapped): the flags of paired requests with their places from 0 in request order, for a design of any size."""
    return with_seq(requests.select("request_no", "swapped"), "request_no", name="place").select("place", "swapped")


def frequency_bars(df: DataFrame, label: str) -> DataFrame:
    """(label, frequency): the tidy frame behind a bar chart of shares."""
    total = df.agg(F.count("*").alias("_total"))
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("label", (F.col("n") / F.col("_total")).alias("frequency"))


def counted(df: DataFrame, name: str = "rows", **conditions: Column) -> tuple[DataFrame, Observation]:
    """The frame, and an observation with ``rows`` and the rows that meet each condition, filled in when an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


def shown(df: DataFrame, order: str, first: int = 102) -> list[str]:
    """The first rows in order as lines of text, for a look at the data; only they reach the driver."""
    return [" ".join(map(str, r)) for r in df.orderBy(order).limit(first).collect()]
