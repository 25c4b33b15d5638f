"""Answers in free text to typed columns.  A row that can't be parsed gets nulls and ``parse_error``, the reason.

Every payload is read strictly: it is one whole JSON value, or it is rejected, whatever stands before or behind a first value.  ``with_rejects`` makes
two tables of parsed rows in one pass, and ``rejected`` shows what was thrown away, by parser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import answer_letter, list_part, object_part, once, request_number, strict_list, strict_lists_by_key, strict_object, stripped, stripped_of, truthy, whole_json
from ..sources.schemas import RESPONSE_FIELDS as RESPONSES

NOT_JSON, NO_ANSWER = "the line isn't a JSON object", "no answer in the envelope"
NO_OBJECT, NO_FIELD = "no answer object", "no answer in the object"
NO_LIST, WRONG_LENGTH = "no list", "wrong length"
NO_PAIR = "a value that isn't a pair"


def response_text(response: Column) -> Column:
    """candidates[0].content.parts[0].text, null where the path is missing."""
    return F.get(F.get(response["candidates"], F.lit(0))["content"]["parts"], F.lit(0))["text"]


def envelopes(lines: DataFrame) -> DataFrame:
    """(key, request_no, raw, line, parse_error) of raw result lines; other columns stay."""
    rest = [c for c in lines.columns if c != "line"]
    parsed = lines.withColumn("_r", strict_object(F.col("line"), RESPONSES))
    raw = response_text(F.col("_r.response"))
    error = F.when(F.col("_r").isNull(), F.lit(NOT_JSON)).when(raw.isNull(), F.lit(NO_ANSWER))
    return parsed.select(*rest, F.col("_r.key").alias("key"), request_number(F.col("_r.key")).alias("request_no"), raw.alias("raw"), "line", error.alias("parse_error"))


def _unanswered(responses: DataFrame) -> Column:
    """The reason that an envelope already has, or that there is no answer."""
    earlier = F.col("parse_error") if "parse_error" in responses.columns else F.lit(None).cast("string")
    return F.coalesce(earlier, F.when(F.col("raw").isNull(), F.lit(NO_ANSWER)))


def answers(responses: DataFrame, fields: tuple[str, ...] = ("scenario_answer",)) -> DataFrame:
    """Add each field of the object in ``raw`` without parentheses, its typed form ``<field>_typed``, and parse_error."""
    out = responses.withColumn("_o", strict_object(object_part(F.col("raw")), ", ".join(f"{f}: string" for f in fields)))
    for f in fields:
        out = out.withColumn(f, stripped_of(F.col("_o")[f], "()")).withColumn(f"{f}_typed", answer_letter(F.col(f)))
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    error = F.coalesce(_unanswered(responses), F.when(F.col("_o").isNull(), F.lit(NO_OBJECT)).when(missing, F.lit(NO_FIELD)))
    return out.withColumn("parse_error", error).drop("_o")


def _listed(responses: DataFrame, expected: int | Column | None, cut: bool) -> DataFrame:
    """Add ``_a``, the strings of the list in ``raw``, and parse_error."""
    parsed = responses.withColumn("_a", strict_list(list_part(stripped(F.col("raw")))))
    error = F.when(F.col("_a").isNull(), F.lit(NO_LIST))
    if expected is not None:
        most = F.lit(expected) if isinstance(expected, int) else expected
        if cut:
            parsed = parsed.withColumn("_a", F.slice("_a", F.lit(1), most))
        error = error.when(F.size("_a") != most, F.lit(WRONG_LENGTH))
    return parsed.withColumn("parse_error", F.coalesce(_unanswered(responses), error))


def list_answers(responses: DataFrame, expected: int | Column | None = None, cut: bool = False) -> DataFrame:
    """Add ``answers``, the strings of the list in ``raw``, and parse_error; a list of another length than ``expected`` is rejected whole, since its places can't be trusted.

    ``cut`` takes the first ``expected`` of a longer list instead.
    """
    return _listed(responses, expected, cut).withColumn("answers", F.when(F.col("parse_error").isNull(), F.col("_a"))).drop("_a")


def array_answers(responses: DataFrame, expected: int | Column | None = None) -> DataFrame:
    """Explode the list in ``raw``: the other columns, place (from 0), answer; with parse_error for rows without a list, and on each answer of a list of another length."""
    kept = [c for c in responses.columns if c != "parse_error"]
    return _listed(responses, expected, False).select(*kept, "parse_error", F.posexplode_outer("_a").alias("place", "answer"))


def label_answers(responses: DataFrame, literal: bool = False) -> DataFrame:
    """Add ``labels`` (see ``labels``) and parse_error."""
    parsed = responses.withColumn("labels", labels(F.col("raw"), literal))
    whole = whole_json(object_part(repaired(F.col("raw"), literal)))
    error = F.when(F.col("labels").isNull(), F.coalesce(_unanswered(responses), F.when(whole.isNull(), F.lit(NO_OBJECT)).otherwise(F.lit(NO_PAIR))))
    return parsed.withColumn("parse_error", error)


def rejected(parsed: DataFrame, parser: str, text: str = "raw") -> DataFrame:
    """(parser, key, line, reason) of the rows with a parse_error; ``line`` is the text that couldn't be read."""
    shown = F.coalesce(*[F.col(c) for c in (text, "line") if c in parsed.columns])
    return parsed.filter("parse_error is not null").select(F.lit(parser).alias("parser"), F.col("key"), shown.alias("line"), F.col("parse_error").alias("reason"))


@dataclass
class Parsed:
    """Two tables of one pass, and how many rows each has."""

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def with_rejects(parsed: DataFrame, parser: str, path: str, text: str = "raw") -> Parsed:
    """Write parsed rows once, the rejected ones in a folder of their own, and read both back.

    The rows are parsed and counted while they are written; reading one of the two doesn't touch the other's files.
    """
    flag = "rejected"
    while flag in parsed.columns:
        flag += "_"
    seen = Observation(parser)
    bad = F.col("parse_error").isNotNull()
    watched = parsed.withColumn(flag, bad).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
    watched.write.mode("overwrite").partitionBy(flag).parquet(path)
    stored = parsed.sparkSession.read.schema(watched.schema).parquet(path)
    rows, bad_rows = seen.get["rows"], seen.get["bad"]
    return Parsed(stored.filter(~F.col(flag)).drop(flag, "parse_error"), rejected(stored.filter(flag), parser, text), rows - bad_rows, bad_rows)


def repaired(raw: Column, literal: bool = False) -> Column:
    """A label payload with Python tuples as JSON.

    Literally, letters F and T become small wherever they stand; otherwise only pairs at value position change.
    """
    raw = stripped(raw)
    if literal:
        return F.replace(F.replace(F.translate(raw, "()FT", "[]ft"), F.lit(",NA"), F.lit(',"NA"')), F.lit(" NA"), F.lit('"NA"'))
    pair = r':\s*\(\s*"?([A-Za-z0-9.]+)"?\s*,\s*'
    return F.regexp_replace(F.regexp_replace(raw, pair + r'("(?:[^"\\]|\\.)*")\s*\)', ': ["$1", $2]'), pair + r"NA\s*\)", ': ["$1", "NA"]')


def _label_entries(raw: Column, literal: bool) -> Column:
    return F.map_entries(strict_lists_by_key(object_part(repaired(raw, literal))))


def _labels_of(entries: Column) -> Column:
    def paired(values: Column) -> Column:
        whole = F.forall(values, lambda v: v.isNotNull() & (F.size(v) >= 2))
        return F.when(whole, F.transform(values, lambda v: F.struct(truthy(F.get(v, F.lit(0))).alias("is_modifier"), F.get(v, F.lit(1)).alias("word"))))

    def valued(keys: Column) -> Column:
        last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
        return F.when(F.size(keys) == F.size(entries), F.transform(entries, lambda e: e["value"])).otherwise(last)  # few payloads repeat a key

    return once(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda keys: once(valued(keys), paired))


def labels(raw: Column, literal: bool = False) -> Column:
    """array<struct<is_modifier, word>> in the order of the payload's keys; null if it can't be parsed.

    Of repeated keys the last value counts, at the first one's place.  A value that isn't a pair makes the whole null.
    """
    return once(_label_entries(raw, literal), _labels_of)
