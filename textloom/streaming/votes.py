"""The vote on arriving results: answers of the judges are held for each question until all are there, or until it is too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import consensus
from ..operators.parse import envelopes, label_answers

_LABELS = "array<struct<is_modifier: boolean, word: string>>"
JUDGED = f"question long, judges array<struct<judge: int, labels: {_LABELS}>>, complete boolean"


def judge_of(key) -> F.Column:
    """The judge's number at the end of a key such as ``request-12-3``."""
    return F.regexp_extract(key, r"-(\d+)$", 1).try_cast("int")


def label_stream(spark: SparkSession, folder: str, files_at_once: int = 100, judges: int = fixed.JUDGES) -> DataFrame:
    """(arrived, question, judge, labels, parse_error) of label results in files that land in a folder.

    ``question`` numbers from 0 what consecutive requests ask of each judge (the chunk of a labelling study); ``arrived`` is when the file was written.  Lines without a key are dropped, as nobody can tell what they answer.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(folder)
    keyed = envelopes(lines.select(F.col("_metadata.file_modification_time").alias("arrived"), F.trim("value").alias("line")).filter("line <> ''"))
    labelled = label_answers(keyed)
    return labelled.select("arrived", F.expr(f"(request_no - 1) div {judges}").alias("question"), judge_of(F.col("key")).alias("judge"), "labels", "parse_error").filter("question is not null and judge is not null")


def _gather(judges: int, wait_ms: int):
    """State of a question: the judges heard so far, each with its labels, and when the first came.

    An answer that can't be parsed counts as heard; of repeated ones the first counts.  A question that is out is remembered until its time is over, so that a late repeat doesn't vote again.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heard, out, since = {}, False, 0
        if state.exists:
            numbers, held, out, since = state.get
            heard = dict(zip(numbers, held))

        def row(complete: bool) -> pd.DataFrame:
            listed = [{"judge": j, "labels": heard[j]} for j in sorted(heard)]
            return pd.DataFrame({"question": [key[0]], "judges": [listed], "complete": [complete]})

        if state.hasTimedOut:
            state.remove()
            if not out:
                yield row(False)
            return
        for frame in frames:
            for judge, labels, arrived in zip(frame["judge"], frame["labels"], frame["arrived"]):
                since = since or int(arrived.timestamp() * 1000)
                found = None if labels is None else [(bool(x["is_modifier"]), x["word"]) for x in labels]
                heard.setdefault(int(judge), found)
        done = not out and len(heard) >= judges
        if done:
            yield row(True)
        out = out or done
        kept = {} if out else heard  # the labels go when the vote is out
        state.update((list(kept), [None if v is None else list(v) for v in kept.values()], out, since))
        state.setTimeoutTimestamp(max(since + wait_ms, state.getCurrentWatermarkMs() + 1))

    return run


def judged_questions(stream: DataFrame, judges: int = fixed.JUDGES, wait: str = "1 day", wait_ms: int = 86_400_000) -> DataFrame:
    """(question, judges, complete): a row for each question as soon as ``judges`` have answered, or with those heard when the watermark is ``wait_ms`` past the first one's arrival.

    ``stream`` has arrived, question, judge and labels.  State is kept for each question that is younger than that.
    """
    state = T.StructType([
        T.StructField("numbers", T.ArrayType(T.IntegerType())),
        T.StructField("labels", T.ArrayType(T.ArrayType(T.StructType([T.StructField("is_modifier", T.BooleanType()), T.StructField("word", T.StringType())])))),
        T.StructField("out", T.BooleanType()), T.StructField("since", T.LongType())])
    keyed = stream.withWatermark("arrived", wait).groupBy("question")
    return keyed.applyInPandasWithState(_gather(judges, wait_ms), JUDGED, state, "append", GroupStateTimeout.EventTimeTimeout)


def votes(judged: DataFrame, literal: bool = False) -> DataFrame:
    """(question, place, is_modifier, modifier_word, complete): the vote on each sentence of each question, as the batch study has it; works on streams and on tables."""
    place = F.explode(F.sequence(F.lit(0), F.array_max(F.transform("judges", lambda j: F.coalesce(F.size(j["labels"]), F.lit(0)))) - 1))
    longest = judged.filter(F.array_max(F.transform("judges", lambda j: F.coalesce(F.size(j["labels"]), F.lit(0)))) > 0)
    each = longest.select("question", "complete", "judges", place.alias("place"))

    def of(n: int, field: str) -> F.Column:
        mine = F.get(F.filter("judges", lambda j: j["judge"] == n), F.lit(0))["labels"]
        return F.get(mine, F.col("place"))[field].alias(f"{'is_modifier' if field == 'is_modifier' else 'modifier_word'}_{n}")

    wide = each.select("question", "complete", "place", *[of(n, f) for n in (1, 2, 3) for f in ("is_modifier", "word")])
    return consensus.consensus(wide, literal)


def write_votes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the votes as Parquet; whatever is there is processed, then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
