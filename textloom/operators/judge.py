"""The boundary to whoever answers the requests: replayed answers, a deterministic stub, or a callable.

A judge is asked once for each key.  A callable's answers are written before they are used, so
that no later plan asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources import readers, schemas, sinks
from ..sources.scratch import exists, stored
from .parse import envelopes


class Judge(Protocol):
    def judge(self, requests: DataFrame) -> DataFrame:
        """The requests with ``raw``, the answer's text or null."""


class ReplayJudge:
    """Recorded answers (key, raw); of repeated keys the least answer counts, missing ones are null."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    @classmethod
    def from_results(cls, spark: SparkSession, path: str) -> ReplayJudge:
        return cls(envelopes(readers.result_lines(spark, path)).select("key", "raw"))

    def judge(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.responses.groupBy("key").agg(F.min("raw").alias("raw")), "key", "left")


class StubJudge:
    """Answers A-E from a hash of the key, in a fence and parentheses as models write them."""

    def judge(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("raw", stub_answer(F.col("key")))


def stub_answer(key):
    letter = F.substring(F.lit("ABCDE"), F.pmod(F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("int"), F.lit(5)) + 1, F.lit(1))
    return F.concat(F.lit('```json\n{"scenario_answer": "('), letter, F.lit(')"}\n```'))


class CallableJudge:
    """A function from a list of prompts to a list of answers, called in ``parallel`` tasks on batches."""

    def __init__(self, answer: Callable[[list[str]], list[str]], path: str, parallel: int = 8):
        self.answer, self.path, self.parallel = answer, path, parallel

    def judge(self, requests: DataFrame) -> DataFrame:
        answer = self.answer

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"key": f["key"], "raw": answer(f["prompt"].tolist())})

        asked = requests.select("key", "prompt").dropDuplicates(["key"]).repartition(self.parallel, "key").mapInPandas(ask, "key string, raw string")
        asked.write.mode("overwrite").parquet(self.path)
        return requests.join(requests.sparkSession.read.parquet(self.path), "key", "left")


LEDGER = "key string, prompt_md5 string, attempt int, raw string, error string"


class LedgerJudge:
    """A function from prompts to answers whose answers are kept: a later run asks only what has none yet.

    The ledger is a folder of Parquet files that is only appended to, a row for each time a request was asked.  Requests that are missing in it are asked in ``waves``, each
    appended when it is done, so a run that is stopped loses one wave at most; tasks that are lost meanwhile are run again, and may ask again what they
    had not handed on.  A batch whose function raises is noted with the error, and asked again by later attempts until it was asked ``attempts`` times; then it
    stays null.  A key whose prompt has changed counts as a new request.  ``batch`` prompts go to the function at once.
    """

    def __init__(self, answer: Callable[[list[str]], list[str]], path: str, parallel: int = 8, attempts: int = 3, waves: int = 8, batch: int = 100):
        self.answer, self.path, self.parallel, self.attempts, self.waves, self.batch = answer, path, parallel, attempts, waves, batch

    def ledger(self, spark: SparkSession) -> DataFrame:
        """All that was asked: (key, prompt_md5, attempt, raw, error)."""
        return spark.read.schema(LEDGER).parquet(self.path) if exists(spark, self.path) else spark.createDataFrame([], LEDGER)

    def answered(self, spark: SparkSession) -> DataFrame:
        """(key, prompt_md5, raw, asked): a row for each request in the ledger, with its first answer or null."""
        kept = F.min(F.when(F.col("raw").isNotNull(), F.struct("attempt", "raw")))
        return self.ledger(spark).groupBy("key", "prompt_md5").agg(kept["raw"].alias("raw"), F.max("attempt").alias("asked"))

    def missing(self, requests: DataFrame) -> DataFrame:
        """(key, prompt, prompt_md5, attempt) of the requests to ask now, each key and prompt once."""
        asked = requests.select("key", "prompt", F.md5("prompt").alias("prompt_md5")).dropDuplicates(["key", "prompt_md5"])
        known = self.answered(requests.sparkSession).select(F.col("key").alias("_key"), F.col("prompt_md5").alias("_md5"), F.col("raw").alias("_raw"), "asked")
        same = F.col("key").eqNullSafe(F.col("_key")) & F.col("prompt_md5").eqNullSafe(F.col("_md5"))
        again = asked.join(known, same, "left").filter(F.col("_raw").isNull() & (F.coalesce("asked", F.lit(0)) < self.attempts))
        return again.select("key", "prompt", "prompt_md5", (F.coalesce("asked", F.lit(0)) + 1).alias("attempt"))

    def _asking(self) -> Callable:
        answer, batch = self.answer, self.batch

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in range(0, len(frame), batch):
                    part = frame.iloc[start:start + batch]
                    raw, error = [None] * len(part), None
                    try:
                        raw = list(answer(part["prompt"].tolist()))
                        if len(raw) != len(part):
                            raw, error = [None] * len(part), f"{len(raw)} answers to {len(part)} prompts"
                    except Exception as e:  # noqa: BLE001 - whatever the function raises is noted, and asked again
                        error = f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"key": part["key"], "prompt_md5": part["prompt_md5"], "attempt": part["attempt"].astype("int32"), "raw": raw, "error": error})

        return ask

    def ask(self, requests: DataFrame) -> int:
        """Ask what is missing, once; how many requests were asked."""
        spark = requests.sparkSession
        todo = stored(self.missing(requests).withColumn("_wave", F.pmod(F.xxhash64("key", "prompt_md5"), F.lit(self.waves)).cast("int")), "to-ask")
        sizes = {r["_wave"]: r["n"] for r in todo.groupBy("_wave").agg(F.count("*").alias("n")).collect()}  # a row for each wave
        for wave in sorted(sizes):
            rows = todo.filter(F.col("_wave") == wave).drop("_wave").repartition(self.parallel, "key", "prompt_md5")
            rows.mapInPandas(self._asking(), LEDGER).write.mode("append").parquet(self.path)
        return sum(sizes.values())

    def judge(self, requests: DataFrame) -> DataFrame:
        for _ in range(self.attempts):
            if not self.ask(requests):
                break
        known = self.answered(requests.sparkSession).select(F.col("key").alias("_key"), F.col("prompt_md5").alias("_md5"), F.col("raw").alias("_raw"))
        same = F.col("key").eqNullSafe(F.col("_key")) & F.md5("prompt").eqNullSafe(F.col("_md5"))
        return requests.join(known, same, "left").select(*requests.columns, F.col("_raw").alias("raw"))


class Provider(Protocol):
    """A remote batch service: jobs are submitted, listed and fetched by the driver, outside any plan."""

    def submit(self, path: str, display_name: str) -> str: ...

    def jobs(self) -> list[dict]: ...


class FolderProvider:
    """A provider without a network: a job is answered at once by a judge, and its results lie beside the requests."""

    def __init__(self, spark: SparkSession, judge: Judge):
        self.spark, self._judge, self._jobs = spark, judge, []

    def submit(self, path: str, display_name: str) -> str:
        judged = self._judge.judge(readers.requests(self.spark, path))
        text = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("raw").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
        judged.select(F.to_json(F.struct("key", text.alias("response"))).alias("value")).write.mode("overwrite").text(f"{path}.results")
        job = {"job_name": f"batches/{len(self._jobs) + 1}", "state": fixed.ENDED_STATES[0], "src_file": path, "dest_file": f"{path}.results", "display_name": display_name}
        self._jobs.append(job)
        return job["job_name"]

    def jobs(self) -> list[dict]:
        return list(self._jobs)


def job_table(spark: SparkSession, provider: Provider, limit: int | None = None) -> DataFrame:
    """job_name, state, src_file, dest_file, display_name, ended; the first ``limit`` jobs, if given."""
    jobs = provider.jobs()[:limit]
    rows = [tuple(j[n] for n in schemas.JOBS.names) for j in jobs]
    return spark.createDataFrame(rows, schemas.JOBS).withColumn("ended", F.col("state").isin(fixed.ENDED_STATES))


def submit(provider: Provider, requests: DataFrame, path: str, display_name: str) -> str:
    """Write the requests and submit them; the job's name."""
    sinks.write_requests(requests, path)
    return provider.submit(path, display_name)


def fetch(spark: SparkSession, provider: Provider, job_name: str) -> DataFrame:
    """The parsed envelopes of an ended job."""
    job = next(j for j in provider.jobs() if j["job_name"] == job_name)
    if job["state"] not in fixed.ENDED_STATES:
        raise RuntimeError(f"{job_name} is in state {job['state']}")
    return envelopes(readers.result_lines(spark, job["dest_file"]))
