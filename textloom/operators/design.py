"""Factorial designs: expansion, request numbers and keys, chunks.

Numbers come in closed form from the positions of modifier, scenario, attempt and variant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, prompts
from ..functions.text import hashed_swap, modified, unmodified
from ..sources.readers import modifiers

Prompt = Callable[[Column, Column, Column, Column], Column]


def _crossed(scenarios: DataFrame, names: list[str] | None, attempts: int) -> DataFrame:
    """modifiers x scenarios x attempts; the modifiers are a constant relation and the attempts an array."""
    spark = scenarios.sparkSession
    tries = F.sequence(F.lit(0), F.lit(attempts - 1))
    return scenarios.join(modifiers(spark, names)).withColumn("attempt", F.explode(tries))


def single_requests(scenarios: DataFrame, n_scenarios: int, prompt: Prompt, question: str = "predicate_question", names: list[str] | None = None, attempts: int = fixed.ATTEMPTS) -> DataFrame:
    """Baseline and hedged requests: request_no, key, modifier_no, modifier, scenario_id, attempt, variant, question, prompt.

    n = ((m * n_scenarios + r) * attempts + a) * 2 + v + 1; keys are request-n and, for the hedged variant, request-hedge-n.
    """
    variants = F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.lit("baseline").alias("variant"), F.col("baseline").alias("scenario"), F.lit("request-").alias("stem")),
        F.struct(F.lit(1).alias("v"), F.lit("hedge_baseline").alias("variant"), F.col("hedged_baseline").alias("scenario"), F.lit("request-hedge-").alias("stem")),
    ))
    rows = _crossed(scenarios, names, attempts).withColumn("o", variants)
    number = ((F.col("modifier_no") * n_scenarios + F.col("scenario_id")) * attempts + F.col("attempt")) * 2 + F.col("o.v") + 1
    return rows.withColumn("request_no", number.cast("long")).select(
        "request_no", F.concat("o.stem", F.col("request_no").cast("string")).alias("key"), "modifier_no", "modifier", "scenario_id", "attempt", "o.variant",
        F.col(question).alias("question"), prompt(F.col("o.scenario"), F.col("predicate"), F.col(question), F.col("modifier")).alias("prompt"))


def paired_requests(scenarios: DataFrame, n_scenarios: int, polite: bool = False, names: list[str] | None = None, attempts: int = fixed.ATTEMPTS) -> DataFrame:
    """Paired requests with a repeatable swap: request_no, key (request-n-True or -False), ..., swapped, prompt."""
    question = "politeness_question" if polite else "predicate_question"
    build = prompts.paired_politeness_prompt if polite else prompts.paired_choice_prompt
    number = ((F.col("modifier_no") * n_scenarios + F.col("scenario_id")) * attempts + F.col("attempt") + 1).cast("long")
    rows = _crossed(scenarios, names, attempts).withColumn("request_no", number).withColumn("swapped", hashed_swap(F.col("request_no")))
    key = F.concat(F.lit("request-"), F.col("request_no").cast("string"), F.when(F.col("swapped"), "-True").otherwise("-False"))
    text = build(F.col("baseline"), F.col("hedged_baseline"), F.col("swapped"), F.col("predicate"), F.col(question), F.col("modifier"))
    return rows.select("request_no", key.alias("key"), "modifier_no", "modifier", "scenario_id", "attempt", "swapped", F.col(question).alias("question"), text.alias("prompt"))


def rating_items(scenarios: DataFrame, n_scenarios: int, names: list[str] | None = None) -> DataFrame:
    """The four forms of each scenario under each modifier: seq, modifier_no, modifier, scenario_id, form, question, scenario."""
    forms = [("baseline_unmodified", unmodified(F.col("baseline"))), ("baseline_modified", modified(F.col("baseline"), F.col("modifier"))),
             ("c1_unmodified", unmodified(F.col("c1"))), ("c1_modified", modified(F.col("c1"), F.col("modifier")))]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("form"), c.alias("scenario")) for k, (f, c) in enumerate(forms)])
    rows = scenarios.join(modifiers(scenarios.sparkSession, names)).withColumn("o", F.explode(entries))
    seq = ((F.col("modifier_no") * n_scenarios + F.col("scenario_id")) * 4 + F.col("o.k")).cast("long")
    return rows.select(seq.alias("seq"), "modifier_no", "modifier", "scenario_id", "o.form", F.col("predicate_question").alias("question"), "o.scenario")


def rating_prompt(items: DataFrame, seed: str | None = None, size: int | None = None) -> DataFrame:
    """(chunk, prompt, order): the prompt over items and ``order``, the items' seqs as they stand in it.

    All items go into one prompt, as the study asks, so this is for a table of a few hundred rows; with ``size``, each ``size`` items in the order of ``seq`` get a prompt of
    their own, which any number of tasks can make.  With a seed, the order in a prompt is a repeatable shuffle.
    """
    by = F.col("seq") if seed is None else F.xxhash64(F.lit(seed), "seq")
    listed = F.array_sort(F.collect_list(F.struct(by.alias("by"), "seq", "scenario", "question")))
    entries = F.transform("listed", lambda x, i: prompts.scenario_entry(i + 1, x["scenario"], x["question"]))
    chunk = F.lit(0).cast("long") if size is None else F.expr(f"seq div {size}")
    grouped = items.agg(listed.alias("listed")).withColumn("chunk", chunk) if size is None else items.groupBy(chunk.alias("chunk")).agg(listed.alias("listed"))
    return grouped.select("chunk", prompts.all_rating_prompt(F.array_join(entries, "")).alias("prompt"), F.transform("listed", lambda x: x["seq"]).alias("order"))


def chunks(utterances: DataFrame, size: int = fixed.CHUNK, keep_tail: bool = True, restart: bool = True, by: list[str] | None = None) -> DataFrame:
    """(chunk, n, lines, last_seq): numbered sentences, ``size`` to a chunk, from gapless ``seq``.

    ``restart`` numbers each chunk from 1, else numbers run on; without ``keep_tail`` a chunk that isn't full goes.
    """
    number = F.when(F.lit(restart), F.col("seq") % size).otherwise(F.col("seq")) + 1
    line = F.concat(number.cast("string"), F.lit(". "), F.coalesce("text", F.lit("")), F.lit("\n"))
    grouped = utterances.groupBy(*(by or []), F.expr(f"seq div {size}").alias("chunk")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("listed"))
    out = grouped.select(*(by or []), "chunk", "n", F.array_join(F.transform("listed", lambda x: x["line"]), "").alias("lines"))
    return out if keep_tail else out.filter(F.col("n") == size)


def label_requests(chunked: DataFrame, judges: int = fixed.JUDGES) -> DataFrame:
    """The chunk's prompt for each judge: request_no = judges * chunk + judge, key request-n-judge."""
    rows = chunked.withColumn("judge", F.explode(F.sequence(F.lit(1), F.lit(judges))))
    number = (F.col("chunk") * judges + F.col("judge")).cast("long")
    return rows.select(number.alias("request_no"), F.concat(F.lit("request-"), number.cast("string"), F.lit("-"), F.col("judge").cast("string")).alias("key"),
                       "chunk", "judge", "n", prompts.label_prompt(F.col("lines")).alias("prompt"))
