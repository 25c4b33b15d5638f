"""Repeated judgements to one: ordered concatenation, votes, first-seen deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def ordered_concat(order: str, value: Column, between: str = "", after: str = "") -> Column:
    """Aggregate: the values in order; nulls are left out; ``after`` follows each value."""
    shown = F.concat(value.cast("string"), F.lit(after))
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), shown.alias("v")))))
    return F.array_join(F.transform(listed, lambda x: x["v"]), between)


def replicates(answers: DataFrame, by: list[str], pivot: str, values: list[str], order: str = "attempt", answer: str = "scenario_answer") -> DataFrame:
    """One row for each ``by`` with the variants' concatenated answers as columns."""
    columns = [ordered_concat(order, F.when(F.col(pivot) == v, F.col(answer))).alias(v) for v in values]
    return answers.groupBy(*by).agg(*columns)


def any_true(a: Column, b: Column, c: Column, literal: bool = False) -> Column:
    """Whether a judge said true; literally, a null first judge makes the second one's vote vanish."""
    zero = F.lit(False)
    if literal:
        return F.when(a.isNull(), F.coalesce(c, zero)).otherwise(a | F.coalesce(b, zero) | F.coalesce(c, zero))
    return F.coalesce(a, zero) | F.coalesce(b, zero) | F.coalesce(c, zero)


def first_word(*words: Column) -> Column:
    """The first word that isn't NA, in the judges' order; NA if there is none.  An empty word counts."""
    return F.coalesce(*[F.nullif(w, F.lit("NA")) for w in words], F.lit("NA"))


def wide_judgements(sentences: DataFrame, judged: DataFrame, judges: int = 3) -> DataFrame:
    """Sentences (chunk, place, seq, sentence_text) with the columns is_modifier_j and modifier_word_j.

    ``judged`` has chunk, judge and labels (null: the judge gave nothing).
    """
    long = judged.select("chunk", "judge", F.posexplode("labels").alias("place", "label"))
    columns = []
    for j in range(1, judges + 1):
        mine = F.col("judge") == j
        columns += [F.max(F.when(mine, F.col("label.is_modifier"))).alias(f"is_modifier_{j}"), F.max(F.when(mine, F.col("label.word"))).alias(f"modifier_word_{j}")]
    return sentences.join(long.groupBy("chunk", "place").agg(*columns), ["chunk", "place"], "left")


def consensus(wide: DataFrame, literal: bool = False) -> DataFrame:
    """The vote and the word in place of the judges' columns."""
    flags, words = ([F.col(f"{n}_{j}") for j in (1, 2, 3)] for n in ("is_modifier", "modifier_word"))
    out = wide.withColumns({"is_modifier": any_true(*flags, literal=literal), "modifier_word": first_word(*words)})
    return out.drop(*[f"{n}_{j}" for n in ("is_modifier", "modifier_word") for j in (1, 2, 3)])


def hashed_keys(by: list[str]) -> list[Column]:
    """128 bits that stand for the values of ``by`` in a shuffle."""
    return [F.xxhash64(*by), F.xxhash64(F.lit("second"), *by)]


def keep_first(df: DataFrame, by: list[str], order: str = "seq", keys: Callable[[list[str]], list[Column]] = hashed_keys, part: bool = False) -> DataFrame:
    """The first row of each group in order; nulls are one group.  Groups are aggregated before they are shuffled, so a hot one is one row of each task.

    Rows are grouped by 128 bits of ``by``, never by the values themselves, which may be long texts; each group's different values travel with it once, so
    a collision shows, and fails the query.  With ``part``, rows whose keys collide are grouped again with their SHA-256 besides, for which the table is read twice; it is for
    shorter ``keys``.  ``order`` has no nulls.
    """
    names = [f"_k{i}" for i in range(len(keys(by)))]
    keyed = df.withColumns(dict(zip(names, keys(by))))
    rest = F.struct(*[c for c in df.columns if c not in by], F.lit(1).alias("_one"))
    held = [F.collect_set(F.struct(*by)).alias("_values"), F.min_by(rest, order).alias("_rest")]
    columns = [F.get("_values", F.lit(0))[c].alias(c) if c in by else F.col("_rest")[c].alias(c) for c in df.columns]
    groups = keyed.groupBy(*names).agg(*held)
    told = F.when(F.size("_values") == 1, F.col("_values")).otherwise(F.raise_error(F.lit("different values share a key")))
    if not part:
        return groups.withColumn("_values", told).select(*columns)
    met = groups.filter(F.size("_values") > 1).select(*[F.col(k).alias(f"{k}_") for k in names])
    same = F.lit(True)
    for k in names:
        same = same & (F.col(k) == F.col(f"{k}_"))
    again = keyed.join(met, same, "left_semi").groupBy(*names, F.sha2(F.to_json(F.struct(*by)), 256).alias("_sha")).agg(*held)
    return groups.filter(F.size("_values") == 1).select(*columns).unionByName(again.withColumn("_values", told).select(*columns))


def distinct_first_seen(df: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """(value, first): distinct values with the place where each is first seen; grouped as by ``keep_first``."""
    return keep_first(df.select(value, order), [value], order).select(value, F.col(order).alias("first"))


def unswapped(answers: DataFrame) -> DataFrame:
    """The paired answers as if no pair had been swapped."""
    one, two, swapped = F.col("scenario_1_answer"), F.col("scenario_2_answer"), F.col("swapped")
    return answers.withColumns({"baseline_answer": F.when(swapped, two).otherwise(one), "hedged_answer": F.when(swapped, one).otherwise(two)})


def triplets(keyed: DataFrame, size: int = fixed.JUDGES) -> DataFrame:
    """(triplet, n, keys): requests of consecutive numbers, from 1, that ask the same of each judge; keys in order, joined by commas."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("request_no", "key"))), lambda x: x["key"]), ",")
    return keyed.groupBy(F.expr(f"(request_no - 1) div {size}").alias("triplet")).agg(F.count("*").alias("n"), keys.alias("keys"))


def with_word(labelled: DataFrame, word: str, column: str = "modifier_word") -> DataFrame:
    """The rows whose word is exactly this one; case counts, null doesn't match."""
    return labelled.filter(F.col(column) == word)
