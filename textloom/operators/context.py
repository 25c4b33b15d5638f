"""Sentences and keyword in context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, sentences


def exploded_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and position (from 1), sentence, n_sentences."""
    rest = [c for c in df.columns if c != text]
    return df.withColumn("_s", sentences(F.col(text))).select(*rest, F.size("_s").alias("n_sentences"), F.posexplode("_s").alias("position", "sentence")).withColumn("position", F.col("position") + 1)


def keyword_in_context(df: DataFrame, phrase: str, around: int = 3, text: str = "text") -> DataFrame:
    """The first sentence with the phrase and up to ``around`` sentences on either side.

    A cheap substring test comes before the split.  A phrase that crosses a sentence's end gives no row.
    """
    rest = [c for c in df.columns if c != text]
    split = df.filter(contains_phrase(F.col(text), phrase)).withColumn("_s", sentences(F.col(text)))
    hit = F.array_position(F.transform("_s", lambda s: F.lower(s).contains(phrase.lower())), True).cast("int")
    i, n = F.col("_i"), F.size("_s")
    start, end = F.greatest(F.lit(1), i - around), F.least(n, i + around)
    join = lambda a, b: F.array_join(F.slice("_s", a, b - a + 1), " ")
    return split.withColumn("_i", hit).filter("_i > 0").select(
        *rest, F.lit(phrase).alias("phrase"), F.element_at("_s", i).alias("target_sentence"), join(start, i - 1).alias("before_context"), join(i + 1, end).alias("after_context"),
        join(start, end).alias("full_context"), F.col(text).alias("full_page_text"), F.concat(i.cast("string"), F.lit("/"), n.cast("string")).alias("sentence_position"))
