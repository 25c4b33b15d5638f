"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a token budget.  Complete epochs of a source come first; the
fraction that is left goes to documents in the order of their exponential keys
``-ln(u) / weight``, prefix-summed until the budget is met.  ``u`` is a hash of
the seed and the doc_id, so reruns and retries agree.  In a table where ids repeat or are null, it is a hash of the seed, the doc_id, the
text's hash and the number of the row among those that share both: every row draws for itself, and reruns draw the same.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; ties are ordered by doc_id, size and text hash; a source without words has target 0; an empty table gives an empty result;
other columns are ignored by ``mix`` and kept as they are by ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, prefix_sums, table, word_count, written

SYMBOLS = "#*$%&|<>"
MOST_EPOCHS = 3
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: words against words and symbols, so that symbol noise is drawn later."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return (size + 1).cast("double") / (size + 1 + F.coalesce(symbols, F.lit(0))).cast("double")


def exponential_key(name: Column, weight: Column, seed: str = SEED) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(name.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**52 + 1))
    return -F.log(u) / weight


def targets(sizes: dict[str | None, int], most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Words for each source: weights 1, 2, 3, repeating in code-point order, null last.

    All words are shared by weight.  A source never gets more than ``most`` times
    its size; what is cut off is shared again by weight among the others.  The
    sources that reach their limit are those of least size per weight.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    order = sorted(names, key=lambda s: (most * sizes[s] / weight[s], names.index(s)))
    left, heavy, out = sum(sizes.values()), sum(weight.values()), {}
    for k, s in enumerate(order):
        share = left / heavy
        if share <= most * sizes[s] / weight[s]:
            out |= {t: share * weight[t] for t in order[k:]}
            break
        out[s] = float(most * sizes[s])
        left, heavy = left - most * sizes[s], heavy - weight[s]
    return out


def occurrences(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash and others, written) with ``nth``: 0, 1, ... among the rows that share doc_id and text_hash.

    Rows are numbered in the partitions they stand in, and each partition's numbers are shifted by the counts of those before it, so that no task gets all of equal rows.
    Which of equal rows gets which number doesn't matter.
    """
    placed = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mix-occurrences")
    same = ["doc_id", "text_hash"]
    counts = placed.groupBy("_part", *same).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(F.col("_part").alias("_p"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.coalesce(earlier, F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part", *same).orderBy("_at")) - 1
    met = (F.col("_part") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return placed.withColumn("_own", own).join(shifts, met).withColumn("nth", F.col("_own") + F.col("_shift")).drop("_part", "_at", "_own", "_p", "_id", "_hash", "_shift")


def own_ids(docs: DataFrame) -> bool:
    """Whether every row has an id, and no other row the same."""
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    return rows == ids


def mix(docs: DataFrame, weight: Column | None = None, most: int = MOST_EPOCHS, seed: str = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, chosen, taken, text_hash and the columns ``also``.

    ``weight`` is a positive column of ``docs``; by default ``quality_weight``.
    The driver sees one row per source.  The fraction is taken while a document's
    middle word is inside what is left of the budget: a source misses its target
    by half a document at most.
    """
    size = word_count(F.col("text"))
    keyed = docs.select(
        "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"), *also,
        (weight if weight is not None else quality_weight(F.col("text"), size)).alias("weight"),
    )
    name = F.col("doc_id")
    if not own_ids(docs):
        keyed = occurrences(keyed)
        name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text_hash", "nth")
    keyed = keyed.withColumn("key", exponential_key(name, F.col("weight"), seed)).select("doc_id", "source", "size", "text_hash", *also, "key")
    ordered = written(prefix_sums(keyed, "source", ["key", "doc_id", "size", "text_hash"], "size", "mix"), "mix-order")
    sizes = {r["source"]: int(r["s"]) for r in ordered.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    goal = targets(sizes, most)
    rows = []
    for s, n in sizes.items():
        epochs = min(most, int(goal[s] // n)) if n else 0
        rows.append((s, n, goal[s], epochs, goal[s] - epochs * n))
    schema = T.StructType([
        T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("epochs", T.IntegerType()), T.StructField("budget", T.DoubleType()),
    ])
    plan = docs.sparkSession.createDataFrame(rows, schema)
    chosen = (F.col("before") + F.col("size") / 2 <= F.col("budget")).cast("int") * (F.col("size") > 0).cast("int")
    return ordered.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("chosen", chosen).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "chosen",
        (F.col("size") * (F.col("epochs") + F.col("chosen"))).cast("long").alias("taken"), "text_hash", *also,
    )


def mixed_rows(docs: DataFrame, weight: Column | None = None, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns of ``docs``.

    Where ids repeat or are null, the rows are numbered first, so that each gets its own decision and no task gets all of equal rows.
    """
    if own_ids(docs):
        left, name = docs, "doc_id"
    else:
        name = fresh(docs, "_row_number")
        left = written(docs.withColumn(name, F.monotonically_increasing_id()), "mix-rows")
    found = mix(left, weight, most, seed, () if name == "doc_id" else (name,))
    takes = written(found.select(F.col(name).alias("_id"), (F.col("epochs") + F.col("chosen")).alias("_times")).filter("_times > 0"), "mix-takes")
    copy = fresh(docs, "_copy")
    return left.join(takes, left[name] == takes["_id"]).select(
        *[left[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), takes["_times"])).alias(copy)).drop(copy)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "epochs", "chosen")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols
  FROM documents
), k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 1)
            / CAST(4503599627370497 AS DOUBLE)) / (CAST(size + 1 AS DOUBLE) / CAST(size + 1 + symbols AS DOUBLE)) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS ratio FROM s
), c AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM r
), f AS (
  SELECT min_by(CAST(words_left AS DOUBLE) / CAST(weight_left AS DOUBLE), ratio) AS share
  FROM c WHERE CAST(words_left AS DOUBLE) / CAST(weight_left AS DOUBLE) <= ratio
), t AS (
  SELECT source, source_size, CASE WHEN share <= ratio THEN share * weight ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM r, f
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(3, floor(target / source_size)) AS INTEGER) END AS epochs FROM t
), o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM k
)
SELECT o.doc_id, o.size, e.source_size, e.target,
       CAST(o.size * (e.epochs + CASE WHEN o.size > 0 AND o.before + o.size / 2 <= e.target - e.epochs * e.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       o.source, CAST(e.epochs AS INTEGER) AS epochs,
       CAST(CASE WHEN o.size > 0 AND o.before + o.size / 2 <= e.target - e.epochs * e.source_size THEN 1 ELSE 0 END AS INTEGER) AS chosen
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""
