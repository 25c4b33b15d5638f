"""Operators that are to do their whole job: files written, rows without ids of their own."""

from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import line_dedup, sharding, simhash, toxicity

from .cases import frame, odd_rows
from .test_documents import linked, simhash_of


def test_reshard_writes(spark, monkeypatch):
    """The digest is that of the plan, and comes from shards that were written with their texts."""
    docs, made = frame(spark, odd_rows()), []
    rewrite = sharding.rewrite
    monkeypatch.setattr(sharding, "rewrite", lambda plan, docs, path, *more: made.append((path, rewrite(plan, docs, path, *more))) or made[-1][1])
    args = (sharding.old_layout(), sharding.OLD_SHARDS, sharding.NEW_SHARDS)
    found = sharding.resharded(docs, *args)
    want = sharding.digest(sharding.reshard(docs, *args))
    assert found.columns == want.columns and Counter(found.collect()) == Counter(want.collect())
    (path, changed), = made
    assert {r["shard"] for r in want.collect()} - set(changed) == set()
    assert Counter(r["text"] for r in spark.read.parquet(path).collect()) == Counter(r["text"] for r in docs.collect())


def test_rewrite_live_layout(spark, tmp_path):
    """Shards that aren't affected stay, and one that loses all its rows goes."""
    path = str(tmp_path / "live")
    rows = [(i, f"text {i}", i % 4) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("slot", F.col("doc_id")).write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    plan = sharding.sized(docs, F.col("shard"), F.when(F.col("shard") == 3, 1).otherwise(F.col("shard")).alias("shard"), F.col("doc_id").alias("slot"))
    assert sorted(sharding.rewrite(plan, docs, path, F.col("shard"))) == [1, 3]
    now = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in now.collect()) == [(i, t, 1 if s == 3 else s) for i, t, s in rows]


def test_one_of_each_row(spark):
    """Null and repeated ids: each group keeps one row, the first by id with nulls last."""
    near = odd_rows()[5][1].split()
    data = odd_rows() + [(None, " ".join(near), None, None, None, None, None, None), (7, "a clean text that shares the id of another row", "en", "s1", 1, 1, "k", "s")]
    data += [(None, odd_rows()[2][1] + " ", "en", "s1", 1, 1, "k", "s")] * 2 + [(None, "only rows without an id", "en", "s1", 1, 1, "k", "s"), (None, "only  rows without an id", "en", "s1", 1, 1, "k", "s")]
    groups = {}
    for d, r in zip(data, linked([simhash_of(d[1]) for d in data])):
        groups.setdefault(r, []).append(d)
    want = Counter(min((d[0] is None, d[0] or 0) for d in g) for g in groups.values())
    kept = simhash.one_of_each(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    found = kept.collect()
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == want
    assert len({simhash_of(r["text"]) for r in found}) == len(found) == len(groups)


def test_lines_of_rows_without_own_ids(spark):
    """Equal lines at one place of rows that share an id, or have none, are duplicates; other lines stay."""
    texts = ["the same first line\nred green blue", "the same first line\none two three", "a b c d\nsun moon star", "a b c d\nfire water earth"]
    data = [(i, t, "en", "s", 1, 1, "k", "s") for i, t in zip((None, None, 5, 5), texts)]
    counts = line_dedup.line_counts(frame(spark, data))
    assert counts.columns == ["doc_id", "n_lines", "n_exact", "n_similar"]
    assert Counter(tuple(r) for r in counts.collect()) == Counter([(None, 2, 0, 0), (None, 2, 1, 0), (5, 2, 0, 0), (5, 2, 1, 0)])
    kept = line_dedup.dedup_lines(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert Counter(x for r in kept.collect() for x in r["text"].split("\n")) == Counter({x: 1 for t in texts for x in t.split("\n")})


def test_sql_is_text():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def test_ordinary_windows(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_content", lambda samples, most: seen.append(len(samples)) or b"")
    monkeypatch.setattr(toxicity, "ORDINARY_WINDOWS", 7)
    toxicity._dictionaries([b"word " * 600, b"other " * 600], [0, 1], 1)
    assert seen[0] == 7
