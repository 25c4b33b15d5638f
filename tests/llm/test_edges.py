"""Odd rows through whole operators and through every stage of the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, quality, sharding, suffix_dedup

from .cases import DDL, frame, odd_rows
from .test_documents import brute_spans, linked, simhash_of
from .test_models import corpus, items_of


def test_gradients_by_differences():
    """Each parameter's gradient against the loss's own differences."""
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 3])
    x, starts, y = rng.normal(0, 1, (counts.sum(), quality.FEATURES)), np.cumsum(counts) - counts, np.array([0.0, 1.0, 1.0, 0.0])
    model = quality.fit([rng.normal(k % 2, 1, (3, quality.FEATURES)) for k in range(8)], [k % 2 for k in range(8)])

    def loss():
        p = model.forward(x, starts, counts)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * (model.params["W"] ** 2).sum()

    for name, grad in model.gradients(x, starts, counts, y).items():
        value = model.params[name]
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)]:
            found = []
            for step in (1e-5, -1e-5):
                moved = np.array(value)
                moved[at] += step
                model.params[name] = moved
                found.append(loss())
            model.params[name] = value
            assert abs((found[0] - found[1]) / 2e-5 - np.asarray(grad)[at]) < 1e-6, name


def test_spans_of_odd_ids(spark):
    """Null and repeated ids: the rows' order is by id (nulls last) and hash of the text, and bytes go as in that order."""
    data = odd_rows()
    data += [(4, data[0][1] + " more of it", *[None] * 6), (None, "x" * 30 + data[5][1], *[None] * 6), (None, data[5][1][::-1], *[None] * 6)]
    hashes = [r["h"] for r in spark.createDataFrame([(i, d[1]) for i, d in enumerate(data)], "i long, t string").select("i", F.xxhash64("t").alias("h")).orderBy("i").collect()]
    ordered = [d for d, _ in sorted(zip(data, hashes), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))]
    want = Counter((d[0], *w) for d, w in zip(ordered, brute_spans([(d[0], (d[1] or "").encode()) for d in ordered])))
    found = suffix_dedup.deduplicate(frame(spark, data)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, r["kept_sha256"]) for r in found) == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, empty and long texts, extra columns: a stage loses only what its operator decides on."""
    import random

    import corpus_pipeline

    docs, labels = corpus(120)
    items = items_of(spark, random.Random(1), 4) + [(None, None)]
    for name, rows, ddl in (("labels", labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    odd, stages = [(None if d[0] is None else d[0] + 5000, *d[1:]) for d in odd_rows()], dict(corpus_pipeline.STAGES)
    sf, key = str(tmp_path), lambda r: (r["doc_id"], r["text"])
    rows = frame(spark, docs + odd)

    kept = stages["quality classifier"](spark, rows, sf).collect()
    assert not Counter(map(key, kept)) - Counter(map(key, rows.collect())) and len(kept[0]) == 8

    one = stages["simhash near-dedup"](spark, frame(spark, odd), sf)
    assert one.columns == frame(spark, odd).columns
    roots = linked([simhash_of(d[1]) for d in odd])
    assert one.count() == len(set(roots)) and {simhash_of(r["text"]) for r in one.collect()} <= {simhash_of(d[1]) for d in odd}

    leaked = odd + [(None, items[0][1], *[None] * 6), (5001, "before " + items[1][1] + " after", *[None] * 6)]
    clean = stages["benchmark decontamination"](spark, frame(spark, leaked), sf)
    assert clean.columns == frame(spark, odd).columns and Counter(map(key, clean.collect())) == Counter((d[0], d[1]) for d in odd)

    mixed = stages["mixing"](spark, frame(spark, odd), sf)
    takes = Counter()
    for r in mixing.mix(frame(spark, odd)).collect():
        takes[(r["doc_id"], r["size"])] += r["epochs"] + r["chosen"]
    assert mixed.columns == frame(spark, odd).columns
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed.collect()) == +takes

    dealt = stages["sharding"](spark, frame(spark, odd), sf).collect()
    assert Counter(r["doc_id"] for r in dealt) == Counter(d[0] for d in odd)
    slots = {}
    for r in dealt:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DDL), sf).count() == 0, name


CLASHING = ["_copy", "_number", "_row_number", "_id", "shard", "slot", "_n", "_times", "_gone"]


@pytest.mark.parametrize("unique", [True, False])
def test_stages_keep_clashing_columns(spark, tmp_path, unique):
    """Columns with the names that stages use themselves come out as they went in, with unique ids and with null and repeated ones."""
    import random

    import corpus_pipeline

    docs, labels = corpus(60)
    items = items_of(spark, random.Random(1), 4)
    for name, rows, ddl in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = [(None if d[0] is None else d[0] + 5000, *d[1:]) for d in odd_rows()]
    data = docs if unique else docs + odd
    table = [(*d[:5], *[700 + 10 * i + k for k in range(len(CLASHING))]) for i, d in enumerate(data)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
    rows = {t: None for t in table}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, spark.createDataFrame(table, ddl).repartition(3), str(tmp_path))
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING], name
        kept = [tuple(r) for r in found.collect()]
        assert kept and set(kept) <= set(rows), name
    given = spark.createDataFrame(table, ddl).repartition(3)
    paths = []
    rewrite = sharding.rewrite
    sharding.rewrite = lambda plan, docs, path, *more: paths.append(path) or rewrite(plan, docs, path, *more)
    try:
        dealt = corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).collect()
    finally:
        sharding.rewrite = rewrite
    assert Counter(r["doc_id"] for r in dealt) == Counter(t[0] for t in table)
    files = spark.read.parquet(paths[0]).select(*given.columns).collect()
    assert Counter(map(tuple, files)) == Counter(table)


def test_rows_without_an_id_are_drawn_whatever_their_length(spark):
    """Null and repeated ids: each row draws for itself, so that long rows are taken as well as short ones, and reruns agree."""
    data = [(None if i % 2 else 7, " ".join(["word"] * (1 + i // 10)), "en", "a", 1, 1, "k", "s") for i in range(1000)]
    data += [(10_000 + i, "other words " * 40, "en", f"b{i % 5}", 1, 1, "k", "s") for i in range(200)]
    by_size = {}
    for n in (3, 5):
        found = mixing.mix(frame(spark, data, n)).filter("source = 'a'").select("doc_id", "size", "taken", "epochs", "chosen").collect()
        by_size[n] = Counter(map(tuple, found))
        assert abs(sum(r["taken"] for r in found) - next(r["target"] for r in mixing.mix(frame(spark, data, n)).filter("source = 'a'").select("target").limit(1).collect())) < 100
    assert by_size[3] == by_size[5]
    drawn = Counter((size > 50, chosen) for (_, size, _, _, chosen), c in by_size[3].items() for _ in range(c))
    share = {long: drawn[(long, 1)] / (drawn[(long, 0)] + drawn[(long, 1)]) for long in (False, True)}
    assert 0 < drawn[(True, 1)] and 0 < drawn[(False, 0)] and abs(share[True] - share[False]) < 0.15
    equal = frame(spark, [(None, "the same text", "en", "a", 1, 1, "k", "s")] * 300 + [(i, "other words " * 9, "en", "b", 1, 1, "k", "s") for i in range(40)], 4)
    taken = [r["chosen"] for r in mixing.mix(equal).filter("source = 'a'").collect()]
    assert len(taken) == 300
