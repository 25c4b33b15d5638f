"""Trained operators by held-out accuracy, decontamination and revisits by brute force, the pipeline by its stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import decontaminate, labelled, quality, toxicity, warc

from .cases import DDL, frame, odd_rows, prose


def corpus(n=500, seed=3):
    """Half junk; a tenth has insults."""
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 260)).split()
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            words = [w + rng.choice(["###", "%%%", "&&&"]) for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkwad", "blimfart", "gruntsnot"]))
        out.append((i, " ".join(words), "en", f"s{i % 4}", 1, 1, "k", "s"))
        labels.append((i, int(not bad), int(toxic)))
    return out, labels


def test_held_out(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


@pytest.mark.parametrize("module, column", [(quality, 1), (toxicity, 2)])
def test_held_out_accuracy(spark, module, column):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.train(frame(spark, docs), table)
    found = {r["doc_id"]: r for r in module.score(frame(spark, docs), model).collect()}
    held = [(found[lab[0]]["predicted"], lab[column]) for lab in labels if found[lab[0]]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.9
    odd = module.score(frame(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert module.score(spark.createDataFrame([], DDL), model).count() == 0
    unlabelled = module.train(frame(spark, docs), table.filter("doc_id < 0"))
    assert {round(r["score"], 6) for r in module.score(frame(spark, docs[:5]), unlabelled).collect()} == {0.5}


def test_attention_gradients():
    """One step of training lowers the loss on what it saw."""
    rng = np.random.default_rng(0)
    bags = [rng.normal(i % 2, 1, (rng.integers(1, 6), quality.FEATURES)).astype(np.float32) for i in range(200)]
    y = [i % 2 for i in range(200)]
    model = quality.fit(bags, y)
    scores = np.array([model.scores(b, np.zeros(len(b), int))[0] for b in bags])
    assert ((scores > 0.5) == np.array(y)).mean() > 0.95


def test_quality_keep(spark):
    docs, labels = corpus(300)
    model = quality.train(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = quality.keep(frame(spark, docs), model)
    scored = {r["doc_id"] for r in quality.score(frame(spark, docs), model).filter("predicted = 1").collect()}
    assert kept.columns == frame(spark, docs).columns and {r["doc_id"] for r in kept.collect()} == scored


def items_of(spark, rng, n=30):
    return [(i, prose(rng, rng.randint(3, 90)).capitalize() + ". " + prose(rng, rng.randint(1, 8)) + ".") for i in range(n)]


def test_decontaminate(spark):
    rng = random.Random(8)
    items = items_of(spark, rng) + [(90, None), (91, ""), (None, "no id but words enough to be found here")]
    docs, want = [], set()
    for i in range(60):
        words = prose(rng, rng.randint(0, 400)).split()
        if i % 3 == 0:
            k = rng.randrange(30)
            at = rng.randint(0, len(words))
            words[at:at] = items[k][1].upper().split() if i % 2 else items[k][1].split()
            want.add((i, k))
        docs.append((i, " ".join(words), "en", "s", 1, 1, "k", "s"))
    docs += [(100, None, "en", "s", 1, 1, "k", "s"), (101, "", "en", "s", 1, 1, "k", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, docs), decontaminate.benchmark_items(bench))
    assert want <= {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert {r["doc_id"] for r in found.collect()} == {d for d, _ in want}
    clean = decontaminate.clean(frame(spark, docs), decontaminate.benchmark_items(bench))
    assert {r["doc_id"] for r in clean.collect()} == {d[0] for d in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(frame(spark, docs), decontaminate.benchmark_items(bench.limit(0))).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([], DDL), decontaminate.benchmark_items(bench)).count() == 0


def brute_matches(text, items, n_chunks, average, df):
    """Every passage against every chunk, then each found item verified around its passages."""
    ws, out = decontaminate.words(text), []
    last = max(0, -(-len(ws) // 64) - 2)
    for item, q, a in items:
        q, a = decontaminate.words(q), decontaminate.words(a)
        whole, starts, best = q + a, [], 0.0
        for s in range(0, 64 * last + 1, 64):
            passage = set(ws[s:s + 128])
            for c in range(0, len(whole), 64):
                tf = Counter(whole[c:c + 64])
                size = sum(tf.values())
                part = {w: np.log(1 + (n_chunks - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / average)) for w, f in tf.items()}
                score = sum(v for w, v in part.items() if w in passage) / sum(part.values())
                if score >= 0.6 - 1e-9:
                    starts.append(s)
                    best = max(best, score)
        places = []
        for s in sorted(set(starts)):
            if places and s - len(whole) <= places[-1][1]:
                places[-1][1] = s + 128 + len(whole)
            else:
                places.append([max(0, s - len(whole)), s + 128 + len(whole)])
        for i, j in places:
            near = ws[i:j]
            n = min(5, len(q))
            grams = {tuple(q[k:k + n]) for k in range(len(q) - n + 1)} if q else set()
            there = {tuple(near[k:k + n]) for k in range(len(near) - n + 1)}
            if (not q or len(grams & there) >= 0.8 * len(grams)) and (not a or len(set(a) & set(near)) >= 0.8 * len(set(a))):
                out.append((item, round(best, 9), len(set(starts)), min(starts)))
                break
    return out


def test_contaminated_is_exhaustive(spark, monkeypatch):
    """The whole result against brute force: parts of items, answers far from their questions, null and repeated ids, long texts, several indexes."""
    rng = random.Random(12)
    texts = [(i % 17 if i else None, prose(rng, rng.randint(2, 150)).capitalize() + ". " + prose(rng, rng.randint(1, 8)) + ".") for i in range(25)]
    docs = odd_rows()
    for i in range(70):
        words = prose(rng, rng.randint(0, 300)).split()
        q, a = decontaminate.split_item(texts[rng.randrange(25)][1])
        at = rng.randint(0, len(words))
        if i % 4 == 0:
            words[at:at] = (q + " " + a).split()
        elif i % 4 == 1:
            words = q.split() + words * 2 + prose(rng, 700).split() + a.split()  # the answer isn't where the question is
        elif i % 4 == 2:
            words[at:at] = q.split()[: rng.randint(1, 150)]
        docs.append((1000 + i // 2, " ".join(words), "en", "s", 1, 1, "k", "s"))
    docs.append((3000, prose(rng, 20_000) + " " + texts[3][1] + " " + prose(rng, 9_000), "en", "s", 1, 1, "k", "s"))
    docs += [(3001, texts[0][1], "en", "s", 1, 1, "k", "s"), (None, texts[0][1], None, None, None, None, None, None)]
    split = [(i, *decontaminate.split_item(t)) for i, t in texts]
    tokens = [decontaminate.words(q) + decontaminate.words(a) for _, q, a in split]
    chunks = [t[s:s + 64] for t in tokens for s in range(0, len(t), 64)]
    df = Counter(w for c in chunks for w in set(c))
    want = Counter((d[0], *m) for d in docs for m in brute_matches(d[1], split, len(chunks), sum(map(len, tokens)) / len(chunks), df))
    bench = decontaminate.benchmark_items(spark.createDataFrame(texts, "item_id long, text string"))
    whole = decontaminate.indexes
    for limit in (decontaminate.INDEX_BYTES, 2000):
        monkeypatch.setattr(decontaminate, "indexes", lambda items, limit=limit: whole(items, limit))
        found = decontaminate.contaminated(frame(spark, docs), bench).collect()
        assert Counter((r["doc_id"], r["item_id"], round(r["score"], 9), r["n_passages"], r["first_word"]) for r in found) == want
        assert decontaminate.clean(frame(spark, docs), bench).count() == sum(not brute_matches(d[1], split, len(chunks), sum(map(len, tokens)) / len(chunks), df) for d in docs)
    assert any(k[1] is None for k in want) and len(want) > 15


def test_search_is_exhaustive():
    """Pruned retrieval finds what scoring every passage against every chunk finds."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 150))), " ".join(rng.choices(vocabulary, k=3))) for i in range(60)]
    tokens = [decontaminate.words(q) + decontaminate.words(a) for _, q, a in items]
    chunks = [t[s:s + 64] for t in tokens for s in range(0, len(t), 64)]
    df = Counter(w for c in chunks for w in set(c))
    index = decontaminate.Index(items, len(chunks), sum(map(len, tokens)) / len(chunks), df)
    for least in (0.2, 0.5, 0.8):
        texts = [decontaminate.words(" ".join(rng.choices(vocabulary, k=rng.randint(1, 500)))) for _ in range(20)] + [tokens[5], []]
        for run in (1, 2, 3):  # in overlapping runs of chunks, whatever their length
            assert index.retrieve(texts, least, run) == index.retrieve(texts, least)
        for ws, got in zip(texts, index.retrieve(texts, least)):
            want = {}
            for s in range(0, max(1, len(ws) - 64), 64):
                have = {index.ids[w] for w in ws[s:s + 128] if w in index.ids}
                scores = Counter()
                for t in have:
                    for c, v in zip(index.docs[t], index.impacts[t]):
                        scores[c] += v
                for c, v in scores.items():
                    if v >= least - 1e-9:
                        want[index.of[c]] = max(v, want.get(index.of[c], 0))
            assert set(got) == set(want) and all(abs(got[k][0] - want[k]) < 1e-9 for k in want)


def brute_resolve(records):
    out = []
    for r in records:
        if r[1] != "revisit":
            continue
        best = None
        for s in records:
            if s[1] == "response" and r[5] is not None and s[5] == r[5] and s[3] is not None and r[3] is not None and s[3] < r[3]:
                if best is None or (s[3], s[0]) > (best[3], best[0]):
                    best = s
        mine = r[4] or {}
        if best is None:
            out.append((r[0], None, "unresolved", tuple(sorted(mine.items()))))
            continue
        theirs = best[4] or {}
        tag = lambda h: h["etag"].removeprefix("W/") if h.get("etag") else None
        agree = None
        if tag(mine) is not None and tag(theirs) is not None:
            agree = tag(mine) == tag(theirs)
        elif mine.get("last-modified") is not None and theirs.get("last-modified") is not None:
            agree = mine["last-modified"] == theirs["last-modified"]
        if agree is False:
            out.append((r[0], None, "mismatch", tuple(sorted(mine.items()))))
        else:
            merged = {**theirs, **{k: v for k, v in mine.items() if k in warc.UPDATED}}
            out.append((r[0], best[0], "resolved" if agree else "unchecked", tuple(sorted(merged.items()))))
    return Counter(out)


def test_resolve(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    urls = ["http://www.a.com/x/", "https://A.com/x#top", "a.com:80/x?utm_source=f", "http://b.org/y?b=2&a=1", "http://b.org/y?a=1&b=2", None, "http://hot.com/"]
    canonical = ["a.com/x", "a.com/x", "a.com/x", "b.org/y?a=1&b=2", "b.org/y?a=1&b=2", None, "hot.com"]
    rows = []
    for i in range(300):
        u = rng.choice([6, 6, 6, *range(7)])
        headers = None if rng.random() < 0.1 else {k: rng.choice("ab") for k in ("etag", "last-modified", "content-length", "date") if rng.random() < 0.6}
        if headers and "etag" in headers and rng.random() < 0.3:
            headers["etag"] = "W/" + headers["etag"]
        rows.append((i, rng.choice(["response", "revisit"]), urls[u], None if rng.random() < 0.05 else rng.randint(0, 60), headers, canonical[u]))
    records = spark.createDataFrame([r[:5] for r in rows], "record_id long, kind string, url string, time long, headers map<string,string>").withColumn("part", F.lit(1)).repartition(5)
    found = warc.resolve(records)
    assert Counter((r["record_id"], r["target_id"], r["status"], tuple(sorted(r["headers"].items()))) for r in found.collect()) == brute_resolve(rows)
    assert warc.resolve(records.limit(0)).count() == 0
    bodies = records.select("record_id", F.lit("body").alias("body"))
    joined = warc.with_bodies(found, bodies)
    assert joined.count() == found.count() and joined.filter("(body is null) <> (target_id is null)").count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on its own input against what its operator says."""
    import corpus_pipeline
    from textloom.llm import mixing, simhash
    from pyspark.sql import functions as F

    docs, labels = corpus(240)
    docs += [(1000 + i, docs[i][1], "en", "s1", 1, 1, "k", "s") for i in range(60)]
    rng = random.Random(1)
    items = items_of(spark, rng, 5)
    docs += [(2000 + i, prose(rng, 80) + " " + items[i][1] + " " + prose(rng, 80), "en", "s2", 1, 1, "k", "s") for i in range(5)]
    for name, rows, ddl in (("documents", [d[:5] for d in docs], "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    sf, columns = str(tmp_path), ["doc_id", "text", "lang", "source", "n_chars"]
    now, ids = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        if i < 4:
            assert now.columns == columns, name
            now.write.parquet(str(tmp_path / f"stage{i}"))
            now = spark.read.parquet(str(tmp_path / f"stage{i}"))
            ids.append([r["doc_id"] for r in now.collect()])
    good = {d[0] for d, lab in zip(docs, labels) if lab[1]}
    assert len(good - set(ids[0])) <= 3 and len(set(ids[0]) & {lab[0] for lab in labels if not lab[1]}) <= 3
    assert not [i for i in ids[1] if 1000 <= i < 2000 and i - 1000 in ids[0]]
    assert set(ids[1]) - set(ids[2]) == {2000 + i for i in range(5)} & set(ids[1])
    takes = {r["doc_id"]: r["epochs"] + r["chosen"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "stage2"))).collect()}
    assert Counter(ids[3]) == Counter({d: n for d, n in takes.items() if n})
    last = now.collect()
    assert Counter(r["doc_id"] for r in last) == Counter(ids[3]) and {r["shard"] for r in last} <= set(range(24))
    whole = corpus_pipeline.run(spark, sf)
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in whole.collect()) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in last)


def test_resolve_odd_records(spark):
    """Repeated rows, equal and null record ids, header names in capitals."""
    ddl = "record_id long, kind string, url string, time long, headers map<string,string>, tie string, latest int, part int"
    more = (None, None, None)
    rows = [
        (1, "response", "http://a.com/", 1, {"ETag": "x", "Content-Length": "9"}, *more), (1, "response", "http://a.com/", 1, {"ETag": "x", "Content-Length": "9"}, *more),
        (2, "revisit", "http://a.com", 2, {"ETAG": "W/x", "Date": "now"}, *more), (2, "revisit", "http://a.com", 2, {"ETAG": "W/x", "Date": "now"}, *more),
        (None, "revisit", "http://a.com", 3, {"etag": "y"}, *more), (None, "response", "http://b.com", 1, {"Etag": "n"}, *more), (5, "response", "http://b.com", 1, {"Etag": "five"}, *more),
        (6, "revisit", "http://b.com", 2, {"etag": "five"}, *more), (None, "response", "http://c.com", 1, None, *more), (7, "revisit", "http://c.com", 2, {"Vary": "a", "vary": "b"}, *more),
        (8, "other", "http://c.com", 2, None, *more), (8, None, None, None, None, *more),
    ]
    for n in (1, 4):
        found = warc.resolve(spark.createDataFrame(rows, ddl).repartition(n)).collect()
        got = Counter((r["record_id"], r["target_id"], r["status"], tuple(sorted(r["headers"].items()))) for r in found)
        assert got == Counter({
            (2, 1, "resolved", (("content-length", "9"), ("date", "now"), ("etag", "W/x"))): 2, (None, None, "mismatch", (("etag", "y"),)): 1,
            (6, 5, "resolved", (("etag", "five"),)): 1, (7, None, "unchecked", (("vary", "b"),)): 1})
    twins = [(1, "response", "u.com", 1, {"etag": e}, *more) for e in "pqrs"] + [(2, "revisit", "u.com", 2, {"date": "d"}, *more)]
    seen = {tuple(sorted(warc.resolve(spark.createDataFrame(twins, ddl).repartition(n)).first()["headers"].items())) for n in (1, 2, 3, 5)}
    assert len(seen) == 1
