"""Operators over documents against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from textloom.llm import line_dedup, mixing, repetition, sharding, simhash, suffix_dedup, suffixes

from .cases import DDL, frame, odd_rows, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def empty(spark):
    return spark.createDataFrame([], DDL)


def base_counts(text):
    t = text or ""
    ws = WORD.findall(t)
    threes = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {k for i in range(len(ws) - 2) if threes[tuple(ws[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def coverage(text, n):
    ws = WORD.findall(text or "")
    seen, covered = set(), set()
    for i in range(len(ws) - n + 1):
        g = tuple(ws[i:i + n])
        if g in seen:
            covered.update(range(i, i + n))
        seen.add(g)
    return sum(len(ws[i]) for i in covered) / max(1, sum(map(len, ws)))


def test_repetition(spark):
    data = odd_rows() + [(100, "one two three four five " * 60, "en", "s", 1, 1, "k", "s"), (101, "\n".join(["a line of words that comes again and again"] * 9 + [f"w{i}" for i in range(60)]), "en", "s", 1, 1, "k", "s")]
    found = Counter((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in repetition.repetition(frame(spark, data)).collect())
    assert found == Counter((d[0], *base_counts(d[1])) for d in data)
    verdicts = {r["doc_id"]: r for r in repetition.repetition(frame(spark, rows())).collect()}
    for d in rows():
        r = verdicts[d[0]]
        over = max(coverage(d[1], n) - most for n, most in repetition.LIMITS.items())
        assert abs(r["max_excess"] - over) < 1e-9
        assert r["kept"] == (not base_counts(d[1])[5] and over <= 0 and r["dup_line_share"] <= repetition.LINE_LIMIT)
    assert repetition.repetition(empty(spark)).count() == 0


def test_repetition_of_equal_hashes():
    """Different spans whose rolling hashes agree modulo 2**64 (a Thue-Morse word and its complement), as lines and as words, and long equal lines."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    spaced, filler = " ".join(word) + " " + " ".join(other), " ".join(f"w{i}" for i in range(60))
    texts = [f"{word}\n{other}", f"{word} x y {other} x y {word} x y", f"{word}\n{other}\n{word}", spaced, f"{spaced}\n{filler}\n{spaced}", "z" * 9000 + "\n" + "z" * 9000 + "\n" + "z" * 9001, "", "x"]
    powers = repetition.Powers()
    spans = np.frombuffer((word + other).encode(), np.uint8)
    hashes = repetition.span_hashes(spans, np.array([0, 1024]), np.array([1024, 2048]), powers)
    assert hashes[0] == hashes[1]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for group in (texts, *[[t] for t in texts]):
        found = repetition.measure([t.encode() for t in group], powers)
        assert [tuple(found[c][i] for c in names) for i in range(len(group))] == [base_counts(t) for t in group]


def simhash_of(text):
    ws = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(prints, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    data = odd_rows()
    prints = [simhash_of(d[1]) for d in data]
    roots = linked(prints)
    least = {}
    for d, r in zip(data, roots):
        if d[0] is not None:
            least[r] = min(d[0], least.get(r, d[0]))
    want = Counter((d[0], p, least.get(r)) for d, p, r in zip(data, prints, roots))
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(frame(spark, data)).collect()) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(frame(spark, rows()))
    assert kept.columns == frame(spark, rows()).columns
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d, p, r in zip(rows(), [0] * 99, linked([simhash_of(d[1]) for d in rows()])) if rows()[r][0] == d[0]}


@pytest.mark.parametrize("most", [2, 2048])
def test_links(spark, monkeypatch, most):
    """Chains and dense balls; small limits send groups to the exact way for large ones."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 1 << 63}
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = defaultdict(list)
    # the executors import the module afresh, so the limit goes in with the function
    monkeypatch.setattr(simhash, "MOST", most)
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(simhash)
    try:
        for r in simhash.components(simhash.links(table)).collect():
            got[r["b"] & (1 << 64) - 1].append(r["a"] & (1 << 64) - 1)
    finally:
        pickle.unregister_pickle_by_value(simhash)
    groups = defaultdict(set)
    for p, r in zip(prints, linked(prints)):
        groups[r].add(p)
    assert sorted(map(sorted, ({k, *v} for k, v in got.items()))) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_skew_join(spark):
    """Hot keys go by broadcast and all others by a shuffle; every row keeps its partner, once."""
    from textloom.llm import common

    rows = spark.createDataFrame([(0, i) for i in range(3000)] + [(k, k) for k in range(1, 500)], "k long, v long")
    of = rows.groupBy("k").count().selectExpr("k", "k * 2 as twice", "count as n")
    got = common.skew_join(rows, of, "k", 3499)
    assert got.columns == ["k", "v", "twice"] and Counter(map(tuple, got.collect())) == Counter((r["k"], r["v"], 2 * r["k"]) for r in rows.collect())


@pytest.mark.parametrize("few", [50_000, 20])
def test_hot_fingerprint(spark, monkeypatch, few):
    """Thousands of empty texts and copies around one text: one component each, whichever way stars are joined."""
    monkeypatch.setattr("textloom.llm.components.FEW", few)
    near = [f"alpha beta gamma delta w{i}" for i in range(40)]
    data = [(i, "" if i % 2 else near[i % 40], *[None] * 6) for i in range(4000)]
    prints = {t: simhash_of(t) for t in {d[1] for d in data}}
    keys = sorted(prints, key=lambda t: min(d[0] for d in data if d[1] == t))
    root = dict(zip(keys, linked([prints[t] for t in keys])))
    least = {r: min(d[0] for d in data if root[d[1]] == r) for r in set(root.values())}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, data)).collect()}
    assert found == {d[0]: least[root[d[1]]] for d in data}


def test_close_pairs():
    rng = np.random.default_rng(2)
    group = np.sort(rng.integers(0, 20, 600))
    codes = (rng.integers(0, 1 << 5, 600) << 13 | rng.integers(0, 1 << 3, 600)).astype(np.uint32)
    rows_ = np.unique(np.stack([group, codes]), axis=1)
    group, codes = rows_[0].astype(np.int64), rows_[1].astype(np.uint32)
    order = np.lexsort((simhash.gray_rank(codes), group))
    group, codes = group[order], codes[order]
    found = {(int(a), int(b)) for i, j in simhash.close_pairs(group, codes) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if group[i] == group[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 2}
    assert found == want
    assert all(int(simhash.gray_rank(np.array([i ^ i >> 1], np.uint32))[0]) == i for i in range(100))


def brute_spans(data):
    """data: (key, bytes) in order."""
    seen, out = set(), []
    for _, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p:p + 100]
            if s in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split, most", [(500, 20_000), (1, 20_000), (500, 2)])
def test_suffix_dedup(spark, monkeypatch, split, most):
    """Small limits send groups of contexts to the cores, or to the comparison string by string."""
    import pyspark.cloudpickle as pickle

    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    pickle.register_pickle_by_value(suffix_dedup)  # the limits go to the workers with the functions
    try:
        check_suffix_dedup(spark)
    finally:
        pickle.unregister_pickle_by_value(suffix_dedup)


def check_suffix_dedup(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcde ") for _ in range(400))
    data = rows() + [(200 + i, prose + passage[k:k + rng.randint(95, 260)] + prose[::-1], "en", "s", 1, 1, "k", "s") for i, (k, prose) in enumerate((rng.randint(0, 150), "".join(rng.choice("xyz ") for _ in range(40))) for _ in range(25))]
    data.append((300, passage * 3, "en", "s", 1, 1, "k", "s"))
    data.sort(key=lambda d: d[0])
    want = brute_spans([(d[0], (d[1] or "").encode()) for d in data])
    found = suffix_dedup.deduplicate(frame(spark, data), with_text=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, r["kept_sha256"]) for r in found}
    assert [got[d[0]] for d in data] == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0


def test_suffix_dedup_odd_ids(spark):
    data = odd_rows()
    found = suffix_dedup.deduplicate(frame(spark, data)).collect()
    assert len(found) == len(data) and sum(r["doc_id"] is None for r in found) == 2
    twice = [r for r in found if r["doc_id"] == data[3][0]]
    assert sorted(r["n_removed"] == r["n_bytes"] for r in twice)[-1]


@pytest.mark.parametrize("seed", range(4))
def test_previous_factors(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + 2 + seed % 2, 300).astype(np.uint8)
    at = np.sort(rng.choice(300, 200, replace=False))
    time = rng.permutation(200)
    got = suffixes.previous_factors(data, at, time, 20)
    b = data.tobytes()
    for i in range(200):
        best = 0
        for j in range(200):
            if time[j] < time[i]:
                k = 0
                while k < 20 and at[i] + k < 300 and at[j] + k < 300 and b[at[i] + k] == b[at[j] + k]:
                    k += 1
                best = max(best, k)
        assert got[i] == best


def similar_lines(data):
    lines, gone = [], defaultdict(lambda: [0, 0, 0])
    for d in sorted((d for d in data), key=lambda d: d[0]):
        for pos, line in enumerate((d[1] or "").split("\n")):
            if WORD.search(line):
                lines.append((d[0], pos, line, frozenset(WORD.findall(line))))
    seen, earlier = set(), []
    for doc, _, line, words in lines:
        gone[doc][0] += 1
        if line in seen:
            gone[doc][1] += 1
        elif any(9 * len(words & w) >= 4 * (len(words) + len(w)) for w in earlier):
            gone[doc][2] += 1
        seen.add(line)
        earlier.append(words)
    return {d[0]: tuple(gone[d[0]]) for d in data}


def test_rarity_and_word_keys(spark):
    data = odd_rows()
    docs = frame(spark, data)
    classes = line_dedup.rarity(docs)
    buckets = line_dedup.BUCKETS

    def hashed(word):
        return xxhash.xxh64(word.encode(), seed=42).intdigest()

    counts = Counter(hashed(w) & (buckets - 1) for r in data for w in WORD.findall(r[1] or ""))
    want = [min(int(np.log1p(counts[b]) / np.log(1.125)), 255) - 128 for b in range(buckets)]
    assert spark.range(1).select(classes.alias("c")).first()["c"] == want

    lines = ["b a  b\ta ", "", "same same", "\x0b", " ".join(f"w{i % 40}" for i in range(100))]
    frame_ = spark.createDataFrame([(line,) for line in lines], "line string")
    found = {r["line"]: r["k"] for r in frame_.select("line", line_dedup.word_keys(frame_["line"], classes).alias("k")).collect()}
    for line in lines:
        keys = [(want[hashed(w) & (buckets - 1)] << 56) | (hashed(w) >> 8) for w in set(WORD.findall(line))]
        assert found[line] == sorted(keys)


def test_line_keys_and_parities(spark, capsys):
    """Each step on words has an expression of its own, compiled but for the lambdas; the middle key halves the words even if all are as frequent."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = [" ".join(rng.sample(vocabulary, rng.randint(1, 90)) + ["w7"] * rng.randint(1, 2)) for _ in range(60)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)] + [(99, "w5\n \n\tw5  ")], "doc_id long, text string")
    classes = line_dedup.rarity(docs)
    middle = line_dedup.middle_key(spark, classes)
    keyed = line_dedup.line_keys(line_dedup.lines_of(docs), classes, middle)
    assert not keyed.schema["keys"].dataType.containsNull  # sorted as primitive longs
    plain = line_dedup.lines_of(docs).select("doc", "pos", line_dedup.word_keys(line_dedup.F.col("line"), classes).alias("k"))
    want = {(r["doc"], r["pos"]): r["k"] for r in plain.collect()}
    found = {(r["doc"], r["pos"]): r for r in keyed.collect()}
    assert {at: (len(k), sorted([*k, middle])) for at, k in want.items()} == {at: (r["n"], r["keys"]) for at, r in found.items()}
    words = [k for ks in want.values() for k in ks]
    assert 0.3 < sum(k < middle for k in words) / len(words) < 0.7

    hot = spark.createDataFrame([], "_h long, _h2 long, least struct<doc: long, pos: int>")
    postings = line_dedup.postings_of(docs, hot)
    postings.explain()
    plan = capsys.readouterr().out
    assert "array_except" in plan and "transform(array_except" not in plan and "transform(CASE" not in plan
    rows = {}
    for r in postings.collect():
        rows.setdefault((r["doc"], r["pos"]), []).append(r)
    rarest = {at: sorted(k)[: len(k) - -(-4 * len(k) // 5) + 1] for at, k in want.items()}
    assert {at: sorted(r["key"] for r in rs) for at, rs in rows.items()} == rarest
    for a, b in itertools.combinations(sorted(rows), 2):
        differ = len(set(want[a]) ^ set(want[b]))
        both = len(want[a]) > line_dedup.LONG < len(want[b])
        bits = [(rows[a][0][s] ^ rows[b][0][s]) & (2**64 - 1) for s in line_dedup.SIGS[: 1 + both]]
        assert sum(x.bit_count() for x in bits) <= differ


def test_rarity_stays_out_of_plans(spark, capsys):
    """The driver describes a plan anew after each stage, so the classes of all buckets must not be spelled out in it, and no row may hold them."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 30))) for _ in range(5))) for i in range(40)], "doc_id long, text string")
    postings = line_dedup.postings_of(docs, spark.createDataFrame([], "_h long, _h2 long, least struct<doc: long, pos: int>"))
    postings.explain("formatted")
    plan = capsys.readouterr().out
    assert len(plan) < 50_000
    assert plan.count("AS classes#") == 1 and plan.index("AS classes#") > plan.index("Subqueries")

    literal, row = line_dedup.rarity(docs), line_dedup.rarity_row(docs).scalar()
    middle = line_dedup.middle_key(spark, row)
    assert middle == line_dedup.middle_key(spark, literal)
    by_row, by_literal = (line_dedup.line_keys(line_dedup.lines_of(docs), c, middle) for c in (row, literal))
    assert not by_row.schema["keys"].dataType.containsNull
    assert sorted(by_row.collect()) == sorted(by_literal.collect())


def test_words_are_split_without_a_pattern(spark, capsys):
    lines = ["a\tb", "a\x0bb", "a\x0cb", "a\rb", "a  b ", "\x01 a", "\x1f", " \t\x0b", "\té", " b", "", "!"]
    frame_ = spark.createDataFrame([(line,) for line in lines], "line string")
    split = frame_.select("line", line_dedup.words_of(frame_["line"]).alias("w"))
    assert all([w for w in r["w"] if w] == WORD.findall(r["line"]) for r in split.collect())
    split.explain(True)
    assert "RLIKE" not in capsys.readouterr().out  # a pattern is searched far slower than bytes
    texts = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert sorted(r["pos"] for r in line_dedup.lines_of(texts).collect()) == [i for i, line in enumerate(lines) if WORD.search(line)]


def test_line_dedup(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    data = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(1, 6)):
            ws = rng.sample(vocabulary, rng.randint(1, 14)) if rng.random() < 0.5 else vocabulary[: rng.randint(8, 12)]
            if rng.random() < 0.5:
                rng.shuffle(ws)
            lines.append("  ".join(ws) if rng.random() < 0.2 else " ".join(ws))
        data.append((i, "\n".join(lines), "en", "s", 1, 1, "k", "s"))
    data += [(50, None, "en", "s", 1, 1, "k", "s"), (51, "", "en", "s", 1, 1, "k", "s"), (52, " \n\t", "en", "s", 1, 1, "k", "s")]
    want = similar_lines(data)
    assert {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_similar"]) for r in line_dedup.line_counts(frame(spark, data)).collect()} == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, data)).collect()}
    assert all(len([x for x in (kept[d] or "").split("\n") if WORD.search(x)]) == n - e - s for d, (n, e, s) in want.items())
    assert line_dedup.line_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [500, 1])
def test_line_dedup_odd_rows(spark, monkeypatch, limit):
    """Null and repeated ids, repeated rows, long texts and odd blanks; a small limit sends lists through their first lines."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "LONG_LIST", limit)
    some = " ".join(f"v{i}" for i in range(90))
    data = odd_rows() + [(900, some.replace(" ", "\t"), *[None] * 6), (901, some.replace("v3 ", "x "), *[None] * 6), (901, some + "\r\n\x0b\n" + some, *[None] * 6), (None, some + " end", *[None] * 6)]
    docs = frame(spark, data)
    hashes = [r[0] for r in spark.createDataFrame([(i, d[1]) for i, d in enumerate(data)], "i long, t string").orderBy("i").select(F.xxhash64("t")).collect()]
    ordered = sorted(zip(data, hashes), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    counts = similar_lines([(i, d[1]) for i, (d, _) in enumerate(ordered)])
    want = Counter((d[0], *counts[i]) for i, (d, _) in enumerate(ordered))
    assert Counter(tuple(r) for r in line_dedup.line_counts(docs).collect()) == want
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    left = Counter((r["doc_id"], len([x for x in (r["text"] or "").split("\n") if WORD.search(x)])) for r in kept.collect())
    assert left == Counter((d[0], counts[i][0] - counts[i][1] - counts[i][2]) for i, (d, _) in enumerate(ordered))


def least_moved(supply, capacity):
    return sum(max(0, s - c) for s, c in zip(supply, capacity + [0] * len(supply)))


def test_min_cost_flow():
    rng = random.Random(1)
    for _ in range(30):
        supply = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        m = rng.randint(1, 8)
        capacity = sharding.even_capacities(sum(supply) + rng.randint(0, 9), m)
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= capacity[j] for j in range(m))
        assert sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j) == least_moved(supply, capacity)


def test_reshard(spark, tmp_path):
    data = odd_rows()
    docs = frame(spark, data)
    plan = sharding.reshard(docs, sharding.old_layout(), 16, 5)
    found = plan.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in data)
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    total, big = sum(r["size"] for r in found), max(r["size"] for r in found)
    assert all(abs(sum(r["size"] for r in rs) - total / 5) <= big for rs in by.values())
    sharding.rewrite(plan, docs, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    affected = {r[0] for r in sharding.affected(plan).collect()}
    assert {r[0] for r in written.select("shard").distinct().collect()} == affected & set(by)
    assert written.count() == sum(len(by[s]) for s in affected if s in by)
    assert sharding.reshard(empty(spark), sharding.old_layout(), 16, 5).count() == 0


def test_mix(spark):
    data = odd_rows()
    docs = frame(spark, data)
    found = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d[0], len(WORD.findall(d[1] or ""))) for d in data)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["text_hash"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    taken, goal, biggest = Counter(), {}, Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= biggest[s] / 2 + 1 for s in goal)
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in copies.collect()) == sum(taken.values())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0


def test_targets():
    t = mixing.targets({"a": 100, "b": 1, "c": 50, None: 10})
    assert abs(sum(t.values()) - 161) < 1e-9 and t["b"] == 3.0
    # weights 1, 2, 3, 1: what b can't take is shared by weight
    assert abs(t["a"] - t[None]) < 1e-9 or t[None] == 30.0
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_exponential_keys_prefer_weight(spark):
    from pyspark.sql import functions as F

    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    first = ids.orderBy(mixing.exponential_key(F.col("doc_id"), F.col("w"))).limit(400).collect()
    heavy = sum(r["w"] == 3.0 for r in first) / 400
    assert 0.68 < heavy < 0.82
