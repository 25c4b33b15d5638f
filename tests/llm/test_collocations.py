"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from textloom.llm import collocations

from .cases import DDL, frame, odd_rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data, least, longest=5, best=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:j]: max for p in frequent for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p] >= f[p[i:j]]}
        rows = []
        for p, a in frequent.items():
            if p not in covered:
                s, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "É", "x-y", "z", "q\x00r", "　", "w"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!?", "\r\n", "; ", "\x0b"]
    made = ["".join(rng.choice(words[: 3 + i % 8]) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for i in range(n)]
    return [(i, t, rng.choice(["en", "en", "de", None, ""]), "s", 1, 1, "k", "s") for i, t in enumerate(made)]


def test_against_brute_force(spark):
    data = texts(1, 150) + odd_rows()
    data += [(900, "alpha beta gamma " * 3000, "en", "s", 1, 1, "k", "s"), (901, ("alpha beta. " * 900) + "no end " * 900, "de", "s", 1, 1, "k", "s"), (902, "und und und und", None, "s", 1, 1, "k", "s")]
    want = {least: brute(data, least) for least in (4, 30)}
    assert len(want[4]) > 200 and len(want[30]) > 3
    for block, bits in ((8 << 20, 1 << 23), (3000, 64)):
        least = 4 if block == 3000 else 30
        assert sorted(map(tuple, collocations.collocations(frame(spark, data, 3), least, block=block, bits=bits).collect())) == want[least]


def test_best_and_shorter_phrases(spark):
    data = texts(2, 100)
    found = sorted(map(tuple, collocations.collocations(frame(spark, data), 4, 3, 5).collect()))
    assert found == brute(data, 4, 3, 5)


def test_many_languages_in_a_task(spark):
    data = [(i, "a b c. a b", f"l{i % 60}", "s", 1, 1, "k", "s") for i in range(600)]
    assert sorted(map(tuple, collocations.collocations(frame(spark, data, 1), 5, block=100).collect())) == brute(data, 5)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DDL)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "s", 1, 1, "k", "s"), (2, " .,\n", "en", "s", 1, 1, "k", "s")], DDL), 1).count() == 0


def test_varints_and_lists():
    rng = np.random.default_rng(1)
    values = np.r_[0, 1, 127, 128, 16383, 16384, 2**31, 2**34, rng.integers(0, 2**30, 500)]
    assert (collocations.from_varints(collocations.varints(values)) == values).all()
    assert len(collocations.from_varints(b"")) == 0
    lists = [np.unique(rng.integers(0, 10_000, rng.integers(1, 60))) for _ in range(40)]
    lengths = np.array([len(x) for x in lists])
    packed = collocations._binary(lengths, np.concatenate(lists)).to_pylist()
    found = collocations._ungapped(lengths, collocations.from_varints(b"".join(packed)))
    assert (found == np.concatenate(lists)).all()


def test_inverted_lists():
    words, lengths, positions = collocations.inverted(b"a b a.b  a\tc..")
    lists = dict(zip(words.to_pylist(), np.split(positions, np.cumsum(lengths)[:-1])))
    assert {w: p.tolist() for w, p in lists.items()} == {"a": [1, 3, 6], "b": [2, 5], "c": [7]}
