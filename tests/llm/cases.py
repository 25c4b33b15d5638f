"""Rows with nulls, empty and very long texts, ties, repeats and clashing extra columns."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, score string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(8)]
    texts = []
    for i in range(40):
        t = base[i % 8] if i % 3 == 0 else prose(rng, rng.randint(1, 200))
        if i % 5 == 0:
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        if i % 4 == 1:
            t = t + "\n" + base[0][:300] + "\n" + prose(rng, 10)
        texts.append(t)
    texts += [None, "", " \n\t ", "é" * 300, "a" * 1000, prose(rng, 30_000), "x y", "same line\nsame line\nsame line"]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i, "k", "s") for i, t in enumerate(texts)]
    return out


def odd_rows():
    """Also null ids, a repeated row and a repeated id with another text."""
    out = rows(2)
    return out + [(None, out[0][1], None, None, None, None, None, None), (None, None, "en", "s1", 1, 1, "k", "s"), out[3], (out[4][0], "another text of the same id", "en", "s1", 1, 1, "k", "s")]


def frame(spark, data, n=3):
    return spark.createDataFrame(data, DDL).repartition(n)
