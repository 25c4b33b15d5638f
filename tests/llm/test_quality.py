"""The attention classifier: features of passages counted in plain Python, and scores by the formula."""

import math
import random

import numpy as np

from textloom.llm import quality
from textloom.llm.repetition import Powers

CLASSES = [b" \t\r\v\f", b"\n", b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?", b"!", b"#*$%&|<>"]


def kind(byte):
    if byte >= 128:
        return 11 if byte >= 192 else 10
    return next((k for k, chars in enumerate(CLASSES) if byte in chars), 9)


def plain(text):
    """Features of each passage of a text."""
    data = text + b"\n"
    words, at = [], None
    for i, b in enumerate(data):
        if kind(b) > 1 and at is None:
            at = i
        elif kind(b) <= 1 and at is not None:
            words.append((at, i))
            at = None
    n = max(1, math.ceil(len(words) / quality.PASSAGE))
    pairs = [[0] * quality.KINDS**2 for _ in range(n)]
    of, nth = 0, 0
    for i in range(len(data) - 1):
        while nth < len(words) and words[nth][0] <= i:
            of, nth = nth // quality.PASSAGE, nth + 1
        pairs[of][kind(data[i]) * quality.KINDS + kind(data[i + 1])] += 1
    out = []
    for p in range(n):
        own = [data[a:b] for a, b in words[p * quality.PASSAGE:(p + 1) * quality.PASSAGE]]
        size, count = max(1, sum(pairs[p])), max(1, len(own))
        lengths = [len(w) for w in own]
        mean = sum(lengths) / count
        share = lambda test: sum(map(bool, test)) / count
        extra = [
            math.log1p(len(own)) / 5, mean / 10, math.sqrt(max(sum(x * x for x in lengths) / count - mean**2, 0)) / 5,
            share(w in own[:i] for i, w in enumerate(own)), share(i and w == own[i - 1] for i, w in enumerate(own)),
            share(any(kind(b) in (7, 8) for b in w) for w in own), share(all(kind(b) == 4 for b in w) for w in own),
            share(len(w) == 1 for w in own), share(len(w) > 20 for w in own), (math.log1p(len(words)) if words else 0) / 10]
        out.append([math.sqrt(c / size) for c in pairs[p]] + extra)
    return out


def made(rng, n):
    words = ["a", "the", "The", "NOISE", "w0rd!", "x" * 30, "é", "naïve", "#tag", "(so)", "12", "-", "\x01"]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\v "]) for _ in range(n)).encode()


def test_encode_against_plain_counts():
    rng = random.Random(2)
    texts = [b"", b" \n", b"one", b"\n\n lead", made(rng, 5), made(rng, 95), made(rng, 96), made(rng, 97), made(rng, 400), b"same same same " * 80, "Ünïcödé ".encode() * 120]
    x, owner = quality.encode(texts, Powers())
    want = [plain(t) for t in texts]
    assert owner.tolist() == [i for i, w in enumerate(want) for _ in w]
    assert np.allclose(x, np.array([p for w in want for p in w]), atol=1e-5)
    alone = np.concatenate([quality.encode([t], Powers())[0] for t in texts])
    assert np.allclose(alone, x, atol=1e-6)


def test_scores_by_the_formula():
    rng = np.random.default_rng(4)
    bags = [rng.normal(k % 2, 1, (1 + k % 4, quality.FEATURES)) for k in range(12)]
    model = quality.fit(bags, [k % 2 for k in range(12)])
    p = model.params
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    want = []
    for bag in bags:
        h = [np.tanh((row - model.mean) / model.scale @ p["W"] + p["b"]) for row in bag]
        weight = [math.exp(sum(u * math.tanh(t) * sigmoid(g) for u, t, g in zip(p["u"], v @ p["V"], v @ p["G"]))) for v in h]
        z = sum(w * v for w, v in zip(weight, h)) / sum(weight)
        want.append(sigmoid(float(z @ p["c"] + p["d"])))
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    assert np.allclose(model.scores(np.concatenate(bags), owner), want, atol=1e-9)
    assert all((s >= 0.5) == (k % 2) for k, s in enumerate(want))
