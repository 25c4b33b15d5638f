"""Toxicity: saved bytes and numbers of a text against plain compression, and what marks toxic rows."""

import math
import random

import numpy as np
import pytest
import zstandard

from textloom.llm import toxicity


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def made(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts, y = [], []
    for i in range(160):
        found = prose(rng, 80, words).split()
        toxic = i % 4 == 0
        for _ in range(6 if toxic else 0):
            found.insert(rng.randrange(len(found)), rng.choice(["vilex", "vilexor", "vilexing,", "grubbo"]))
        texts.append(" ".join(found).encode())
        y.append(int(toxic))
    return texts, y


def test_marking_stems():
    texts, y = made()
    copied = b"unique passage with words like zzzzq and qqqqz in it"
    stems = toxicity.marking_stems(texts + [copied] * 30, y + [1] * 30)
    assert {s for s, _ in stems} == {b"vilex", b"grubbo"}
    assert set(dict(stems)[b"vilex"]) == {b"vilex", b"vilexor", b"vilexing"}
    assert toxicity.marking_stems([], []) == [] == toxicity.marking_stems([b"a b c"], [1])


def test_saved_and_features_are_those_of_plain_compression():
    distance = toxicity._dictionaries(*made(), 7)
    assert all(len(t) % 3 == 0 for t in distance.toxic)

    def length(content, least, data):
        frame = zstandard.ZstdCompressionParameters(min_match=least, **toxicity._FRAME)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=frame).compress(data))

    rng = random.Random(4)
    text = (prose(rng, 100, ["abcd", "vilex", "Vilexor", "gab", "é", "grubbo", "h" * 50]) + "\n x").encode()
    cut = toxicity.windows(text)
    words = text.decode().split()
    assert len(cut) == math.ceil(len(words) / toxicity.WINDOW) and b"".join(cut).split() == [w.replace("V", "v").encode() for w in words]
    base = distance.ordinary + b"\0" * (-len(distance.ordinary) % 3)
    want = [[length(base + b"\0" * len(distance.toxic[k]), least, w) - length(base + distance.toxic[k], least, w) for w in cut] for k, least in toxicity.PAIRS]
    assert distance.saved(cut).tolist() == want and max(map(max, want)) > 2
    numbers = [math.log(1 + len(cut))]
    for d in want:
        counts = [sum(x >= k for x in d) for k in (1, 2, 3, 4)]
        numbers += [math.log((c + 0.18) / (len(cut) + 6)) for c in counts] + [sum(min(max(x, 0), 6) for x in d) / (len(cut) + 6)] + [min(c, 3) for c in counts[1:]]
    assert np.allclose(distance.features(text), numbers)
    assert distance.features(None).tolist() == distance.features(b" \n").tolist() == [0.0] * toxicity.NUMBERS


def test_ordinary_windows_cost_the_same():
    """Where nothing toxic matches, both compressions agree to the byte."""
    texts, y = made(2)
    distance = toxicity._dictionaries(texts, y, 7)
    plain = [w for t, kind in zip(texts, y) if not kind for w in toxicity.windows(t)]
    assert (distance.saved(plain) == 0).mean() > 0.97


def test_shift_puts_the_best_cut_at_the_threshold():
    z, y = np.array([-3.0, -2, -1, 0.5, 1, 4]), np.array([0, 0, 0, 1, 0, 1.0])
    shifted = z + toxicity._shift(z, y)
    score = 1 / (1 + np.exp(-shifted))
    f1 = lambda hit: 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + y.sum())
    assert f1(score >= toxicity.THRESHOLD) == max(f1(z >= c) for c in z)


@pytest.mark.parametrize("y", [[], [0, 0], [1, 1]])
def test_labels_of_one_kind(y):
    model = toxicity.fit([b"some text"] * len(y), y)
    assert abs(model.score(b"any text") - (sum(y) / len(y) if y else 0.5)) < 1e-9
