"""Toxicity by compression distance: windows compressed with toxic and ordinary zstandard dictionaries.

All dictionaries are made from labelled rows.  The ordinary one is trained on windows of ordinary rows.  There are two toxic ones: the word beginnings
that mark toxic rows, and these with the words in which they stand most.  A beginning marks toxic rows if it has many different neighbours there and few in
ordinary rows (so copies of a document count once), whatever the language.  A window is compressed with the ordinary dictionary followed by a toxic one, and with the ordinary one
followed by as many zero bytes, so that distances and table entries are the same in both and only toxic matches make a difference.  Entries begin at every third byte, where the
compressor's table of a dictionary has its entries, and literals stay as they are, so lengths aren't blurred by their coding.
Each text is cut into windows of ``WINDOW`` words; the saved bytes of all its windows under each of ``PAIRS`` give a few numbers that a calibrated logistic threshold turns into a score.

Defined results: a null or empty text has no saved bytes and so a low score; a
null doc_id and repeated rows are ordinary rows; with labels of one kind or none, every score is
that kind's share (0.5 without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, pieces, small_batches, table
from .labelled import held_out, labelled_sample, logistic

#: Most labelled documents, and bytes of their texts, that a model learns from.
TRAIN_DOCS = 6000
TRAIN_BYTES = 24 << 20
WINDOW = 16
THRESHOLD = 0.7
ORDINARY_BYTES = 7500
#: Most windows of ordinary rows, in shuffled order, that their dictionary is trained on.
ORDINARY_WINDOWS = 20_000
#: Words of each beginning in the two toxic dictionaries.
WORDS = (0, 16)
#: Toxic dictionary and least length of a match, for each distance.
PAIRS = ((0, 5), (0, 7), (1, 7))
#: Numbers that describe a text.
NUMBERS = 1 + 8 * len(PAIRS)
_EDGES = b".,!?;:\"()'"
_FRAME = {  # with this strategy and target length, literals aren't compressed
    "strategy": zstandard.STRATEGY_FAST, "target_length": 1, "window_log": 14, "hash_log": 16, "chain_log": 16,
    "search_log": 8, "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}


def windows(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(LOWER_ASCII).split()
    return [b" " + b" ".join(words[i:i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in range(4, min(len(word), 12) + 1)]


def _words(text: bytes) -> list[bytes]:
    return [w.strip(_EDGES) for w in text.translate(LOWER_ASCII).split()]


def marking_stems(texts: list[bytes], y: list[int], odds: float = 2.3, gain: float = 30.0) -> list[tuple[bytes, list[bytes]]]:
    """Word beginnings that mark toxic documents, each with its words there, the most frequent first.

    A beginning counts once for each different pair of neighbours.  The one whose count exceeds most what ordinary documents let expect (as a log-likelihood, ``gain`` at least and by a
    factor of e^``odds``) is taken, its words are taken out, and so on.
    """
    raw, tokens = (Counter(), Counter()), [0, 0]
    for t, kind in zip(texts, y):
        found = _words(t)
        raw[kind].update(found)
        tokens[kind] += len(found)
    share = tokens[1] / max(1, tokens[0])

    def stems_of(words: Counter) -> Counter:
        out: Counter = Counter()
        for w, c in words.items():
            for s in _beginnings(w):
                out[s] += c
        return out

    seen = stems_of(raw[1])
    likely = {s for s, c in seen.items() if c >= 5}
    plain: Counter = Counter()
    for w, c in raw[0].items():
        for s in _beginnings(w):
            if s in likely:
                plain[s] += c
    likely = {s for s in likely if math.log(seen[s] / (share * (plain[s] + 0.5))) >= odds - 0.7}
    uses: list[dict[bytes, set]] = [{}, {}]
    for t, kind in zip(texts, y):
        found = [b"", *_words(t), b""]
        for i in range(1, len(found) - 1):
            w = found[i]
            if w[:4] and any(s in likely for s in _beginnings(w)):
                uses[kind].setdefault(w, set()).add((found[i - 1], found[i + 1]))
    counts = [{w: len(c) for w, c in u.items()} for u in uses]
    stems = [stems_of(Counter(c)) for c in counts]

    def value(s: bytes) -> float:
        a, e = stems[1][s], share * (stems[0][s] + 0.5)
        return a * math.log(a / e) - (a - e) if a >= 5 and math.log(a / e) >= odds else 0.0

    chosen = []
    while True:
        best = max(likely, key=lambda s: (value(s), len(s), s), default=None)
        if best is None or value(best) < gain:
            return chosen
        own = [w for w in counts[1] if w.startswith(best)]
        chosen.append((best, sorted(own, key=lambda w: (-counts[1][w], w))))
        for kind in (0, 1):
            for w in [w for w in counts[kind] if w.startswith(best)]:
                for s in _beginnings(w):
                    stems[kind][s] -= counts[kind][w]
                del counts[kind][w]
        likely = {s for s in likely if stems[1][s] >= 5}


def _content(samples: list[bytes], most: int) -> bytes:
    """The content of a trained dictionary, at most ``most`` bytes, or the samples themselves where there are too few to train.

    A dictionary begins with tables for its own frames; its content begins where the samples' bytes do.
    """
    joined = b"".join(samples)
    try:
        made = zstandard.train_dictionary(most + 692, samples).as_bytes()
    except zstandard.ZstdError:
        return joined[:most]
    return made[next((p for p in range(8, len(made)) if made[p:p + 16] in joined), len(made)):][-most:]


def _aligned(entry: bytes) -> bytes:
    return entry + b"\0" * (-len(entry) % 3)


class Distance:
    """Saved bytes per window under an ordinary and several toxic dictionaries; made from bytes, so that it can be sent to executors."""

    def __init__(self, ordinary: bytes, toxic: list[bytes]):
        self.ordinary, self.toxic = ordinary, toxic
        self._ready = None

    def __getstate__(self):
        return self.ordinary, self.toxic

    def __setstate__(self, state):
        self.__init__(*state)

    def saved(self, windows: list[bytes]) -> np.ndarray:
        """A row for each of ``PAIRS``: bytes that the toxic dictionary saves for each window."""
        if self._ready is None:
            def compressor(content: bytes, least: int):
                frame = zstandard.ZstdCompressionParameters(min_match=least, **_FRAME)
                made = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(compression_params=frame)
                return zstandard.ZstdCompressor(dict_data=made, compression_params=frame).compress

            base = _aligned(self.ordinary)
            self._ready = [(compressor(base + b"\0" * len(self.toxic[k]), least), compressor(base + self.toxic[k], least)) for k, least in PAIRS]
        return np.array([[len(ordinary(w)) - len(toxic(w)) for w in windows] for ordinary, toxic in self._ready], np.float64).reshape(len(PAIRS), len(windows))

    def features(self, text: bytes | None) -> np.ndarray:
        """The number of windows, and for each distance the shares of windows that save 1 to 4 bytes (drawn to a low share where windows are few), the mean saving up to 6, and how many save 2 to 4."""
        cut = windows(text)
        n = len(cut)
        if not n:
            return np.zeros(NUMBERS)
        out = [math.log1p(n)]
        for d in self.saved(cut):
            over = [int((d >= k).sum()) for k in (1, 2, 3, 4)]
            out += [math.log((c + 0.18) / (n + 6)) for c in over] + [float(np.clip(d, 0, 6).sum()) / (n + 6)] + [min(c, 3) for c in over[1:]]
        return np.array(out)


class Model:
    """A distance and a calibrated logistic over its numbers."""

    def __init__(self, distance: Distance, mean, scale, weights, bias):
        self.distance, self.mean, self.scale, self.weights, self.bias = distance, mean, scale, weights, bias

    def score(self, text: bytes | None) -> float:
        z = ((self.distance.features(text) - self.mean) / self.scale) @ self.weights + self.bias
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def _dictionaries(texts: list[bytes], y: list[int], seed: int) -> Distance:
    plain = [w for t, kind in zip(texts, y) if not kind for w in windows(t)]
    random.Random(seed).shuffle(plain)
    stems = marking_stems(texts, y)
    toxic = []
    for most in WORDS:  # the best stand last, nearest to the window
        words = [w for s, found in stems for w in [w for w in found if w != s and len(w) <= 24][:most][::-1]]
        toxic.append(b"".join(_aligned(b" " + w) for w in [*words, *[s for s, _ in stems][::-1]]))
    return Distance(_content(plain[:ORDINARY_WINDOWS], ORDINARY_BYTES), toxic)


def fit(texts: list[bytes], y: list[int], seed: int = 7) -> Model:
    """Dictionaries of all rows; the threshold is calibrated on halves, each measured with dictionaries of the other."""
    share = sum(y) / len(y) if y else 0.5
    if not y or share in (0, 1):
        return Model(Distance(b"", [b""] * len(WORDS)), np.zeros(NUMBERS), np.ones(NUMBERS), np.zeros(NUMBERS), {0.0: -30.0, 1.0: 30.0}.get(share, 0.0))
    x = np.zeros((len(y), NUMBERS))
    for part in (0, 1):
        other = _dictionaries(texts[1 - part::2], y[1 - part::2], seed)
        for i in range(part, len(y), 2):
            x[i] = other.features(texts[i])
    target = np.array(y, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights, bias = logistic((x - mean) / scale, target)
    bias += _shift(((x - mean) / scale) @ weights + bias, target)
    return Model(_dictionaries(texts, y, seed), mean, scale, weights, bias)


def _shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to add to the logits so that ``THRESHOLD`` is the cut of the best F1 on the calibration rows."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    best = int(f1.argmax())
    cut = z[order][best:best + 2].mean()
    return math.log(THRESHOLD / (1 - THRESHOLD)) - float(np.clip(cut, -6, 6))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on at most ``TRAIN_DOCS`` labelled rows of at most ``TRAIN_BYTES`` together, by the order of the ids' hash."""
    sample = labelled_sample(docs, labels, label, TRAIN_DOCS)
    sizes = sample.select("doc_id", F.octet_length("text").alias("n")).collect()
    import hashlib

    order = sorted(sizes, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
    held, ids = 0, []
    for r in order:
        if held + (r["n"] or 0) <= TRAIN_BYTES:
            held += r["n"] or 0
            ids.append(r["doc_id"])
    rank = {d: i for i, d in enumerate(ids)}
    rows = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in ids], "doc_id long")), "doc_id", "left_semi").collect() if ids else []
    rows = sorted(rows, key=lambda r: rank[r["doc_id"]])
    return fit([(r["text"] or "").encode() for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one pass over whole texts, no shuffle."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 4 << 20):
            found = [model.score(t) for t in piece.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([piece.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
