"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded from
its bytes and words; a gated attention layer, learnt from document labels
only, weighs the passages, and the weighted representation is scored.

Defined results: a null or empty text is one passage without words, so it has a score too;
a null doc_id and repeated rows are ordinary rows; without labels every score is 0.5; an empty table gives an
empty result; other columns are ignored, whatever their names.  A text is encoded whole: one of 20 MB took about 760 MB of a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table, written
from .labelled import held_out, labelled_sample
from .repetition import Powers, mixed, repeated, span_hashes

PASSAGE = 96
#: Most labelled documents, and passages of theirs, that a model learns from.
TRAIN_DOCS = 6000
TRAIN_PASSAGES = 60_000
HIDDEN, GATE, EPOCHS = 32, 16, 24
THRESHOLD = 0.5
PIECE_BYTES = 1 << 20

#: Byte classes of the encoder: a letter's pairs with its neighbour make the features.
_kinds = np.full(256, 9, np.uint8)
for _k, _chars in enumerate([b" \t\r\v\f", b"\n", b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?", b"!", b"#*$%&|<>"]):
    _kinds[list(_chars)] = _k
_kinds[128:] = 10
_kinds[192:] = 11
KINDS = 12
FEATURES = KINDS * KINDS + 10


def encode(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of some texts, and the text that each belongs to."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    kind = _kinds[data]
    space = kind <= 1
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    doc = np.searchsorted(text_end, starts, "right")
    n_words = np.bincount(doc, minlength=len(texts))
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n_passages) - n_passages
    passage = first[doc] + nth // PASSAGE
    total = int(n_passages.sum())

    owner = np.repeat(np.arange(len(texts)), n_passages)
    out = np.zeros((total, FEATURES), np.float32)
    # a byte belongs to the passage of the last word that began, bytes before the first word to the first passage; counted in runs, so that little is held for each byte
    flat = np.zeros(total * KINDS * KINDS, np.int64)
    for at in range(0, len(data) - 1, PIECE_BYTES):
        here = np.arange(at, min(at + PIECE_BYTES, len(data) - 1))
        byte_doc = np.searchsorted(text_end, here, "right")
        of = first[byte_doc]
        if len(starts):
            last = np.maximum(np.searchsorted(starts, here, "right") - 1, 0)
            inside = (starts[last] <= here) & (doc[last] == byte_doc)
            of = np.where(inside, passage[last], of)
        pair = kind[at:at + len(here)].astype(np.int64) * KINDS + kind[at + 1:at + 1 + len(here)]
        same = here + 1 < text_end[byte_doc]
        low = int(of.min())  # passages stand in order
        found = np.bincount(((of - low) * KINDS * KINDS + pair)[same])
        flat[low * KINDS * KINDS:low * KINDS * KINDS + len(found)] += found
    flat = flat.reshape(total, -1)
    size = np.maximum(flat.sum(1), 1)
    out[:, : KINDS * KINDS] = np.sqrt(flat / size[:, None])
    if len(starts):
        words = np.maximum(np.bincount(passage, minlength=total), 1)
        hashes = span_hashes(data, starts, ends, powers)
        length = (ends - starts).astype(float)
        _, again = repeated(mixed(hashes ^ mixed((passage + 1).astype(np.uint64))))
        as_before = np.r_[False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])]
        marks = np.zeros(len(data) + 1, np.int32)
        np.cumsum((kind == 8) | (kind == 7), out=marks[1:])
        upper = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == 4, out=upper[1:])
        mean = lambda v: np.bincount(passage, v, total) / words
        k = KINDS * KINDS
        average = mean(length)
        out[:, k] = np.log1p(np.bincount(passage, minlength=total)) / 5
        out[:, k + 1] = average / 10
        out[:, k + 2] = np.sqrt(np.maximum(mean(length**2) - average**2, 0)) / 5
        out[:, k + 3] = mean(again)
        out[:, k + 4] = mean(as_before)
        out[:, k + 5] = mean(marks[ends] > marks[starts])
        out[:, k + 6] = mean(upper[ends] - upper[starts] == ends - starts)
        out[:, k + 7] = mean(length == 1)
        out[:, k + 8] = mean(length > 20)
        whole = (np.maximum(n_words, 1))[doc]
        out[:, k + 9] = np.log1p(np.bincount(passage, whole, total) / words) / 10
    return out, owner


class Attention:
    """x -> tanh(xW + b) = h; a = softmax(u . (tanh(hV) * sigmoid(hG))) over a document's passages; p = sigmoid(c . sum(a h) + d)."""

    def __init__(self, mean, scale, params: dict[str, np.ndarray]):
        self.mean, self.scale, self.params = mean, scale, params

    def forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        p = self.params
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["G"], -30, 30)))
        e = (t * g) @ p["u"]
        top = np.repeat(np.maximum.reduceat(e, starts), counts)
        a = np.exp(e - top)
        a = a / np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def gradients(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the documents and 5e-5 times the squares of W, by parameter; ``x`` is scaled."""
        p = self.params
        h, t, g, a, z, prob = self.forward(x, starts, counts)
        dz = (prob - target) / len(target)
        grad = {"c": z.T @ dz, "d": dz.sum()}
        dz = np.repeat(dz[:, None] * p["c"], counts, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        grad["u"] = (t * g).T @ de
        dtg = de[:, None] * p["u"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        grad["V"], grad["G"] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["G"].T) * (1 - h**2)
        grad["W"], grad["b"] = x.T @ dh + 1e-4 * p["W"], dh.sum(0)
        return grad

    def scores(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return self.forward((x - self.mean) / self.scale, starts, np.diff(np.r_[starts, len(x)]))[-1]


def fit(bags: list[np.ndarray], y: list[int], seed: int = 11) -> Attention:
    """Adam over batches of documents; the gradients are written out below."""
    rng = np.random.default_rng(seed)
    params = {
        "W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "G": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(()),
    }
    if not bags:
        return Attention(np.zeros(FEATURES), np.ones(FEATURES), params)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-2
    bags = [((b - mean) / scale) for b in bags]
    target, model = np.array(y, float), Attention(mean, scale, params)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at:at + 64]
            x = np.concatenate([bags[i] for i in chosen])
            counts = np.array([len(bags[i]) for i in chosen])
            starts = np.cumsum(counts) - counts
            grad = model.gradients(x, starts, counts, target[chosen])
            step += 1
            rate = 0.004 * (1 - epoch / EPOCHS)
            for k, v in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for piece in pieces(batches, "text", PIECE_BYTES):
        x, owner = encode([t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()], powers)
        cuts = np.searchsorted(owner, np.arange(piece.num_rows + 1))
        bags = [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.record_batch([piece.column("doc_id"), piece.column("y"), pa.array(np.diff(cuts), pa.int32()), pa.array(bags, pa.binary())], ["doc_id", "y", "n", "bag"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Attention:
    """Fit on at most ``TRAIN_DOCS`` labelled rows with at most ``TRAIN_PASSAGES`` passages, by the order of the ids' hash."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, TRAIN_DOCS)
    bags = written(sample.select("doc_id", "y", "text").mapInArrow(_bags, "doc_id long, y int, n int, bag binary"), "quality-bags")
    order = sorted(bags.select("doc_id", "n").collect(), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
    held, rank = 0, {}
    for r in order:
        if held + r["n"] <= TRAIN_PASSAGES:
            held += r["n"]
            rank[r["doc_id"]] = len(rank)
    if not rank:
        return fit([], [])
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in rank], "doc_id long"))
    found = bags.join(chosen, "doc_id", "left_semi").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "y", "bag"))), key=lambda r: rank[r[0]])
    return fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, _, b in rows], [y for _, y, _ in rows])


def score(docs: DataFrame, model: Attention, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one pass over whole texts, no shuffle."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for piece in pieces(batches, "text", PIECE_BYTES):
            x, owner = encode([t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()], powers)
            yield pa.record_batch([piece.column("doc_id"), pa.array(model.scores(x, owner).astype(float), pa.float64())], ["doc_id", "score"])

    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Attention, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more; all columns, decided row by row and without a join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")  # by place: other columns' names don't matter

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for piece in pieces(batches, "text", PIECE_BYTES):
            x, owner = encode([t or b"" for t in piece.column(at).cast(pa.binary()).to_pylist()], powers)
            yield piece.filter(pa.array(model.scores(x, owner) >= threshold))

    return docs.mapInArrow(passed, docs.schema)


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
