"""Benchmark decontamination: every passage queries a BM25 index of test items with block-max WAND.

Items are cut into chunks of at most ``CHUNK`` words and indexed.  A document's
passages are ``2 * CHUNK`` words with half overlap, so a copied chunk lies whole in
one of them.  A chunk's score is the BM25 of the shared words over the chunk's
BM25 with itself, between 0 and 1; all chunks at ``THRESHOLD`` or more are retrieved.
A retrieved item is verified where it was found, in the passages that retrieved it and as many words around them as the item has:
of its question's five-word shingles and of its answer's words a share of ``OVERLAP`` each must stand together in one such place.

Defined results: a null or empty text or item matches nothing; an item without a question or an answer
is verified by what it has; repeated documents give a row each, null ids stay null, repeated or null item ids are one item each; empty tables
give an empty result; other columns are ignored, whatever their names.  A long text's words are held whole and searched in runs of ``RUN`` chunks: one of 20 MB took
about 270 MB of a task's memory with an index of 200 items.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table

CHUNK = 64
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
#: Chunks in a block; a list's bound over a block is its largest impact there.
BLOCK = 8
#: Words in more blocks than this give one bound for all blocks: they are frequent, so their impacts are small.
WIDE = 32
#: Bytes of item texts in one index; more items make more indexes, each broadcast by itself.
INDEX_BYTES = 4 << 20
#: Indexes that one pass over the documents asks, all held in a worker's memory (about ten bytes for each byte of their items).
PASS_INDEXES = 8
PIECE_BYTES = 1 << 19
#: Chunks of words that are searched at once: their bounds take eight bytes for each block of an index.
RUN = 2048
_BARE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return (text or "").lower().encode().translate(_BARE).split()


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that is one text: the last sentence is the answer, if there are more."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text or "") if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


class Index:
    """Posting lists in blocks over item chunks; impacts are shares of a chunk's score with itself."""

    def __init__(self, items: list[tuple[int | None, str, str]], n: int, average: float, df: dict[bytes, int]):
        self.items = [(i, words(q), words(a)) for i, q, a in items]
        chunks = []
        for k, (_, q, a) in enumerate(self.items):
            whole = q + a
            chunks += [(len(whole[s:s + CHUNK]), k, whole[s:s + CHUNK]) for s in range(0, len(whole), CHUNK)]
        chunks.sort(key=lambda c: c[:2])  # chunks of like length share blocks, which tightens the blocks' bounds
        self.of = [k for _, k, _ in chunks]
        self.ids: dict[bytes, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for c, (size, _, ws) in enumerate(chunks):
            tf = Counter(ws)
            part = {w: math.log(1 + (n - df.get(w, 1) + 0.5) / (df.get(w, 1) + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / average)) for w, f in tf.items()}
            whole = sum(part.values())
            for w, v in part.items():
                t = self.ids.setdefault(w, len(self.ids))
                if t == len(lists):
                    lists.append([])
                lists[t].append((c, v / whole))
        self.docs = [[c for c, _ in p] for p in lists]
        self.impacts = [[v for _, v in p] for p in lists]
        self.n_blocks = -(-len(chunks) // BLOCK)
        self.block_max: list[dict[int, float]] = []
        for p in lists:
            most: dict[int, float] = {}
            for c, v in p:
                most[c // BLOCK] = max(v, most.get(c // BLOCK, 0.0))
            self.block_max.append(most)
        self.top = [max(m.values()) for m in self.block_max]
        narrow = [m if len(m) <= WIDE else {} for m in self.block_max]
        self.wide = np.array([0.0 if m else t for m, t in zip(narrow, self.top)])
        self.first = np.concatenate([[0], np.cumsum([len(m) for m in narrow])]).astype(np.int64)
        self.cols = np.array([b for m in narrow for b in m], np.int64)
        self.maxima = np.array([v for m in narrow for v in m.values()])

    def search(self, terms: list[int], least: float, live: list[int] | None = None) -> list[tuple[int, float]]:
        """All (chunk, score) of chunks with a score of ``least`` or more, for distinct terms.

        ``live`` are the blocks, in order, that can hold such chunks, where their bounds have been added up already; the pivot jumps to the next of them.
        """
        docs, slack, found = self.docs, least - 1e-9, []
        heads = [(docs[t][0], t, 0) for t in terms]
        while heads:
            heads.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(heads):
                bound += self.top[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = heads[pivot][0]
            while pivot + 1 < len(heads) and heads[pivot + 1][0] == at:
                pivot += 1
            block, goal = at // BLOCK, None
            if live is not None:
                k = bisect_left(live, block)
                if k == len(live):
                    break
                if live[k] != block:  # no chunk before the next live block can reach the threshold, with any lists
                    goal, pivot = live[k] * BLOCK, len(heads) - 1
            if goal is None and sum(self.block_max[t].get(block, 0.0) for _, t, _ in heads[: pivot + 1]) >= slack:
                goal, score = at + 1, 0.0
                for _, t, p in heads[: pivot + 1]:
                    p = bisect_left(docs[t], at, p)
                    if p < len(docs[t]) and docs[t][p] == at:
                        score += self.impacts[t][p]
                if score >= slack:
                    found.append((at, score))
            elif goal is None:  # no chunk of the block can reach the threshold with these lists
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(heads):
                    goal = max(at + 1, min(goal, heads[pivot + 1][0]))
            moved = []
            for k, (c, t, p) in enumerate(heads):
                if k <= pivot and c < goal:
                    p = bisect_left(docs[t], goal, p)
                    if p == len(docs[t]):
                        continue
                    c = docs[t][p]
                moved.append((c, t, p))
            heads = moved
        return found

    def retrieve(self, texts: list[list[bytes]], least: float, run: int = RUN) -> list[dict[int, list]]:
        """For each text's words {item: [score, first words of the passages]} over all of its passages.

        A text of more than ``run`` chunks of words is taken in runs that share a chunk, so every passage of two chunks is in one of them and no more than a run's block bounds are held.
        """
        parts, owner, first = [], [], []
        for k, ws in enumerate(texts):
            for at in range(0, max(1, -(-len(ws) // CHUNK) - 1), run):
                owner.append(k)
                first.append(at * CHUNK)
                parts.append(ws[at * CHUNK:(at + run + 1) * CHUNK])
        found: list[dict[int, list]] = [{} for _ in texts]
        at = 0
        while at < len(parts):
            end, held = at + 1, len(parts[at])
            while end < len(parts) and held + len(parts[end]) <= (run + 1) * CHUNK:
                held += len(parts[end])
                end += 1
            for k, begin, got in zip(owner[at:end], first[at:end], self._retrieve(parts[at:end], least)):
                for item, (score, starts) in got.items():
                    seen = found[k].setdefault(item, [0.0, set()])
                    seen[0] = max(seen[0], score)
                    seen[1].update(begin + s for s in starts)
            at = end
        return found

    def _retrieve(self, texts: list[list[bytes]], least: float) -> list[dict[int, list]]:
        """The block bounds are added up for all passages at once; a passage with blocks that reach ``least`` is searched through these."""
        get, none = self.ids.get, len(self.ids)
        sizes = np.array([len(ws) for ws in texts], np.int64)
        ids = np.fromiter((get(w, none) for ws in texts for w in ws), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        n_segments = -(-sizes // CHUNK)
        segment0 = np.cumsum(n_segments) - n_segments
        doc = np.repeat(np.arange(len(texts)), sizes)
        segment = segment0[doc] + (np.arange(len(ids)) - begin[doc]) // CHUNK
        known = ids < none
        key = np.unique(segment[known] * (none + 1) + ids[known])
        of, term = key // (none + 1), key % (none + 1)
        total = int(n_segments.sum())
        many = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        bound = np.bincount(np.repeat(of, many) * self.n_blocks + self.cols[at], self.maxima[at], total * self.n_blocks).reshape(total, self.n_blocks)
        bound += np.bincount(of, self.wide[term], total)[:, None]
        owner = np.repeat(np.arange(len(texts)), n_segments)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        alone = segment0[n_segments == 1]
        found: list[dict[int, list]] = [{} for _ in texts]
        cut = np.searchsorted(of, np.arange(total + 1))
        for starts, width, sums in ((pair, 2, bound[pair] + bound[pair + 1]), (alone, 1, bound[alone])):
            row, block = np.nonzero(sums >= least - 1e-6)
            edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            for k, live in zip(row[edge].tolist(), np.split(block, edge[1:])):
                s = int(starts[k])
                terms = np.unique(term[cut[s]:cut[s + width]]).tolist()
                for chunk, score in self.search(terms, least, live.tolist()):
                    seen = found[owner[s]].setdefault(self.of[chunk], [0.0, set()])
                    seen[0] = max(seen[0], score)
                    seen[1].add(int(s - segment0[owner[s]]) * CHUNK)
        return found

    def matches(self, tokens: list[list[bytes]], least: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
        """For each text's words its verified items as (item, score, passages, first word, question share, answer share)."""
        return [self._verified(ws, got, overlap) if got else [] for ws, got in zip(tokens, self.retrieve(tokens, least))]

    def _verified(self, ws: list[bytes], retrieved: dict[int, list], overlap: float) -> list[tuple]:
        out = []
        for k, (score, starts) in sorted(retrieved.items()):
            item, q, a = self.items[k]
            shares = [(shingle_share(q, part), word_share(a, part)) for part in surroundings(ws, starts, len(q) + len(a))]
            question, answer = max(shares, key=lambda s: (min(s), s))
            if min(question, answer) >= overlap:
                out.append((item, score, len(starts), min(starts), question, answer))
        return out


def surroundings(ws: list[bytes], starts: set[int], around: int) -> Iterator[list[bytes]]:
    """The passages that begin at ``starts`` with ``around`` words on either side, joined where they meet."""
    begin = end = None
    for s in sorted(starts):
        if end is None or s - around > end:
            if end is not None:
                yield ws[begin:end]
            begin = max(0, s - around)
        end = s + 2 * CHUNK + around
    yield ws[begin:end]


def shingle_share(part: list[bytes], ws: list[bytes]) -> float:
    """The share of the part's shingles that are in the words; a part shorter than one has to be in them whole, and an empty one is."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    wanted = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
    return len(wanted.intersection(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))) / len(wanted)


def word_share(part: list[bytes], ws: list[bytes]) -> float:
    wanted = set(part)
    return len(wanted.intersection(ws)) / len(wanted) if wanted else 1.0


def indexes(items: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of about ``limit`` bytes of items each, under the statistics of all items.

    ``items`` has item_id, question, answer.  The driver holds one index at a time and the counts of its own words.
    """
    sized = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("question").cast("string"), F.lit("")).alias("question"),
        F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"))

    def counted(batches):
        for batch in batches:
            rows = batch.to_pylist()
            tokens = [words(r["question"]) + words(r["answer"]) for r in rows]
            parts = [[t[s:s + CHUNK] for s in range(0, len(t), CHUNK)] for t in tokens]
            yield pa.record_batch([
                pa.array([sum(map(len, t)) for t in tokens], pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                pa.array([[w for c in p for w in set(c)] for p in parts], pa.list_(pa.binary())),
            ], ["bytes", "n_words", "n_chunks", "terms"])

    stats = sized.mapInArrow(counted, "bytes long, n_words long, n_chunks long, terms array<binary>")
    held, n_words, n_chunks = stats.agg(F.sum("bytes"), F.sum("n_words"), F.sum("n_chunks")).first()
    if not n_chunks:
        return
    blocks = -(-held // limit)
    df = stats.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(blocks):
        own = sized.filter(F.pmod(F.xxhash64("item_id", "question"), F.lit(blocks)) == k) if blocks > 1 else sized
        mine = own.mapInArrow(counted, "bytes long, n_words long, n_chunks long, terms array<binary>").select(F.explode("terms").alias("term")).distinct()
        counts = {bytes(r["term"]): r["df"] for r in df.join(mine, "term", "left_semi").toLocalIterator()}
        rows = sorted(((r["item_id"], r["question"], r["answer"]) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
        yield Index(rows, n_chunks, n_words / n_chunks, counts)


DDL = "doc_id long, item_id long, score double, n_passages long, first_word long, shingle_share double, answer_share double"


def _passes(spark: SparkSession, items: DataFrame) -> Iterator[list]:
    """Broadcast indexes, ``PASS_INDEXES`` at a time: a pass over the documents asks them all."""
    sent = []
    for index in indexes(items):
        sent.append(spark.sparkContext.broadcast(index))
        if len(sent) == PASS_INDEXES:
            yield sent
            sent = []
    if sent:
        yield sent


def _matches(texts: list[str | None], sent: list, least: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
    tokens = [words(t) for t in texts]
    return [sum(found, []) for found in zip(*(index.value.matches(tokens, least, overlap) for index in sent))]


def contaminated(docs: DataFrame, items: DataFrame, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and verified item; one pass over the documents for ``PASS_INDEXES`` indexes, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = spark.createDataFrame([], DDL)
    for sent in _passes(spark, items):

        def matched(batches, sent=sent):
            for piece in pieces(batches, "text", PIECE_BYTES):
                found = [(d, *m) for d, ms in zip(piece.column("doc_id").to_pylist(), _matches(piece.column("text").to_pylist(), sent, least, overlap)) for m in ms]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)],
                                      ["doc_id", "item_id", "score", "n_passages", "first_word", "shingle_share", "answer_share"])

        out = out.union(rows.mapInArrow(matched, DDL))
    return out


def benchmark_items(bench: DataFrame) -> DataFrame:
    """item_id, question and answer of a table whose items are single texts."""

    def parts(batches):
        for batch in batches:
            found = [split_item(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("item_id"), pa.array([q for q, _ in found], pa.string()), pa.array([a for _, a in found], pa.string())], ["item_id", "question", "answer"])

    return bench.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").mapInArrow(parts, "item_id long, question string, answer string")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a verified item; all columns, decided row by row and without a join."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")  # by place: other columns' names don't matter
    for sent in _passes(spark, items):

        def passed(batches, sent=sent):
            for piece in pieces(batches, "text", PIECE_BYTES):
                yield piece.filter(pa.array([not m for m in _matches(piece.column(at).to_pylist(), sent)], pa.bool_()))

        docs = docs.mapInArrow(passed, docs.schema)
    return docs


def op1_bm25_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), benchmark_items(table(spark, sf_dir, "benchmark")))
