"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte goes if a ``LENGTH``-byte string over it also starts earlier (in a document of
smaller id, or earlier in the same one).  Texts are read as UTF-8; matches never cross documents.

A suffix order of the whole corpus doesn't fit one machine, so positions are first
brought together by content.  Of each ``LENGTH``-byte string the ``K``-gram of least hash is its
anchor; equal strings have equal anchors at the same offset.  An anchor's strings cover
a context of fewer than two lengths.

1. Every text gives its anchors: hash of the K-gram, hash of the context, place.  Equal contexts
   within a batch are settled at once, so frequent passages shrink before the shuffle.
2. Anchors are sorted by (K-gram, context, place).  A later equal context is removed whole.  Contexts that
   share the K-gram and differ are kept for step 4.
3. Marks meet their texts; the contexts kept in step 2 are cut out.
4. Contexts with one K-gram are put in suffix order; the previous and next smaller places give the longest
   earlier match of each of their strings, which is removed if it has ``LENGTH`` bytes.  K-grams with many
   different contexts (a short line that ends many texts) are told apart first by the longer core that neighbouring strings share.
5. The marks of step 4 meet their texts.

Defined results: a null text is empty; null doc_ids come last; rows with the same doc_id are documents
of their own, ordered by a hash of the text (equal rows in any order); an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, prefix_sums, small_batches, table, written
from .repetition import Powers, mixed, repeated
from .suffixes import previous_factors

LENGTH = 100
K = 32
W = LENGTH - K + 1
#: Bytes handled at once; longer texts are cut into overlapping parts.
PIECE_BYTES = 1 << 19
#: Groups of more contexts are told apart by cores of ``LENGTH - SPAN + 1`` bytes.
SPLIT = 500
SPAN = 18
#: Contexts that are put in suffix order at once; groups that are still larger are compared string by string.
MOST_CONTEXTS = 20_000
GROUP_BYTES = 2 << 20


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size:]) if width > size else v


def anchors(data: np.ndarray, ends: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, first string, strings, anchor offset, K-gram hash, context hash) of each anchor's run of strings.

    ``data`` holds texts one after another (fewer than 2**20 bytes in all), ``ends`` where each ends.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    gram = mixed((total[K:] - total[:-K]) * down[: len(data) - K + 1])
    place = np.uint64((1 << 20) - 1)
    least = _sliding_min((gram & ~place) | np.arange(len(gram), dtype=np.uint64), W)
    anchor = (least & place).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= ends[text]
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(start)
    # a run ends before the next start or the next string that isn't valid
    stop = np.flatnonzero(np.concatenate([valid[:-1] & (~valid[1:] | start[1:]), valid[-1:]])) + 1
    context = mixed((total[stop + LENGTH - 1] - total[first]) * down[first] + (stop - first).astype(np.uint64))
    return text[first], first, stop - first, anchor[first] - first, gram[anchor[first]], context


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts in runs of about ``PIECE_BYTES``: numbers, where each part starts in its text, bytes, ends."""
    which, offset, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            part = t[at:at + PIECE_BYTES]
            if held and held + len(part) > PIECE_BYTES + PIECE_BYTES // 2:
                yield which, offset, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                which, offset, parts, held = [], [], [], 0
            which.append(i)
            offset.append(at)
            parts.append(part)
            held += len(part)
            if at + PIECE_BYTES >= len(t):
                break
            at += PIECE_BYTES - (LENGTH - 1)
    if parts:
        yield which, offset, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _longs(*columns, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], names)


ANCHOR = ["gram", "context", "doc", "place"]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with ``place`` = first << 16 | strings << 8 | offset; settled spans have offset 255 and as gram a hash of the document."""
    powers = Powers()
    for piece in pieces(batches, "text", PIECE_BYTES * 4):
        docs = piece.column("doc").to_numpy(zero_copy_only=False)
        order = np.argsort(docs, kind="stable")
        column = piece.column("text").cast(pa.binary()).to_pylist()
        texts = [column[i] or b"" for i in order]
        docs = docs[order]
        got = []
        for which, offset, data, ends in _parts(texts):
            text, first, n, off, gram, context = anchors(data, ends, powers)
            start = np.concatenate([[0], ends[:-1]])[text]
            got.append((docs[np.array(which)[text]], first - start + np.array(offset)[text], n, off, gram, context))
        doc, first, n, off, gram, context = (np.concatenate(x) for x in zip(*got))
        # rows are in order of place already; a stable sort finds the first of equal contexts
        by = np.lexsort((context, gram))
        same = np.zeros(len(by), bool)
        same[1:] = (gram[by][1:] == gram[by][:-1]) & (context[by][1:] == context[by][:-1])
        later = np.zeros(len(by), bool)
        later[by[same]] = True
        yield _longs(gram[~later], context[~later], doc[~later], first[~later] << 16 | n[~later] << 8 | off[~later], names=ANCHOR)
        if later.any():
            doc, first, end = doc[later], first[later], (first + n)[later]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > end[:-1] + LENGTH - 1)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(doc)) - 1
            yield _longs(mixed(doc[head].astype(np.uint64)), end[last] + LENGTH - 1, doc[head], first[head] << 16 | 255, names=ANCHOR)


MARK = ["doc", "start", "end", "gram", "strings"]
MARK_DDL = "doc long, start long, end long, gram long, strings long"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors to marks: spans to remove (strings 0), and contexts that share a K-gram and differ.

    Of the group that a batch ends in, only the last context's first row is carried on.
    """
    carried, many = None, False  # the row; whether its group has shown a second context
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, context, doc, place = (batch.column(c).to_numpy() for c in ANCHOR)
        settled = (place & 255) == 255
        if settled.any():
            zero = np.zeros(int(settled.sum()), np.int64)
            yield _longs(doc[settled], place[settled] >> 16, context[settled], zero, zero, names=MARK)
            gram, context, doc, place = gram[~settled], context[~settled], doc[~settled], place[~settled]
            if not len(gram):
                continue
        old = 0
        if carried is not None:
            gram, context, doc, place = (np.concatenate([[c], x]) for c, x in zip(carried, (gram, context, doc, place)))
            old = 1
        group = np.ones(len(gram), bool)
        group[1:] = gram[1:] != gram[:-1]
        head = group.copy()
        head[1:] |= context[1:] != context[:-1]
        number = np.cumsum(group) - 1
        heads = np.bincount(number, head).astype(np.int64)
        if old and many:
            heads[0] += 1
        differ = head & (heads[number] > 1)
        if old and many:
            differ[0] = False  # given out before
        first, n = place >> 16, (place >> 8) & 255
        later = ~head
        zero = np.zeros(int(later.sum()), np.int64)
        yield _longs(doc[later], first[later], (first + n)[later] + LENGTH - 1, zero, zero, names=MARK)
        yield _longs(doc[differ], first[differ], (first + n)[differ] + LENGTH - 1, gram[differ], n[differ], names=MARK)
        at = int(np.flatnonzero(head)[-1])
        carried, many = (gram[at], context[at], doc[at], place[at]), bool(heads[-1] > 1)


def _covered(n: int, starts, ends) -> tuple[list[tuple[int, int]], int]:
    """Merged spans and their bytes."""
    spans: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if spans and s <= spans[-1][1]:
            if e > spans[-1][1]:
                spans[-1] = (spans[-1][0], e)
        else:
            spans.append((s, e))
    return spans, sum(e - s for s, e in spans)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    return b"".join(text[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(text)]))


#: What step 3 and step 5 give: a result (gram null, text null), a text to see again, or a context.
STEP_DDL = "doc long, n_bytes long, n_removed long, kept binary, sha string, spans array<long>, gram long, start long, strings long, body binary"
_STEP = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("sha", pa.string()),
                   ("spans", pa.list_(pa.int64())), ("gram", pa.int64()), ("start", pa.int64()), ("strings", pa.int64()), ("body", pa.binary())])


def _applied(with_text: bool):
    """Marks and texts, sorted by document with the marks first, to results; texts with contexts are given on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, spans, contexts = None, [], []
        for batch in batches:
            rows = []
            body = batch.column("body").cast(pa.binary())
            is_text = batch.column("tag").to_numpy(zero_copy_only=False) == 1
            ids, start, end, gram, strings = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in MARK)
            earlier = batch.column("spans")
            for i in range(batch.num_rows):
                if ids[i] != doc:
                    doc, spans, contexts = ids[i], [], []
                if not is_text[i]:
                    (contexts if strings[i] else spans).append((int(start[i]), int(end[i]), int(gram[i]), int(strings[i])))
                    continue
                text = body[i].as_py() or b""
                before = earlier[i].as_py() or []
                merged, removed = _covered(len(text), [s[0] for s in spans] + before[::2], [s[1] for s in spans] + before[1::2])
                # strings under a span that is removed need no context
                open_ = [c for c in contexts if not any(s <= c[0] and c[1] <= e for s, e in merged)]
                flat = [x for s in merged for x in s]
                if open_:
                    rows.append((doc, None, None, None, None, flat, None, None, None, text))
                    for s, e, g, n in contexts:
                        rows.append((doc, None, None, None, None, None, g, s, n, text[s:e]))
                else:
                    left = _kept(text, merged)
                    rows.append((doc, len(text), removed, left if with_text else None, hashlib.sha256(left).hexdigest(), flat, None, None, None, None))
                    for s, e, g, n in contexts:  # others may match them
                        rows.append((doc, None, None, None, None, None, g, s, n, text[s:e]))
                if len(rows) >= 2000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _STEP)], schema=_STEP)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _STEP)], schema=_STEP)

    return run


def _met(marks: DataFrame, texts: DataFrame, with_text: bool) -> DataFrame:
    """``marks`` has the columns of MARK, ``texts`` doc, body and spans."""
    none = F.lit(None)
    left = marks.select(*MARK, F.lit(0).alias("tag"), none.cast("binary").alias("body"), none.cast("array<long>").alias("spans"))
    right = texts.select("doc", *[none.cast("long").alias(c) for c in MARK[1:]], F.lit(1).alias("tag"), F.col("body").cast("binary").alias("body"), "spans")
    return left.union(right).repartition("doc").sortWithinPartitions("doc", "tag").mapInArrow(_applied(with_text), STEP_DDL)


def _sharing(grams: np.ndarray, bodies: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first string, strings) of the parts of contexts whose core stands in another one with the same K-gram.

    The strings whose anchor offset is in one range of ``SPAN`` all hold the same ``LENGTH - SPAN + 1`` bytes around the anchor,
    so without that core elsewhere none of them stands elsewhere.
    """
    found, at, size = [], 0, np.array([len(b) for b in bodies])
    while at < len(bodies):
        to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), PIECE_BYTES)))
        data, ends = np.frombuffer(b"".join(bodies[at:to]), np.uint8), np.cumsum(size[at:to])
        text, first, n, off, _, _ = anchors(data, ends, powers)
        up, down = powers.get(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        begin = (ends - size[at:to])[text]
        for q in range(-(-W // SPAN)):
            low, high = np.maximum(SPAN * q, off - n + 1), np.minimum(SPAN * q + SPAN - 1, off)
            some = low <= high
            core = (first + off - SPAN * q)[some]
            key = mixed((total[core + LENGTH - SPAN + 1] - total[core]) * down[core]) ^ mixed(grams[at:to][text[some]].astype(np.uint64) * np.uint64(4) + np.uint64(q))
            found.append((mixed(key), text[some] + at, (first + off - high - begin)[some], (high - low + 1)[some]))
        at = to
    key, context, first, n = (np.concatenate(x) for x in zip(*found))
    twice, _ = repeated(key)
    return context[twice], first[twice], n[twice]


def _factors(grams: np.ndarray, docs: np.ndarray, starts: np.ndarray, bodies: list[bytes], powers: Powers) -> tuple[np.ndarray, ...]:
    """Spans (doc, start, end) of strings in the contexts that have an earlier match of full length; whole groups of contexts."""
    none = np.zeros(0, np.int64)
    if not bodies:
        return none, none, none
    context, first, strings = _sharing(grams, bodies, powers)
    if not len(context):
        return none, none, none
    parts = [bodies[c][f:f + n + LENGTH - 1] for c, f, n in zip(context.tolist(), first.tolist(), strings.tolist())]
    begin = np.cumsum(strings + LENGTH - 1) - (strings + LENGTH - 1)
    nth = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    doc, place = np.repeat(docs[context], strings), np.repeat(starts[context] + first, strings) + nth
    time = np.empty(len(doc), np.int64)
    time[np.lexsort((place, doc))] = np.arange(len(doc))
    hit = previous_factors(np.frombuffer(b"".join(parts), np.uint8), np.repeat(begin, strings) + nth, time, LENGTH) >= LENGTH
    owner, doc, place = np.repeat(np.arange(len(parts)), strings)[hit], doc[hit], place[hit]
    if not len(doc):
        return none, none, none
    new = np.ones(len(doc), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], place[head], place[last] + LENGTH


CONTEXT = ["gram", "doc", "start", "strings", "body"]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to parts whose strings' anchor offsets are within ``SPAN``, keyed by K-gram, offset range and the bytes that all of them hold."""
    powers = Powers()
    for batch in batches:
        rows = []
        for gram, doc, start, n, body in zip(*(batch.column(c).to_pylist() for c in CONTEXT)):
            data = np.frombuffer(body, np.uint8)
            for first, count, off in zip(*(x.tolist() for x in anchors(data, np.array([len(data)]), powers)[1:4])):
                anchor = first + off
                for q in range((off - count + 1) // SPAN, off // SPAN + 1):
                    low, high = max(SPAN * q, off - count + 1), min(SPAN * q + SPAN - 1, off)
                    core = body[anchor - SPAN * q:anchor - SPAN * q + LENGTH - SPAN + 1]
                    key = hashlib.blake2b(core, digest_size=8, salt=(gram & (1 << 63) - 1).to_bytes(8, "big") + q.to_bytes(8, "big")).digest()
                    rows.append((int.from_bytes(key, "big", signed=True), doc, start + anchor - high, high - low + 1, body[anchor - high:anchor - low + LENGTH]))
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.record_batch([pa.array(c, pa.binary() if n == "body" else pa.int64()) for c, n in zip(columns, CONTEXT)], CONTEXT)


FOUND = ["doc", "start", "end", "one", "two"]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by K-gram to spans; strings of groups that are too large come out hashed (one, two) instead."""
    held: list[tuple] = []
    rest, powers = None, Powers()

    def spans(rows):
        many = Counter(r[0] for r in rows)
        rows = [r for r in rows if many[r[0]] > 1]
        docs, starts, ends = _factors(*(np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2)), [r[4] for r in rows], powers)
        return pa.record_batch([pa.array(x, pa.int64()) for x in (docs, starts, ends)] + [pa.nulls(len(docs), pa.int64())] * 2, FOUND)

    def strings(rows):
        for _, doc, start, n, body in rows:
            keys = [hashlib.blake2b(body[i:i + LENGTH], digest_size=16).digest() for i in range(n)]
            keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            place = np.arange(start, start + n)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (np.full(n, doc), place, place + LENGTH, keys[:, 0], keys[:, 1])], FOUND)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "start", "strings", "body"))):
            if rest is not None:
                if row[0] == rest:
                    yield from strings([row])
                    continue
                rest = None
            if held and row[0] != held[-1][0] and sum(len(r[4]) for r in held) > GROUP_BYTES:
                yield spans(held)
                held = []
            held.append(row)
            if len(held) > MOST_CONTEXTS:
                cut = next(i for i, r in enumerate(held) if r[0] == row[0])
                if cut:
                    yield spans(held[:cut])
                    held = held[cut:]
                if len(held) > MOST_CONTEXTS:
                    yield from strings(held)
                    held, rest = [], row[0]
    if held:
        yield spans(held)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with ``doc`` unique and in order; where doc_id isn't unique, also (doc, doc_id)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, ids = plain.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return plain.withColumnRenamed("doc_id", "doc"), None
    ranked = prefix_sums(
        plain.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.lit(1).alias("one"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("by"), F.lit(0).alias("all")),
        "all", ["by", "hash"], "one", "ranked").select(F.col("row").alias("doc"), "doc_id", "text")
    ranked = written(ranked, "ranked")
    return ranked.select("doc", "text"), ranked.select("doc", "doc_id")


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (starts and ends in turn), kept_sha256 and, if asked for, the kept bytes."""
    small_batches(docs.sparkSession)
    texts, names = keyed(docs)
    rows = texts.mapInArrow(_anchor_rows, "gram long, context long, doc long, place long")
    ordered = rows.repartition("gram").sortWithinPartitions(*ANCHOR)
    marks = written(ordered.mapInArrow(_marks, MARK_DDL), "marks")
    step = written(_met(marks, texts.select("doc", F.col("text").alias("body"), F.lit(None).cast("array<long>").alias("spans")), with_text), "met")
    contexts = step.filter("gram is not null").select(*CONTEXT)
    frequent = written(contexts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select("gram"), "frequent-grams")
    parts = contexts.join(frequent, "gram", "left_semi").select(*CONTEXT).mapInArrow(_split, "gram long, doc long, start long, strings long, body binary")
    contexts = contexts.join(frequent, "gram", "left_anti").select(*CONTEXT).union(parts)
    found = written(contexts.repartition("gram").sortWithinPartitions("gram", "doc", "start").mapInArrow(_matched, ", ".join(f"{c} long" for c in FOUND)), "found")
    large = found.filter("one is not null")
    firsts = large.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("least")).select(F.col("one").alias("_one"), F.col("two").alias("_two"), "least")
    again = large.join(firsts, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))).filter(F.struct("doc", "start") != F.col("least"))
    more = found.filter("one is null").select("doc", "start", "end").union(again.select("doc", "start", "end"))
    more = more.select("doc", "start", "end", F.lit(0).cast("long").alias("gram"), F.lit(0).cast("long").alias("strings"))
    open_ = step.filter("gram is null and sha is null").select("doc", "body", "spans")
    results = step.filter("sha is not null").union(_met(more, open_, with_text))
    if names is not None:
        results = results.join(names.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"))
    else:
        results = results.withColumn("doc_id", F.col("doc"))
    out = ["doc_id", "n_bytes", "n_removed", "spans", F.col("sha").alias("kept_sha256")]
    return results.select(*out, *(["kept"] if with_text else []))


def op7_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
