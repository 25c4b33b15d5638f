"""SimHash near-duplicates through a hierarchical index in Gray order.

Two fingerprints that differ in at most two bits agree in at least two of four
16-bit blocks.  For each of the six pairs of blocks the fingerprints are grouped by
those 32 bits.  Inside a group, they are sorted by the Gray rank of the other 32 bits, so
fingerprints that share leading bits stand together; each shared bit pattern is
held once, in an upper node.  Pairs of nodes are compared pattern by pattern from the
top, and whole pairs of subtrees go as soon as the differences add up to more than two.

Groups of over ``MOST`` different fingerprints are linked in another, exact way:
fingerprints at distance two or less share a number at distance one or less, and
each such number has at most 65 fingerprints around it.

Defined results: a null or empty text has fingerprint zero, which links like any other; a
null doc_id is an ordinary row that never names a component while another row of it has an
id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, fresh, pieces, skew_join, small_batches, table, written
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Different fingerprints that one group of the index may hold.
MOST = 2048
#: Pairs of nodes compared at once.
FRONT = 1 << 20
_digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
_TABLES = [(i, j) for i in range(4) for j in range(i)]


def fingerprint(text: bytes | None) -> int:
    """The SimHash of the lower-cased text's word shingles as an unsigned number."""
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return _digest(joined)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: 1 - SHINGLE] + 1).tolist()]
    ends = [*spaces[SHINGLE - 1:].tolist(), len(joined)]
    found = np.fromiter((_digest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, len(starts))
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(found), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", 4 << 20):
        found = np.array([fingerprint(t) for t in piece.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.record_batch([piece.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each 32-bit code in the reflected Gray sequence."""
    out = codes.astype(np.uint32)
    for k in (1, 2, 4, 8, 16):
        out = out ^ (out >> np.uint32(k))
    return out


def close_pairs(group: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows in the same group whose 32-bit codes differ in at most ``radius`` bits.

    Rows come sorted by group and Gray rank; (group, code) must be unique.
    """
    n = len(codes)
    first = [np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]  # first row of each node, level by level
    for shift in (24, 16, 8):
        top = codes >> np.uint32(shift)
        first.append(np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (top[1:] != top[:-1])]))
    first.append(np.arange(n))
    child = [np.append(np.searchsorted(first[k + 1], first[k]), len(first[k + 1])) for k in range(4)]
    pattern = [(codes[first[k + 1]] >> np.uint32(24 - 8 * k)) & np.uint32(255) for k in range(4)]
    roots = np.arange(len(first[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
    while stack:
        level, a, b, gone = stack.pop()
        if level == 4:
            yield a[a < b], b[a < b]
            continue
        na, nb = child[level][a + 1] - child[level][a], child[level][b + 1] - child[level][b]
        ways = na * nb
        if len(a) > 1 and ways.sum() > FRONT:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:], gone[half:]), (level, a[:half], b[:half], gone[:half])]
            continue
        at = np.repeat(np.arange(len(a)), ways)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(ways) - ways, ways)
        x, y = child[level][a][at] + nth // nb[at], child[level][b][at] + nth % nb[at]
        total = gone[at] + np.bitwise_count(pattern[level][x] ^ pattern[level][y])
        keep = (x <= y) & (total <= radius)
        stack.append((level + 1, x[keep], y[keep], total[keep]))


def _least_labels(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row reachable."""
    label = np.arange(n)
    for i, j in links:
        while True:
            low = np.minimum(label[i], label[j])
            changed = (label[i] != low) | (label[j] != low)
            if not changed.any():
                break
            i, j, low = i[changed], j[changed], low[changed]
            np.minimum.at(label, np.r_[label[i], label[j], i, j], np.r_[low, low, low, low])
            while (label[label] != label).any():
                label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def _block(x, k: int):
    return (x >> np.uint64(16 * k)) & np.uint64(0xFFFF)


def _linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, another of its group's component) for complete groups of equal keys."""
    if not len(fps):
        return fps, fps
    fps = fps.view(np.uint64)
    rest = np.zeros(len(fps), np.uint32)
    for t, used in enumerate(_TABLES):
        here = (keys >> 32) == t
        hi, lo = (k for k in (3, 2, 1, 0) if k not in used)
        rest[here] = (_block(fps[here], hi) << np.uint64(16) | _block(fps[here], lo)).astype(np.uint32)
    order = np.lexsort((gray_rank(rest), keys))
    fps = fps[order]
    label = _least_labels(len(fps), close_pairs(keys[order], rest[order]))
    linked = label != np.arange(len(fps))
    return fps[linked].view(np.int64), fps[label[linked]].view(np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to (a, b) links; b is null for members of groups that are too large."""
    keys, fps, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(a, b):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def complete(keys, fps):
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, len(keys)])
        big = np.repeat(size > MOST, size)
        pair = np.repeat(size > 1, size) & ~big
        if big.any():
            yield out(fps[big], [None] * int(big.sum()))
        yield out(*_linked(keys[pair], fps[pair]))

    for batch in batches:
        if not batch.num_rows:
            continue
        k, f = (batch.column(c).to_numpy() for c in ("key", "fp"))
        if large is not None:
            still = k == large
            if still.any():
                yield out(f[still], [None] * int(still.sum()))
            k, f = k[~still], f[~still]
            if not len(k):
                continue
            large = None
        keys, fps = np.r_[keys, k], np.r_[fps, f]
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if last:
            yield from complete(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
        if len(keys) > MOST:
            large = keys[0]
            yield out(fps, [None] * len(fps))
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield from complete(keys, fps)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a > b) that connect all fingerprints within ``RADIUS`` bits; ``nodes`` has distinct longs ``fp``."""
    part = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for t, (i, j) in enumerate(_TABLES)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long"), "links")
    large = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)]
    around = large.select("fp", F.explode(F.array(*near)).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps"))
    stars = around.filter(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    every = found.filter("b is not null").union(stars).filter("a <> b")
    return every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints."""
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("a").alias("_fp"), F.col("b").alias("_root"))
    linked = nodes.join(roots, F.col("fp") == F.col("_fp"), "left").select("fp", "least", "n", F.coalesce("_root", "fp").alias("root"))
    linked = written(linked, "linked")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = skew_join(linked.withColumnRenamed("n", "rows"), by_root, "root", nodes.count(), 50_000).select("fp", "component_id", F.col("rows").alias("n"))
    return skew_join(prints.select("doc_id", "fp"), written(of, "components"), "fp", prints.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stay: of each group the first by doc_id (nulls last), hash of the text and number; all columns of ``docs`` as they are, whatever their names.

    Where ids repeat or are null, rows are numbered and groups are made of the numbers, so each group keeps one row and no other group loses one.
    """
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        found = written(near_duplicates(docs), "groups")
        gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    number = fresh(docs, "_number")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias("_of"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.col(number).alias("d"))
    named = numbered.select(F.col(number).alias("_n"), order.alias("order")).join(found, F.col("_n") == F.col("_of"))
    first = written(named.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.d").alias("_first")), "first-of-each")
    return numbered.join(first, numbered[number] == first["_first"], "left_semi").drop(number)


def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
