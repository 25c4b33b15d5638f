"""Repetition coverage: rolling hashes of several n-gram lengths over whole texts, in numpy.

For each length n, a text's characters inside n-grams that stood earlier in the
text are measured against all characters in words; so are characters in lines equal
to an earlier line.  A text is kept if it passes the base rules and no coverage is over its limit.

Defined results: a null or empty text has no words, so all counts are 0 and
base_failed is true; a null doc_id and repeated rows are ordinary rows; an empty table
gives an empty result; other columns are ignored, whatever their names.  A text is measured whole: one of 20 MB took about 700 MB of a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, small_batches, table

#: Largest share of word characters inside repeats of earlier n-grams, by n.
#: Above what one repeated paragraph or boilerplate line gives an ordinary text.
LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of word characters in lines equal to an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
PIECE_BYTES = 1 << 20
#: Spans of more bytes are compared one by one, shorter ones all at once.
LONG_SPAN = 1 << 12

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93 | 1)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("dup_line_share", pa.float64()), ("max_excess", pa.float64()), ("worst_n", pa.int32()),
])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, dup_line_share double, max_excess double, worst_n int")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: np.uint64 = BASE):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + 1)
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, self.inverse, np.uint64)])
        return self.up[:n], self.down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, run: int = 4 * PIECE_BYTES) -> np.ndarray:
    """Hash of each byte span, the same wherever the span stands.

    Powers are held for ``run`` bytes; beyond these they are products with the power of the run's beginning.
    """
    up, down = powers.get(min(len(data) + 1, run))
    if len(data) < run:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    runs = len(data) // run + 1
    far = np.array([pow(powers.base, run * k, 1 << 64) for k in range(runs)], np.uint64)
    back = np.array([pow(powers.inverse, run * k, 1 << 64) for k in range(runs)], np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    for k, at in enumerate(range(0, len(data), run)):
        sums = data[at:at + run].astype(np.uint64)
        sums += np.uint64(1)
        sums *= up[: len(sums)]
        sums *= far[k]
        total[at + 1:at + 1 + len(sums)] = np.cumsum(sums, out=sums) + total[at]
    return mixed((total[ends] - total[starts]) * (down[starts % run] * back[starts // run]) + (ends - starts).astype(np.uint64))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether spans a[k] and b[k] are the same bytes, for all k."""
    sizes = ends[a] - starts[a]
    if (sizes != ends[b] - starts[b]).any():
        return False
    for k in np.flatnonzero(sizes > LONG_SPAN):
        if not np.array_equal(data[starts[a[k]]: ends[a[k]]], data[starts[b[k]]: ends[b[k]]]):
            return False
    few = np.flatnonzero(sizes <= LONG_SPAN)
    whole = np.cumsum(sizes[few])
    for part in np.split(few, np.searchsorted(whole, np.arange(PIECE_BYTES, whole[-1], PIECE_BYTES))) if len(few) else []:
        n = sizes[part]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(starts[a[part]], n) + inside] != data[np.repeat(starts[b[part]], n) + inside]).any():
            return False
    return True


def equal_neighbours(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key that stood before, its place and the place before it that has the same key."""
    n = len(keys)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << int(n - 1).bit_length()) - 1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
    same = (packed[1:] ^ packed[:-1]) <= low
    run = np.zeros(n, bool)
    run[1:] |= same
    run[:-1] |= same
    at = np.sort((packed[run] & low).astype(np.int64))
    at = at[np.argsort(keys[at], kind="stable")]
    again = keys[at][1:] == keys[at][:-1]
    return at[1:][again], at[:-1][again]


def exact_ids(things: Iterable) -> np.ndarray:
    """A number for each distinct thing, spread over 64 bits."""
    known: dict = {}
    return mixed(np.array([known.setdefault(x, len(known)) for x in things], np.uint64))


def repeated(keys: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], bool] | None = None, things: Callable[[], Iterable] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the thing occurs twice or more; an equal one stands before it.

    ``keys`` are hashes of the things, or the things.  ``equal`` compares the things themselves wherever hashes agree; if any two differ,
    ``things`` gives all of them, and they are numbered instead of hashed.
    """
    later_at, before = equal_neighbours(keys)
    if equal and len(later_at) and not equal(later_at, before):
        later_at, before = equal_neighbours(exact_ids(things()))
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[later_at] = True
    twice[later_at] = True
    twice[before] = True
    return twice, later


def measure(texts: list[bytes], powers: Powers) -> dict[str, np.ndarray]:
    """The counts and coverages of some texts at once; texts never mix."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    text_end = np.cumsum(sizes + 1)  # each with its closing line feed
    text_start = text_end - sizes - 1
    n_texts = len(texts)

    space = _space[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    chars = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(~space & ((data & 0xC0) != 0x80), out=chars[1:])
    doc = np.searchsorted(text_end, starts, "right")
    n_words = np.bincount(doc, minlength=n_texts)
    word_chars = (chars[text_end] - chars[text_start]).astype(np.int64)
    symbols = np.zeros(len(data) + 1, chars.dtype)
    np.cumsum(_symbol[data], out=symbols[1:])

    line_end = np.flatnonzero(data == 10)
    line_start = np.r_[0, line_end[:-1] + 1]
    line_doc = np.searchsorted(text_end, line_start, "right")
    line_chars = (chars[line_end] - chars[line_start]).astype(np.int64)
    salt = mixed(np.arange(1, n_texts + 1, dtype=np.uint64))
    some = np.flatnonzero(line_chars)
    at, to, of = line_start[some], line_end[some], line_doc[some]
    _, later = repeated(
        mixed(span_hashes(data, at, to, powers) ^ salt[of]),
        lambda a, b: bool((of[a] == of[b]).all()) and same_bytes(data, at, to, a, b),
        lambda: ((d, data[i:j].tobytes()) for d, i, j in zip(of.tolist(), at, to)))
    n_dup_lines = np.bincount(line_doc[some], later, n_texts).astype(np.int64)
    dup_line_chars = np.bincount(line_doc[some], later * line_chars[some], n_texts)

    size = (chars[ends] - chars[starts]).astype(np.int64)
    word = span_hashes(data, starts, ends, powers)
    if not same_bytes(data, starts, ends, *equal_neighbours(word)):
        word = exact_ids(data[i:j].tobytes() for i, j in zip(starts, ends))
    rolled, cover, n = word.copy(), {}, 1
    with np.errstate(over="ignore"):
        for n in range(2, max(LIMITS) + 1):
            rolled = rolled[:-1] * WORD_BASE + word[n - 1:] if len(rolled) > 1 else rolled[:0]
            if n != 3 and n not in LIMITS:
                continue
            inside = np.flatnonzero(doc[: len(rolled)] == doc[n - 1:]) if len(rolled) else np.zeros(0, np.int64)
            twice, later = repeated(
                mixed(rolled[inside] ^ salt[doc[inside]]),
                lambda a, b: bool((doc[inside[a]] == doc[inside[b]]).all()) and all((word[inside[a] + k] == word[inside[b] + k]).all() for k in range(n)),  # noqa: B023
                lambda: ((doc[i], *word[i: i + n].tolist()) for i in inside))  # noqa: B023
            at = inside[twice if n == 3 else later]
            step = np.bincount(at, minlength=len(word) + 1) - np.bincount(at + n, minlength=len(word) + 1)
            covered = np.cumsum(step)[:-1] > 0
            cover[n] = np.bincount(doc, covered if n == 3 else covered * size, n_texts)
    whole = np.maximum(word_chars, 1)
    excess = np.array([cover[n] / whole - most for n, most in LIMITS.items()])
    lines = dup_line_chars / whole
    n_repeat = cover[3].astype(np.int64)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": (symbols[text_end] - symbols[text_start]).astype(np.int64),
        "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed,
        "kept": ~failed & (excess.max(0) <= 0) & (lines <= LINE_LIMIT),
        "dup_line_share": lines, "max_excess": excess.max(0), "worst_n": np.array(list(LIMITS), np.int32)[excess.argmax(0)],
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for piece in pieces(batches, "text", PIECE_BYTES):
        texts = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
        found = measure(texts, powers)
        yield pa.record_batch([piece.column("doc_id").cast(pa.int64())] + [pa.array(found[f.name], f.type) for f in list(SCHEMA)[1:]], schema=SCHEMA)


def repetition(docs: DataFrame) -> DataFrame:
    """The counts, coverages and verdict of each document; one pass over the table, no shuffle."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_measured, DDL)


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
