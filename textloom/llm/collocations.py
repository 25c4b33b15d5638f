"""Phrase collocations from vertical positional inverted lists.

Texts are cut into blocks of some megabytes, a language in each, and a block keeps for each of its words the sorted list of the
word's positions (a piece's end takes a position of its own, so nothing adjoins across it).  A frequent phrase of m words is extended by merging its
positions with those of the phrases of m words that begin one word later, the postings of its neighbours (for m = 1, of adjacent words): where a place and the next one meet, the longer phrase stands,
and the length of its list is its exact frequency in the block.  Lists stay with their block; only numbers of occurrences are summed over blocks,
and phrases below the least frequency go before the next level, since a part of a phrase is as frequent as the phrase at least.

Blocks hand over counts first, and lists only of pairs that a bit table of fixed size (``BITS``) of the frequent pairs doesn't rule out; where the lists meet
the frequent pairs, exactly those stay.  Both are dealt by a hash of the pair, a row for each block and part instead of one for each pair; a frequent pair has an entry of each block at
most, so none is hot.  Candidates, their parts and the ranking are joins and range partitions.  The driver sees that bit table and the number of blocks only.

Defined results: a null text is empty and a null language is ``und``; a text without words adds nothing; repeated rows, repeated and null
ids count as often as they stand; ties are ranked by the phrase's bytes; an empty table gives an empty result; other columns are ignored,
whatever their names.  A long text is cut at the ends of its pieces, so memory is needed for a block or the longest piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, pieces, prefix_sums, small_batches, table, written

LEAST = 100
LONGEST = 5
BEST = 2000
#: Bytes of text in a block.
BLOCK = 8 << 20
#: Blocks' worth of text that a task holds for all languages together.
HELD = 4
#: Bits of the table that tells frequent pairs; more pairs than that only make it less use.
BITS = 1 << 23
#: Parts that pairs are dealt to, at least; with more than four times as many blocks there are more.
PARTS = 32
#: Bits of a word's number in its block, and of a block's number in its task; the task's number takes the next twenty.
_CODE, _NUMBER = 27, 16
#: Lower-cases A-Z and turns what ends a piece into full stops, which no word can hold then.
_FOLDED = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def varints(values: np.ndarray) -> bytes:
    """Unsigned numbers, seven bits a byte, the last byte of each below 128."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 5):
        width += values >= np.uint64(1 << 7 * k)
    end = np.cumsum(width)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = width > k
        more = (width[has] > k + 1).astype(np.uint8) << 7
        out[end[has] - width[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def from_varints(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        at = first + k
        has = at <= last
        out[has] |= (raw[at[has]] & 127).astype(np.int64) << 7 * k
    return out


def _gaps(lengths: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Positions of each list as differences, the first as it is."""
    gaps = np.diff(positions, prepend=0)
    starts = np.cumsum(lengths) - lengths
    gaps[starts] = positions[starts]
    return gaps


def _ungapped(lengths: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps)
    starts = np.cumsum(lengths) - lengths
    return total - np.repeat(total[starts] - gaps[starts], lengths) if len(lengths) else total


def _binary(lengths: np.ndarray, positions: np.ndarray) -> pa.Array:
    """A packed list of gaps for each length."""
    gaps = _gaps(lengths, positions)
    packed = np.frombuffer(varints(gaps), np.uint8)
    ends = np.flatnonzero(packed < 128) + 1
    offsets = np.r_[0, ends[np.cumsum(lengths) - 1]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])


def inverted(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a folded text, the lengths of their position lists and the lists."""
    found = pc.ascii_split_whitespace(pa.array([b". " + text.replace(b".", b" . ")], pa.binary()).cast(pa.string())).flatten()
    found = found.filter(pc.greater(pc.binary_length(found), 0)).dictionary_encode()
    codes = found.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    lengths = np.bincount(codes, minlength=len(found.dictionary))
    return found.dictionary.slice(1), lengths[1:], order[lengths[0]:]  # the first is the full stop


def _inverted_blocks(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << _NUMBER
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            """A row for each word, and one with all lists, of which the n-th is that of word n."""
            nonlocal block
            words, lengths, positions = inverted(b".".join(held.pop(lang)))
            size.pop(lang)
            n = len(words)
            if n:
                yield pa.record_batch(
                    [pa.array(np.full(n, block)), pa.array([lang] * n, pa.string()), words, pa.array(np.arange(n, dtype=np.int32)), pa.array(lengths), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _BLOCK_COLUMNS)
                packed = [lengths.astype(np.int64).tobytes()], [varints(_gaps(lengths, positions))]
                yield pa.record_batch([pa.array([block]), *(pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())), *(pa.array(x, pa.binary()) for x in packed)], _BLOCK_COLUMNS)
                block += 1

        for piece in pieces(batches, "text", most):
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()):
                text = text.translate(_FOLDED)
                while text:
                    cut = text.find(b".", most) if len(text) > most else -1
                    now, text = (text, b"") if cut < 0 else (text[:cut], text[cut:])
                    held.setdefault(lang, []).append(now)
                    size[lang] = size.get(lang, 0) + len(now)
                    if size[lang] >= most:
                        yield from rows(lang)
                    elif sum(size.values()) >= HELD * most:  # many languages in one task
                        yield from rows(max(size, key=size.__getitem__))
        for lang in list(held):
            yield from rows(lang)

    return run


_BLOCK_COLUMNS = ["block", "lang", "word", "code", "n", "lengths", "gaps"]


def inverted_blocks(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """For each block a row for each word (block, lang, word, code, n) and a row with all position lists (block, lengths, gaps)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(_inverted_blocks(most), "block long, lang string, word string, code int, n long, lengths binary, gaps binary")


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers by the significance of their bytes, which compresses well in a shuffle."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _slices(gaps: bytes, lengths: np.ndarray, chosen: np.ndarray) -> bytes:
    """Of packed lists the chosen ones."""
    ends = np.flatnonzero(np.frombuffer(gaps, np.uint8) < 128)[np.cumsum(lengths) - 1] + 1  # of each list in bytes
    starts = np.r_[0, ends[:-1]]
    return b"".join(gaps[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist()))


def _row(names: list[str], kinds: list[pa.DataType], *values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names)


_BLOCKS = "block long, ids binary, lengths binary, gaps binary"
_BLOCK = ["block", "ids", "lengths", "gaps"], [pa.int64()] + [pa.binary()] * 3


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's lists those with an id."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], np.int64)
            codes, ids = np.array([x["code"] for x in row["chosen"]], np.int64), np.array([x["id"] for x in row["chosen"]], np.int64)
            yield _row(*_BLOCK, row["block"], planes(ids), planes(lengths[codes]), _slices(row["gaps"], lengths, codes))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one row for each block."""
    block, held = None, []

    def out() -> pa.RecordBatch:
        return _row(*_BLOCK, block, *(planes(np.concatenate([from_planes(h[k]) for h in held])) for k in (0, 1)), b"".join(h[2] for h in held))

    for batch in batches:
        for b, *rest in zip(*(batch.column(c).to_pylist() for c in _BLOCK[0])):
            if b != block:
                if held:
                    yield out()
                block, held = b, []
            held.append(rest)
    if held:
        yield out()


def extended(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's phrases of m words those of m + 1: ids of their first and of their last m words, lengths of their lists, and the lists."""
    lengths, ids = from_planes(row["lengths"]), from_planes(row["ids"])
    positions = _ungapped(lengths, from_varints(row["gaps"]))
    order = np.argsort(positions, kind="stable")  # merges the lists; one phrase of m words at most begins at a position
    at, of = positions[order], np.repeat(np.arange(len(lengths)), lengths)[order]
    meet = np.flatnonzero(at[1:] == at[:-1] + 1)
    pair = of[meet] * len(ids) + of[meet + 1]
    order = np.argsort(pair, kind="stable")
    pair, found = pair[order], at[meet][order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    first, last = np.divmod(pair[starts], max(1, len(ids)))
    return ids[first], ids[last], np.diff(np.r_[starts, len(pair)]), found


def _mixed(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + others.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bit(ids: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(ids, others) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _dealt(ids: np.ndarray, others: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the pairs that it gets."""
    part = ((_mixed(ids, others) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    for p, at in zip(found.tolist(), np.split(order, starts[1:])):
        yield p, at


_COUNTS = ["part", "ids", "others", "n"], [pa.int32()] + [pa.binary()] * 3
_LISTS = ["part", "block", "ids", "others", "new_ids", "lengths", "gaps"], [pa.int32(), pa.int64()] + [pa.binary()] * 5


def _counted(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, others, lengths, _ = extended(row)
                for p, at in _dealt(ids, others, parts):
                    yield _row(*_COUNTS, p, planes(ids[at]), planes(others[at]), planes(lengths[at]))

    return run


def _summed(ids: np.ndarray, others: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((others, ids))
    ids, others = ids[order], others[order]
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])]) if len(ids) else np.zeros(0, np.int64)
    return ids[starts], others[starts], np.add.reduceat(n[order], starts) if len(ids) else n


def _frequent(least: int) -> Callable:
    """Rows sorted by part to the pairs of each part that are frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            ids, others, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            often = n >= least
            return pa.record_batch([pa.array(ids[often]), pa.array(others[often]), pa.array(n[often])], ["id", "other", "f"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield out()
                    part, held, size = row["part"], [], 0
                held.append(tuple(from_planes(row[c]) for c in ("ids", "others", "n")))
                size += len(held[-1][0])
                if size > 1 << 21 and size > 2 * len(held[0][0]):  # what is summed already comes first
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
        if held:
            yield out()

    return run


def _known(parts: int) -> Callable:
    """Frequent pairs as rows that stand before the lists of their part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others, new = (batch.column(c).to_numpy() for c in ("id", "other", "new_id"))
            for p, at in _dealt(ids, others, parts):
                yield _row(*_LISTS, p, -1, planes(ids[at]), planes(others[at]), planes(new[at]), None, None)

    return run


def _lists(table: bytes, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for row in batch.to_pylist():
                ids, others, lengths, positions = extended(row)
                may = bits[_bit(ids, others, len(bits))]
                ids, others, positions, lengths = ids[may], others[may], positions[np.repeat(may, lengths)], lengths[may]
                packed = _binary(lengths, positions).to_pylist() if len(ids) else []
                for p, at in _dealt(ids, others, parts):
                    yield _row(*_LISTS, p, row["block"], planes(ids[at]), planes(others[at]), None, planes(lengths[at]), b"".join(packed[i] for i in at.tolist()))

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and block, frequent pairs first, to each block's lists of frequent pairs under their new ids."""
    part, held, known = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                part, held, known = row["part"], [], None
            if row["block"] < 0:
                held.append(tuple(from_planes(row[c]) for c in ("ids", "others", "new_ids")))
                continue
            if known is None:
                ids, others, new = (np.concatenate(x) for x in zip(*held)) if held else [np.zeros(0, np.int64)] * 3
                firsts, lasts = np.unique(ids), np.unique(others)
                pair = np.searchsorted(firsts, ids) * max(1, len(lasts)) + np.searchsorted(lasts, others)
                order = np.argsort(pair)
                known, held = (firsts, lasts, pair[order], new[order]), []
            firsts, lasts, pair, new = known
            if not len(new):
                continue
            ids, others = from_planes(row["ids"]), from_planes(row["others"])
            a, b = (np.minimum(np.searchsorted(u, x), len(u) - 1) for u, x in ((firsts, ids), (lasts, others)))
            wanted = a * len(lasts) + b
            at = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
            chosen = np.flatnonzero((firsts[a] == ids) & (lasts[b] == others) & (pair[at] == wanted))
            if len(chosen):
                lengths = from_planes(row["lengths"])
                yield _row(*_BLOCK, row["block"], planes(new[at[chosen]]), planes(lengths[chosen]), _slices(row["gaps"], lengths, chosen))


def _bits_of(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_bit(batch.column("id").to_numpy(), batch.column("other").to_numpy(), bits))], ["bit"])

    return run


def bit_table(pairs: DataFrame, bits: int = BITS) -> bytes:
    """A bit for each (id, other) of ``pairs``: ``bits`` / 8 bytes (a power of two, 64 at least), whatever their number."""
    found = pairs.select("id", "other").mapInArrow(_bits_of(bits), "bit long")
    # at most bits / 64 rows
    rows = found.groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["place"]] = r["bits"]
    return out.tobytes()


def frequent_words(rows: DataFrame, least: int) -> DataFrame:
    """(block, code, id, lang, word, f) of the frequent words in each block that has them, written.  A word's id is the smallest of its places (block, code)."""
    place = F.shiftleft("block", _CODE).bitwiseOR(F.col("code").cast("long"))
    everywhere = Window.partitionBy("lang", "word")  # a row for each block that has the word
    summed = rows.select("block", "code", "lang", "word", F.sum("n").over(everywhere).alias("f"), F.min(place).over(everywhere).alias("id"))
    return written(summed.filter(F.col("f") >= least), "frequent-words")


def frequent_pairs(blocks: DataFrame, least: int, parts: int) -> DataFrame:
    """(id, other, f): pairs of phrases of m words, one word apart, that stand together ``least`` times."""
    rows = blocks.mapInArrow(_counted(parts), "part int, ids binary, others binary, n binary")
    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_frequent(least), "id long, other long, f long")


def longer_lists(blocks: DataFrame, known: DataFrame, parts: int, bits: int) -> DataFrame:
    """The blocks' lists of the pairs in ``known`` (id, other, new_id), written."""
    kinds = "part int, block long, ids binary, others binary, new_ids binary, lengths binary, gaps binary"
    rows = blocks.mapInArrow(_lists(bit_table(known, bits), parts), kinds).union(known.mapInArrow(_known(parts), kinds))
    met = rows.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_met, _BLOCKS)
    return written(met.repartition("block").sortWithinPartitions("block").mapInArrow(_gathered, _BLOCKS), "lists")


def frequent_phrases(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """(id, lang, phrase, f, last, firsts, lasts, first_id, last_id) of the frequent phrases that are one word longer than ``shorter``, written.

    ``last`` is the last word; ``firsts`` has the frequencies of the first 1, 2, ... words, ``lasts`` those of all but the first 1, 2, ... words.
    """
    found = found.select(F.col("id").alias("first_id"), F.col("other").alias("last_id"), "f")
    first = shorter.select(F.col("id").alias("first_id"), "lang", F.col("phrase").alias("first"), F.concat("firsts", F.array("f")).alias("firsts"))
    last = shorter.select(F.col("id").alias("last_id"), "last", F.concat(F.array("f"), F.col("lasts")).alias("lasts"))
    joined = found.join(first, "first_id").join(last, "last_id")
    return written(joined.select(F.monotonically_increasing_id().alias("id"), "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "f", "last", "firsts", "lasts", "first_id", "last_id"), "frequent")


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases of 2 to ``longest`` words as (lang, phrase, words, f, firsts, lasts), and (lang, n) with the number of words."""
    blocks = written(inverted_blocks(docs, block), "inverted")
    words_in = blocks.filter("word is not null")
    totals = written(words_in.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = frequent_words(words_in, least)
    none = F.array().cast("array<long>")
    own = F.col("id") == F.shiftleft("block", _CODE).bitwiseOR(F.col("code").cast("long"))
    phrases = frequent.filter(own).select("id", "lang", F.col("word").alias("phrase"), "f", F.col("word").alias("last"), none.alias("firsts"), none.alias("lasts"))
    chosen = frequent.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("code", "id")).alias("chosen"))  # as many as a block has words
    lists = blocks.filter("gaps is not null").select("block", "lengths", "gaps").join(chosen, F.col("block") == F.col("_block"))
    now = written(lists.select("block", "lengths", "gaps", "chosen").mapInArrow(_chosen, _BLOCKS), "lists")
    drop_written(blocks)
    parts = max(PARTS, now.count() // 4)
    found = None
    for m in range(2, longest + 1):
        longer = frequent_phrases(frequent_pairs(now, least, parts), phrases)
        part = longer.select("lang", "phrase", F.lit(m).alias("words"), "f", "firsts", "lasts")
        found = part if found is None else found.unionByName(part)
        if m < longest:
            known = longer.select(F.col("first_id").alias("id"), F.col("last_id").alias("other"), F.col("id").alias("new_id"))
            after = longer_lists(now, known, parts, bits)
            drop_written(now)
            now = after
        phrases = longer
    return found, totals


def _after_first(phrase: Column) -> Column:
    return F.substring(phrase, F.instr(phrase, " ") + 1, F.length(phrase))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``best`` candidates that no longer one covers.

    The score of a cut is floor(1000 a n / (l r)) in decimals of 38 digits; the lowest cut counts, then the first.  A candidate goes if a longer one that holds
    it is as frequent; such a one has a part of one word more that is as frequent too, so the parts of the next length tell all.
    """
    found, totals = candidates(docs, least, longest, block, bits)
    first = F.expr("substring_index(phrase, ' ', words - 1)")
    covered = F.array(
        F.when(F.element_at("firsts", -1) == F.col("f"), first), F.when(F.element_at("lasts", 1) == F.col("f"), _after_first(F.col("phrase"))))
    gone = found.filter("words > 2").select(F.col("lang").alias("_lang"), F.explode(covered).alias("_phrase")).filter("_phrase is not null").distinct()
    left = found.join(gone, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left_anti")
    cut = F.expr("""
        array_min(transform(sequence(1, words - 1), k -> struct(
            (cast(1000 as decimal(38,0)) * cast(f as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(firsts[k - 1] as decimal(38,0)) * cast(lasts[k - 1] as decimal(38,0))) as score,
            k as k, firsts[k - 1] as l, lasts[k - 1] as r)))""")
    scored = left.join(totals.select(F.col("lang").alias("_lang"), "n"), F.col("lang") == F.col("_lang")).withColumn("cut", cut).select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", (-F.col("cut.score")).alias("by_score"), (-F.col("f")).alias("by_a"), F.lit(1).alias("one"))
    ranked = prefix_sums(scored, "lang", ["by_score", "by_a", "phrase"], "one", "collocations")
    return ranked.filter(F.col("row") < best).select("lang", (F.col("row") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _grams_sql(m: int) -> str:
    words = " || ' ' || ".join(f"w{k}" for k in range(m))
    here = " AND ".join(f"w{k} IS NOT NULL" for k in range(m))
    return f"SELECT lang, {m} AS m, {words} AS phrase, count(*) AS f FROM t WHERE {here} GROUP BY ALL"


OP11_SQL = f"""
WITH p AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, x AS text
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)
), ws AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(text, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM p
), t AS MATERIALIZED (
  SELECT lang, {", ".join(f"ws[i + {k}] AS w{k}" for k in range(LONGEST))} FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws)
), totals AS (
  SELECT lang, count(*) AS n FROM t GROUP BY lang
), g AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS ws FROM ({" UNION ALL ".join(_grams_sql(m) for m in range(1, LONGEST + 1))}) WHERE f >= {LEAST}
), cuts AS (
  SELECT g.lang, g.phrase, g.f AS a, k, array_to_string(g.ws[1:k], ' ') AS first, array_to_string(g.ws[k + 1:], ' ') AS last
  FROM (SELECT *, unnest(range(1, m)) AS k FROM g WHERE m > 1) g
), scores AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, t.n,
         (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN g l ON l.lang = c.lang AND l.phrase = c.first JOIN g r ON r.lang = c.lang AND r.phrase = c.last JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT DISTINCT g.lang, array_to_string(g.ws[i:i + len - 1], ' ') AS phrase, g.f
  FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM g WHERE m > 2) g, range(2, {LONGEST}) x(len) WHERE len < m AND i + len - 1 <= m
), ranked AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
         CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM lowest WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = lowest.lang AND c.phrase = lowest.phrase AND 100 * c.f >= 100 * lowest.a)
)
SELECT * FROM ranked WHERE rank <= {BEST}
"""
