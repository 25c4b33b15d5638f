"""Main text of web pages by differencing each page with the pages nearest to it by URL.

1. A page becomes text lines (one for each block of markup), each with the block's container and a mark: inside an article, inside a main part, furniture
   (menu, header, footer, side bar, notice, advert, form, comments, by element or by a word of class, id or role), or none of these.
2. The different pages of a host are sorted by URL path.  Of the one before and the one after, the one that shares the longer
   beginning of the path is the nearest (ties: the one before); one that shares over half of a page's text is a copy and tells nothing
   about furniture, so the other is taken.  The lines of the two are aligned by longest common subsequence.
3. Where a page marks its article or main part, that is the text, less the furniture inside (the articles alone, if they hold a half of the main part's text at least).  Elsewhere furniture and the lines shared with the
   nearest page are deleted; a shared line stays if lines of the same container that aren't shared stand before and after it (a quotation in an article).

Only hashes of lines are sorted by URL; texts are shuffled once, without furniture, to meet the numbers of the lines that stay.

Defined results: a null html has no lines and an empty text; a null url is a host of its own with an empty path; pages with the same host and
the same marked lines get one decision and never are each other's neighbours (so copies of a page don't erase it); repeated rows, repeated
and null page_ids are rows of their own; without a neighbour nothing counts as shared; an empty table gives an empty result; other columns are ignored,
whatever their names.  Whole pages are read: a page needs memory for its text and, while it is aligned, ``CELLS`` / 8 bytes.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, skew_join, small_batches, table, written

ARTICLE, MAIN, OPEN, FURNITURE = 3, 2, 1, 0
#: Cells of the alignment of two pages that are held at once, a bit each; larger ones are halved first.
CELLS = 1 << 28
#: Over this share of a page's characters a neighbour is a copy.
COPY = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE_TAGS = frozenset("head nav footer aside form button select option fieldset input menu dialog noscript template iframe object svg canvas audio video map script style title textarea".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of class and id that name furniture.
_FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead banner footer sidebar sidebars aside ad ads adbox adslot advert adverts advertisement advertisements advertising"
    " sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay alert newsletter subscribe subscription signup login signin"
    " social share sharing related recommended recommendations pagination pager copyright colophon skip widget widgets toolbar topbar rail search form forms announcement disclaimer paywall toast snackbar".split())
_COMMENT_WORDS = frozenset("comment comments commentlist commentary respond reply replies responses disqus discussion".split())
#: With these, a class only says whether there may be comments.
_ABOUT_COMMENTS = frozenset("open closed no has with without count enabled disabled allowed".split())
_HEADER_WORDS = frozenset(["header", "headers"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_EXEMPT = frozenset("html body main".split())
_BEFORE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that ends an open one of the same group, unless one of the others stands between them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHOLE, _NAME = re.compile(r"[A-Za-z]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")  # of sideBar: sidebar; side and bar


def _marked(tag: str, attributes: str, mark: int, in_header: bool) -> tuple[int, bool]:
    """The mark of an element's content and whether it is a header, of which an article keeps the headings."""
    if mark == FURNITURE:
        return mark, in_header
    if tag in _FURNITURE_TAGS:
        return FURNITURE, in_header
    found = {}
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    named = {w.lower() for k in ("class", "id") if k in found for w in (*_WHOLE.findall(found[k]), *_NAME.findall(found[k]))}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return FURNITURE, in_header
    if named & _COMMENT_WORDS and not named & _ABOUT_COMMENTS and tag not in _EXEMPT:
        return FURNITURE, in_header
    if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower():
        return ARTICLE, False
    if tag == "main" or role == "main":
        return max(mark, MAIN), False
    if tag in _EXEMPT or tag in _HEADINGS:
        return mark, in_header
    if role in _FURNITURE_ROLES or named & _FURNITURE_WORDS:
        return FURNITURE, in_header
    if tag == "header" or named & _HEADER_WORDS:
        return (ARTICLE, True) if mark == ARTICLE else (FURNITURE, False)  # a page's own header stands outside of the article, also in its main part
    return mark, in_header


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, mark, number of the container) for each block of a page that has text, in order."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool, int]] = [("", OPEN, False, 0)]  # tag, mark, in a header, own number
    opened, at, size = 0, 0, len(page)

    def flush() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                _, mark, in_header, own = stack[-1]
                block = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] not in _INLINE), 0)
                if in_header and not any(s[0] in _HEADINGS for s in stack):
                    mark = FURNITURE
                out.append((text, mark, stack[max(0, block - (stack[block][0] not in ("div", "section", "article", "main", "body")))][3]))

    def shut(k: int) -> None:
        flush()
        del stack[k:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in _INLINE and stack[k][1] == stack[k - 1][1]:
                        del stack[k]  # formatting: what it holds goes on
                    else:
                        shut(k)
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            if tag not in _INLINE:
                flush()
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else size
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
            if tag in _BEFORE_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        shut(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            elif tag in _ENDS:
                ended, kept = _ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        shut(k)
                        break
                    if stack[k][0] in kept:
                        break
        _, mark, in_header, _ = stack[-1]
        now, header = _marked(tag, m[3], mark, in_header)
        if inline and now != mark:
            flush()
        opened += 1
        stack.append((tag, now, header, opened))
    flush()
    return out


def _row(matches: dict, line: list, width: int) -> int:
    full = (1 << width) - 1
    row = full
    for x in line:
        hit = row & matches.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def _places(line: list) -> dict:
    found: dict = {}
    for j, x in enumerate(line):
        found[x] = found.get(x, 0) | 1 << j
    return found


def _lengths(row: int, width: int) -> np.ndarray:
    """Lengths of the common subsequence with the first 0, 1, ... items: the zero bits of the row so far."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((width + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:width]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_subsequence(a: list, b: list, cells: int = CELLS) -> list[int]:
    """Indices of ``a`` in a longest common subsequence of ``a`` and ``b``.

    Bit-parallel rows, a bit for each pair of lines; where there are more than ``cells`` of them, ``a`` is halved and ``b`` cut where the halves' lengths add up to most.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    there = set(y)
    own = [i for i, v in enumerate(x) if v in there]  # lines that the other page hasn't can't match
    x = [x[i] for i in own]
    there = set(x)
    y = [v for v in y if v in there]
    out: list[int] = []
    if x and y:
        if len(x) * len(y) > cells and len(x) > 1:
            half = len(x) // 2
            first = _lengths(_row(_places(y), x[:half], len(y)), len(y))
            last = _lengths(_row(_places(y[::-1]), x[:half - 1:-1], len(y)), len(y))
            cut = int(np.argmax(first + last[::-1]))
            out = common_subsequence(x[:half], y[:cut], cells) + [half + i for i in common_subsequence(x[half:], y[cut:], cells)]
        else:
            matches, full = _places(y), (1 << len(y)) - 1
            rows = [full]
            for v in x:
                hit = rows[-1] & matches[v]
                rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
            i, j = len(x), len(y)
            while i and j:
                if x[i - 1] == y[j - 1]:
                    i, j = i - 1, j - 1
                    out.append(i)
                elif rows[i] >> (j - 1) & 1:  # no longer than without this line of b
                    j -= 1
                else:
                    i -= 1
            out.reverse()
    return [*range(head), *(head + own[i] for i in out), *range(len(a) - tail, len(a))]


def _packed(host: str, lines: list[tuple[str, int, int]]) -> tuple[bytes, bytes]:
    """The page's hashes, lengths, containers and marks as bytes, and the key of its host and these."""
    n = len(lines)
    hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _, _ in lines), np.uint64, n)
    chars, container = np.fromiter((len(t) for t, _, _ in lines), np.int32, n), np.fromiter((c for _, _, c in lines), np.int32, n)
    packed = hashes.tobytes() + chars.tobytes() + container.tobytes() + bytes(m for _, m, _ in lines)
    return packed, hashlib.blake2b(host.encode("utf-8", "surrogatepass") + b"\0" + packed, digest_size=16).digest()


def _unpacked(packed: bytes) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    n = len(packed) // 17
    cut = [0, 8 * n, 12 * n, 16 * n]
    hashes, chars, container = (np.frombuffer(packed[a:b], kind) for a, b, kind in zip(cut, cut[1:], (np.uint64, np.int32, np.int32)))
    return hashes.tolist(), chars, container, np.frombuffer(packed[16 * n:], np.uint8)


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept_lines(packed: bytes, path: str, neighbours: list[tuple[str, bytes]]) -> tuple[list[int], int]:
    """Numbers (among the lines that aren't furniture) of the lines that stay, and how many lines the nearest page shares."""
    hashes, chars, container, mark = _unpacked(packed)
    n = len(hashes)
    shared = np.zeros(n, bool)
    plain = mark != FURNITURE
    for _, other in sorted(neighbours, key=lambda o: -_shared_prefix(path, o[0])):
        same = np.zeros(n, bool)
        same[common_subsequence(hashes, _unpacked(other)[0])] = True
        if chars[same & plain].sum() <= COPY * chars[plain].sum():
            shared = same
            break
    article, main = mark == ARTICLE, mark >= MAIN
    if main.any():
        stays = article if 2 * chars[article].sum() >= chars[main].sum() else main  # else the articles are teasers beside the text
    else:
        own = plain & ~shared
        first, last = np.full(n, n), np.full(n, -1)
        for c in np.unique(container[own]):
            at = np.flatnonzero(own & (container == c))
            first[container == c], last[container == c] = at[0], at[-1]
        place = np.arange(n)
        stays = own | (plain & (first < place) & (place < last))
    return np.flatnonzero(stays[plain]).tolist(), int(shared.sum())


def _parsed(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "html", 8 << 20):
        packs, keys, lines = [], [], []
        for page, host in zip(piece.column("html").to_pylist(), piece.column("host").to_pylist()):
            found = page_lines(page or "")
            packed, key = _packed(host, found)
            packs.append(packed)
            keys.append(key)
            if texts:
                lines.append([t for t, m, _ in found if m != FURNITURE])
        key = pa.array(keys, pa.binary())
        if texts:
            yield pa.record_batch([piece.column("page_id"), piece.column("url"), key, pa.array(lines, pa.list_(pa.string()))], ["page_id", "url", "key", "lines"])
        else:
            yield pa.record_batch([piece.column("host"), piece.column("path"), key, pa.array(packs, pa.binary())], ["host", "path", "key", "packed"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, shared = [], []
        columns = [batch.column(c).to_pylist() for c in ("packed", "path", "before_path", "before", "after_path", "after")]
        for packed, path, *near in zip(*columns):
            numbers, n = kept_lines(packed, path, [(p, x) for p, x in (near[:2], near[2:]) if x is not None])
            kept.append(numbers)
            shared.append(n)
        yield pa.record_batch([batch.column("key"), batch.column("n"), pa.array(kept, pa.list_(pa.int32())), pa.array(shared, pa.int32())], ["key", "n", "kept", "n_shared"])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without port) and the path with query, without fragment; empty strings for a null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":[0-9]*$", ""), F.regexp_extract(bare, "^[^/?]*(.*)$", 1)


def nearest_pages(pages: DataFrame) -> DataFrame:
    """Each different page with the one before and the one after by URL path in its host, and the number ``n`` of its copies.

    ``pages`` has host, path, key and packed.  Range partitions spread a host with a third of all pages; at their edges one row for each host and partition is carried over.
    """
    different = pages.groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("n"), F.any_value("packed").alias("packed"))
    place = ["path", "key"]
    ranged = written(different, "pages").repartitionByRange("host", *place).withColumn("part", F.spark_partition_id())
    stored = written(ranged, "pages-by-url")
    page = F.struct("path", "packed")
    inside = Window.partitionBy("part", "host").orderBy(*place)
    edges = stored.groupBy("part", "host").agg(F.min_by(page, F.struct(*place)).alias("first"), F.max_by(page, F.struct(*place)).alias("last"))
    over = Window.partitionBy("host").orderBy("part")
    carried = edges.select(F.col("part").alias("_part"), F.col("host").alias("_host"), F.lag("last").over(over).alias("_before"), F.lead("first").over(over).alias("_after"))
    near = stored.withColumns({"b": F.lag(page).over(inside), "a": F.lead(page).over(inside)})
    joined = near.join(carried, (F.col("part") == F.col("_part")) & (F.col("host") == F.col("_host")))
    before, after = F.coalesce("b", "_before"), F.coalesce("a", "_after")
    return joined.select("key", "n", "path", "packed", before["path"].alias("before_path"), before["packed"].alias("before"), after["path"].alias("after_path"), after["packed"].alias("after"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_kept, n_shared) for each row of ``pages``, which has page_id, url and html.

    n_lines counts the lines that aren't furniture, n_kept those that stay, n_shared those (furniture too) that the nearest page shares.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    keyed = rows.select("html", "host", "path").mapInArrow(lambda b: _parsed(b, False), "host string, path string, key binary, packed binary")
    kinds = "key binary, n long, kept array<int>, n_shared int"
    decisions = written(nearest_pages(keyed).mapInArrow(_decided, kinds), "kept-lines")
    texts = rows.select("page_id", "url", "html", "host").mapInArrow(lambda b: _parsed(b, True), "page_id long, url string, key binary, lines array<string>")
    total = decisions.agg(F.sum("n")).first()[0] or 0
    text = F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), " ")
    return skew_join(texts, decisions, "key", total).select("page_id", "url", text.alias("text"), F.size("lines").alias("n_lines"), F.size("kept").alias("n_kept"), "n_shared").select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_kept", "n_shared")


def op13_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
