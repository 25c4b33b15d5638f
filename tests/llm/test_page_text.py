"""Main text of pages: parser cases, alignment and neighbours against brute force."""

import random
from collections import defaultdict

import pytest

from textloom.llm import page_text

DDL = "page_id long, url string, html string, text string, key string, host string, n long"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 16))] for _ in range(2))
        for cells in (1 << 20, 16, 1):
            found = page_text.common_subsequence(a, b, cells)
            rest = iter(b)
            assert len(found) == longest(a, b) and found == sorted(set(found))
            assert all(any(a[i] == y for y in rest) for i in found)
    many = list(range(5000))
    assert page_text.common_subsequence(many, many[::2] + [9, 9], 1 << 16) == many[::2]
    assert len(page_text.common_subsequence([1, 2] * 1500, [2, 1] * 1500, 1 << 16)) == 2999


@pytest.mark.parametrize("page, want", [
    ("", []),
    ("plain &amp; simple\n text", [("plain & simple text", 1)]),
    ("<p>a<p>b<b>c</b>d<br>e &lt;i&gt; &#233;&nbsp;f", [("a", 1), ("bcd", 1), ("e <i> é f", 1)]),
    ("<article><header><h1>Head</h1><p>by line</p></header><p>x</p></article><p>out</p>", [("Head", 3), ("by line", 0), ("x", 3), ("out", 1)]),
    ("<header><h1>Site</h1></header><main><nav><a>m</a></nav><p>t</p><footer>f</footer></main>", [("Site", 0), ("m", 0), ("t", 2), ("f", 0)]),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><title>t</title><p>a</p><!-- <p>no</p> --><textarea><p>no</textarea>b", [("a", 1), ("b", 1)]),
    ("<ul><li class='ad'>x<li>y</ul><div id=sideBar>s</div><div class='article-body ad_slot'>z</div>", [("x", 0), ("y", 1), ("s", 0), ("z", 0)]),
    ("<article class=comment>c</article><article>d<section id=comments><p>e</p></section></article>", [("c", 0), ("d", 3), ("e", 0)]),
    ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div><div aria-hidden=true>a</div>k", [("n", 0), ("h", 0), ("s", 0), ("a", 0), ("k", 1)]),
    ("<p title='a > b'>in</p><p title=don't>it's</p><div class=\"x", [("in", 1), ("it's", 1)]),
    ("<body class='has-sidebar menu'><article class='post ad'>t</article>a < b &copy 1 <3", [("t", 3), ("a < b © 1 <3", 1)]),
    ("<p>one</i>two<em>three</p>four", [("onetwothree", 1), ("four", 1)]),
    ("<article><p><b>first<br><p>second</p></article><footer>f</footer>", [("first", 3), ("second", 3), ("f", 0)]),
    ("<main><div class=topbar>x</div><p>m</p><article><p>a</p></article></main>", [("x", 0), ("m", 2), ("a", 3)]),
    ("<div class='post comments-open'><p>t</p><section class=reader-comments><p>c</p></section><ol id=commentlist><li>d</ol></div>", [("t", 1), ("c", 0), ("d", 0)]),
    ("<article class='entry has-comments'>t</article><article class='comment byuser'>c</article>", [("t", 3), ("c", 0)]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", [("a", 1), ("b", 1), ("c", 1)]),
    ("<!-->a<!---->b<?php x ?>c</3>d", [("abcd", 1)]),
])
def test_lines(page, want):
    assert [(t, m) for t, m, _ in page_text.page_lines(page)] == want


def test_odd_markup_ends():
    rng = random.Random(5)
    parts = ["<", ">", "</", "<p", "'", '"', "=", "<!--", "-->", "<script>", "</script>", "<div class=", "&amp;", "a", " ", "<b>", "</b>", "</p>", "<td>", "é"]
    for _ in range(500):
        page_text.page_lines("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))))
    assert page_text.page_lines("<p '" * 20_000 + ">") == []


def brute(data):
    """The contract in plain Python: different pages of a host in the order of (path, key), nearest first, and the rule for lines."""
    def parts(url):
        bare = (url or "").strip(" ").split("#")[0]
        bare = bare.split("://", 1)[1] if "://" in bare else bare
        host = bare.replace("?", "/").split("/")[0]
        return host.lower(), bare[len(host):]

    hosts, own = defaultdict(dict), []
    for _, url, html, *_ in data:
        host, path = parts(url)
        lines = page_text.page_lines(html or "")
        key = page_text._packed(host, lines)[1]
        hosts[host][key] = min(path, hosts[host].get(key, (path,))[0]), lines
        own.append((host, key))
    out = []
    for (page_id, url, *_), (host, key) in zip(data, own):
        order = sorted(hosts[host], key=lambda k: (hosts[host][k][0], k))
        at, (path, lines) = order.index(key), hosts[host][key]
        near = [hosts[host][order[i]] for i in (at - 1, at + 1) if 0 <= i < len(order)]
        prefix = lambda other: next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
        shared = set()
        for other, theirs in sorted(near, key=lambda o: -prefix(o[0])):
            found = set(page_text.common_subsequence([t for t, _, _ in lines], [t for t, _, _ in theirs]))
            if 2 * sum(len(lines[i][0]) for i in found if lines[i][1]) <= sum(len(t) for t, m, _ in lines if m):
                shared = found
                break
        size = lambda least: sum(len(t) for t, m, _ in lines if m >= least)
        if any(m >= 2 for _, m, _ in lines):
            kept = [t for t, m, _ in lines if m >= (3 if 2 * size(3) >= size(2) else 2)]
        else:
            alone = [i for i, (_, m, _) in enumerate(lines) if m and i not in shared]
            kept = [t for i, (t, m, c) in enumerate(lines) if m and (i in alone or (any(j < i and lines[j][2] == c for j in alone) and any(j > i and lines[j][2] == c for j in alone)))]
        out.append((page_id, url, " ".join(kept), len(" ".join(kept)), len(shared)))
    return out


def plain_pages(seed, n):
    """Pages without an article element: a menu and a foot that hosts share, and quoted lines in between."""
    rng = random.Random(seed)
    word = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(k))
    menus = [[word(2) for _ in range(4)] for _ in range(4)]
    quotes = [word(12) for _ in range(3)]
    out = []
    for i in range(n):
        h = rng.choice([0, 0, 0, 1, 2, 3])
        body = [word(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.6:
            body.insert(rng.randint(0, len(body)), rng.choice(quotes))
        if rng.random() < 0.1 and out:
            body = [out[-1][3]]
        page = "<div>" + "".join(f"<a>{m}</a><br>" for m in menus[h]) + "</div><div>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div>about {h}</div>"
        if i % 7 == 0:
            page = f"<nav>x</nav><article><p>{quotes[0]}</p><p>{body[0]}</p></article><p>{menus[h][0]}</p>"
        out.append((i, f"http://Host{h}.org/a/{rng.randint(0, 30)}?q={i % 3}#top", page, "t", "k", "h", 1))
    return out


def test_against_brute_force(spark):
    data = plain_pages(1, 120)
    data += [(500, None, data[0][2], "t", "k", "h", 1), (501, None, data[1][2], None, None, None, None), (502, "http://host1.org", None, "t", "k", "h", 1), (503, "", "", "t", "k", "h", 1),
             data[5], (data[6][0], data[7][1], data[8][2], "t", "k", "h", 1), (None, data[9][1], data[10][2], "t", "k", "h", 1), (504, data[3][1] + "9", data[3][2], "t", "k", "h", 1),
             (505, "host9/x", "<p>" + "very long " * 60_000, "t", "k", "h", 1)]
    found = [(r["page_id"], r["url"], r["text"], r["n_chars"], r["n_shared"]) for r in page_text.main_text(spark.createDataFrame(data, DDL).repartition(5)).collect()]
    order = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(found, key=order) == sorted(brute(data), key=order)
    assert sum(r[4] > 0 for r in found) > 60


def test_shared_menu_goes_and_quotation_stays(spark):
    page = "<div><a>Home</a><br><a>News</a></div><div><p>{}</p><p>as they say, all is well</p><p>{}</p></div><div>Imprint</div>"
    data = [(i, f"http://h/{i}", page.format(f"first words of {i} and more of them", f"last words of {i} and more of them"), "t", "k", "h", 1) for i in range(4)]
    for r in page_text.main_text(spark.createDataFrame(data, DDL)).collect():
        assert r["text"] == f"first words of {r['page_id']} and more of them as they say, all is well last words of {r['page_id']} and more of them"


def test_copies_do_not_erase_each_other(spark):
    page = "<div>Home</div><div><p>the same article, word for word, under each address</p></div>"
    data = [(i, f"http://h/{i}", page, "t", "k", "h", 1) for i in range(50)]
    assert {r["text"] for r in page_text.main_text(spark.createDataFrame(data, DDL).repartition(4)).collect()} == {"Home the same article, word for word, under each address"}


def test_empty(spark):
    assert page_text.main_text(spark.createDataFrame([], DDL)).count() == 0


PAGE = """<!DOCTYPE html><html lang=en class="js no-comments"><head><title>T</title><style>.ad{{}}</style><script>var x = "<article>no</article>";</script></head><body class="single sidebar-right">
<header class="site-header"><h1>The Daily</h1><nav><ul><li>Home<li>World</ul></nav></header><div id="cookieNotice">We use cookies</div><div class="alert alert-info">Notice</div>
{open}<header><h1>Head &amp; line</h1><p class="byline">by A</p></header><p>First <b>bold</b>
 words.<p>Second<br>line</p><div class="advert">Buy</div><figure><img src=x><figcaption>Caption</figcaption></figure><blockquote>Quote</blockquote>
<table><tr><td>1<td>2</table><form><label>Mail</label><input><button>Go</button></form><aside>See also</aside><ul><li>one</li><li>two</li></ul><div class="share-buttons">Share</div>{close}
<section id="comments"><h2>Comments</h2><div class="comment">Nice</div><article class="comment">Bad</article></section><div class="sidebar"><p>Popular</p></div><form>Search</form><footer>(c) <p>Imprint</p></footer></body></html>"""


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"), ("<main id=content><div itemprop='articleBody'>", "</div></main>")])
def test_a_whole_page(spark, open_, close):
    rows = [(1, "http://h/1", PAGE.format(open=open_, close=close), "t", "k", "h", 1)]
    assert page_text.main_text(spark.createDataFrame(rows, DDL)).first()["text"] == "Head & line First bold words. Second line Caption Quote 1 2 one two"


def test_teasers_beside_the_text(spark):
    page = "<main><p>" + "the long text of the page " * 10 + "</p><article>teaser</article></main>"
    found = page_text.main_text(spark.createDataFrame([(1, "http://h/1", page, "t", "k", "h", 1)], DDL)).first()
    assert found["text"].startswith("the long text") and found["text"].endswith("teaser")
