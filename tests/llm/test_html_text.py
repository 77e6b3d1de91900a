import time

import duckdb
import numpy as np
import pytest

from quire.llm import html_text as ht

LONG = "A long paragraph that says a good deal about its subject, and then says a little more of it, so that it is plainly text."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item number {i}</a></li>' for i in range(8)) + "</ul>"

PAGES = {
    "article": (f"<body><nav>{MENU}</nav><article><h1>Head &amp; line</h1><p>{LONG}<p>Two&nbsp;\n words<br>more</article><footer>&copy; x</footer>", ["Head & line", LONG, "Two words more"]),
    "containers": (f'<div id="wrap"><div class="site-header"><h1>Site</h1></div><div id="content"><h2>T</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div><div id="footer">f</div></div>', ["T", LONG, "Short.", LONG]),
    "main": (f'<header><h1>Site</h1></header><div role="main"><header><h1>Title</h1></header><p>{LONG}</p><aside>{LONG}</aside><form><p>Write to us</p><input></form><p>{LONG}</p></div>', ["Title", LONG, LONG]),
    "comments": (f'<main><article><h1>T</h1><p>{LONG}</p></article><section id="comments"><h2>Comments</h2><article>{LONG}</article><article class="comment"><p>{LONG}</p></article></section></main>', ["T", LONG]),
    "notices": (f'<div class="cookie-consent"><p>{LONG}</p></div><article><p class="notice">Note</p><p>{LONG} <span class="ad">Buy</span></p><div class="related-posts"><p>{LONG}</p></div></article>', [LONG]),
    "wrapped": (f'<form id="aspnet"><div class="has-sidebar no-banner"><article><p>{LONG}</p><p>x</p></article></div></form>', [LONG, "x"]),
    "scripts": (f'<head><title>t</title><style>p{{}}</style></head><body><script>var a="</p><p>no</p>";</script><noscript>no</noscript><article><p>{LONG}</p><template><p>no</p></template><!-- no --><svg><text>no</text></svg></article>', [LONG]),
    "lists": (f'<article><p>{LONG}</p><ul><li>One<li>Two <a href="x">link</a></ul><p>{LONG}</p><table><tr><td>a<td>b</table></article>', [LONG, "One", "Two link", LONG, "a", "b"]),
    "hidden": (f'<article><p>{LONG}</p><p style="display: none">no</p><div hidden>no</div><p aria-hidden="true">no</p></article>', [LONG]),
    "plain": ("just  text\n here", ["just text here"]),
    "cut off": (f"<article><p>{LONG}</p><p>half a senten<a hre", [LONG, "half a senten"]),
    "references": ("<article><p>&lt;b&gt; &#233; &#x4e2d; &eacute; &amp;amp; &unknown; a < b</p></article>", ["<b> é 中 é &amp; &unknown; a < b"]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_golden_pages(name):
    html, want = PAGES[name]
    assert ht.blocks_of(html) == want


def test_menu_without_a_name_is_left_out():
    html = f"<body><div>{MENU}</div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>{MENU}</div></body>"
    assert ht.blocks_of(html) == ["T", LONG, LONG, "Short.", LONG]


def test_smoothing_and_threshold_by_definition():
    values = np.array([0.0, 5.0, 1.0, 4.0, 0.5])
    kernel = lambda d: np.exp(-0.5 * d * d) if abs(d) <= 3 else 0.0
    want = [sum(kernel(i - j) * v for j, v in enumerate(values)) / sum(kernel(i - j) for j in range(5)) for i in range(5)]
    assert np.allclose(ht.smooth(values), want)
    at = ht.threshold(values)
    assert np.isclose(at, (values[values < at].mean() + values[values >= at].mean()) / 2)


@pytest.mark.parametrize("piece", ["<!--", "<a ", '<a href="', "<", "&", "</", "<!", "<?", "<div>", "<p><b>", "<ul><li>", "<script>", "<div class=ad>", "<td>", "&amp", "word "])
def test_hostile_pages_stay_linear(piece):
    began = time.perf_counter()
    ht.blocks_of(piece * (1_000_000 // len(piece)))
    ht.blocks_of(piece * (1_000_000 // len(piece)) + ">")
    assert time.perf_counter() - began < 20


def test_given_pages_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    got = ht.page_texts(spark.read.parquet(f"{small}/pages.parquet"))
    assert sorted(map(tuple, got.select("page_id", "url", "text", "n_chars").collect())) == sorted(con.execute(ht.OP11_SQL).fetchall())


def test_odd_rows(spark):
    rows = [(1, "u", None, "b"), (None, None, "", "b"), (2, "u", "<p>é😀</p>", None), (2, "u", "<p>é😀</p>", None), (3, "v", "<p>" + "w " * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string")
    got = ht.extract(pages)
    assert got.columns == ["page_id", "url", "blocks", "blocks_"]
    assert sorted(len(r.blocks_) for r in got.collect()) == [0, 0, 1, 1, 1]
    assert sorted((r.n_chars, r.text[:4]) for r in ht.page_texts(pages).collect()) == [(0, ""), (0, ""), (2, "é😀"), (2, "é😀"), (599_999, "w w ")]
    assert ht.page_texts(pages.limit(0)).count() == 0
