"""Blocks by hand cases, the classifier by leaving pages out, the query against its SQL."""

import duckdb
import numpy as np
import pytest

from tidewake.llm import html_text
from tidewake.llm.labelled_pages import PAGES
from tidewake.llm.queries import ORACLES


@pytest.fixture(scope="module")
def tree():
    return html_text.fit()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a\n  b<br>c&nbsp;d<p><b>e</b>f &amp; g &lt;h> &#x41;&copy</p>", ["a b c d", "ef & g <h> A©"]),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><title>t</title><p>x", ["x"]),
        ("<p>before<!-- <p>not</p> -->after</p><!-- open <p>never", ["beforeafter"]),
        ("<!DOCTYPE html><p>1 < 2 and 3<4</p><p class='x", ["1 < 2 and 3<4"]),
        ('<p title="a>b">c</p><p title=a">d</p>', ["c", "d"]),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>five", ["one", "two", "three", "four", "five"]),
        ("<P>Upper</P></div></p>stray<svg><text>no</text></svg><noscript>no</noscript>", ["Upper", "stray"]),
        ("&amp;lt; &am &unknown; &#0;", ["&lt; &am &unknown; �"]),
        ("", []),
        ("   <div> </div>&nbsp;", []),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_features_of_neighbours_and_links():
    x = html_text.features(html_text.blocks("<p>one two</p><p><a href=x>three four</a> five</p><div class='left sidebar'>six</div>"))
    at = {name: i for i, name in enumerate(html_text.FEATURES)}
    assert x[:, at["words"]].tolist() == [2, 3, 1] and np.allclose(x[:, at["links"]], [0, 2 / 3, 0])
    assert x[:, at["words_after"]].tolist() == [3, 1, 0] and np.allclose(x[:, at["links_before"]], [0, 0, 2 / 3]) and x[:, at["aside"]].tolist() == [0, 0, 1]


def test_unclosed_asides_and_layout_classes_leave_the_article(tree):
    page = "<body class='with-sidebar has-comments'><nav><ul><li>menu<article><p>Kept.</p><div class=advert>gone</div><p>Too.</p></article></nav><section id='respondForm'><p>gone</p></section>"
    assert html_text.main_text(page, tree) == "Kept.\nToo."


def test_pages_left_out_are_told_right():
    right = total = 0
    for i in range(len(PAGES)):
        x, y = html_text.labelled([PAGES[i]])
        right, total = right + (html_text.decide(html_text.fit(PAGES[:i] + PAGES[i + 1 :]), x) == y).sum(), total + len(y)
    assert right / total >= 0.9
    x, y = html_text.labelled(PAGES)
    assert (html_text.decide(html_text.fit(), x) == y).all()


def pages() -> list[tuple]:
    head = '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">buy this</div>'
    one = head + "<article><h1>T &amp;amp; x</h1><p><b>first.<br><p>s\n\nse &quot;c</p><p>é</p></article><footer>&copy; f</footer>"
    return [(1, "u", one), (2, None, None), (3, "v", ""), (4, "w", one), (4, "w", one), (None, "x", head), (5, "y", head + "<article>" + "<p>long text &amp; more</p>" * 20_000 + "</article>")]


def test_query_equals_its_sql_with_odd_rows(spark, tmp_path):
    spark.createDataFrame([(*r, 1, "clash") for r in pages()], "page_id long, url string, html string, n_chars int, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html_text.op11_html_text(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT row_number() OVER () AS n, * FROM '{tmp_path}/pages.parquet/*.parquet'")
    # the SQL has one row for each page and address; rows that repeat are told apart here
    want = con.sql(ORACLES["op11_html_text"].replace("page_id, url", "n, page_id, url"))
    assert want.columns == ["n", "page_id", "url", "text", "n_chars"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got.collect())) == sorted(key(r[1:]) for r in want.fetchall())


def test_block_rows_and_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    rows = html_text.page_blocks(frame).filter("page_id = 1").orderBy("block").collect()
    assert [(r.text, r.kept) for r in rows] == [("a", False), ("buy this", False), ("T &amp; x", True), ("first.", True), ('s se "c', True), ("é", True), ("© f", False)]
    frame.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert html_text.op11_html_text(spark, str(tmp_path)).collect() == []
