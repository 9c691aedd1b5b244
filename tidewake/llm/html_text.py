"""Operator 11: the main text of web pages, by classified blocks of text.

A page is cut flat: every element that isn't inline ends a block of text. A block is told by
its number of words, the share of them in links, the same of its neighbours on either side,
and by what the elements around it say of themselves (element, role, class and identifier).
A decision tree, trained on the small table of ``labelled_pages``, says which blocks belong
to the main text. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewake.llm.common import prepare, table
from tidewake.llm.labelled_pages import PAGES

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment, to the end where it isn't closed
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for n in "script style title textarea iframe noembed noframes xmp".split()}

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio canvas".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
_HIDDEN = frozenset("noscript template svg object video audio canvas select button".split())
#: An element of the first kind ends an open one of these, up to the nearest of the last.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
_ASIDE = frozenset("nav aside footer header form dialog menu search".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class names and identifiers that speak for a part beside the main text.
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header"
    " masthead menu modal nav navbar navigation newsletter notice notification outbrain pagination pager popup promo promotion related respond share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription taboola tags toc toolbar widget widgets".split()
)
#: Words of class names and identifiers that speak for the main text.
_MAIN_WORDS = frozenset("article content entry main post story".split())
_MODIFIER = re.compile(r"^(?:has|with|no|without|is|hide|show)[-_]", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "in_article", "beside_article", "in_content", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    article: bool
    content: bool
    heading: bool


def _hints(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """(aside by element or role, aside by its names, article, content by its names) of one element."""
    role, names = "", []
    if "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = html.unescape(next((v for v in values if v), ""))
            if key.lower() == "role":
                role = value.strip().lower()
            elif name not in ("html", "body"):  # theirs speak of the page's layout
                names += [w for part in value.split() if not _MODIFIER.match(part) for w in _WORD.findall(_CAMEL.sub(" ", part).lower())]
    return name in _ASIDE or role in _ASIDE_ROLES, any(w in _ASIDE_WORDS for w in names), name in ("article", "main") or role in ("main", "article"), any(w in _MAIN_WORDS for w in names)


#: Of an open element: name, asides by element since the last article, by names, in article, in content, hidden, heading.
_OUTSIDE = ("", 0, 0, False, False, False, False)


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order, markup taken off, references decoded, white space as one space."""
    out: list[Block] = []
    stack, parts, linked, link = [_OUTSIDE], [], 0, 0

    def end() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            _, aside, named, article, content, _, heading = stack[-1]
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), aside + named > 0, article, content, heading))
        parts.clear()
        linked = 0

    def close(names: tuple, until: tuple = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def text(lo: int, hi: int) -> None:
        nonlocal linked
        if lo < hi and not stack[-1][5]:
            piece = html.unescape(page[lo:hi])
            parts.append(piece)
            if link:
                linked += len(piece.split())

    at = start = 0
    while (start := page.find("<", start)) >= 0:
        if not (m := _TOKEN.match(page, start)):
            start += 1
            continue
        text(at, start)
        at = start = m.end()
        closed, opened = m[1], m[2]
        if closed:
            name = closed.lower()
            if name == "a":
                link = max(0, link - 1)
            elif name in _BLOCK:
                end()
                close((name,))
        elif opened:
            name = opened.lower()
            if name in _RAW_END:
                after = _RAW_END[name].search(page, at)
                at = start = after.end() if after else len(page)
                if name == "title" or name == "textarea":
                    end()
            elif name == "br":
                parts.append(" ")
            elif name == "a":
                link = 1  # links don't nest
            elif name in _BLOCK:
                end()
                link = 0
                if stack[-1][0] == "p":
                    stack.pop()
                if name in _ENDS:
                    close(*_ENDS[name])
                if name not in _VOID and not m[3].endswith("/"):
                    _, aside, named, article, content, hidden, _ = stack[-1]
                    by_element, by_name, is_article, is_content = _hints(name, m[3])
                    if name == "header" and (article or content):
                        by_element = False  # an article's own heading
                    aside = 0 if is_article else aside + by_element
                    heading = len(name) == 2 and name[0] == "h" and name != "hr"
                    stack.append((name, aside, named + by_name, article or is_article, content or is_content, hidden or name in _HIDDEN, heading))
    text(at, len(page))
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    before = lambda c: np.concatenate([[0.0], c[:-1]])[: len(c)]
    after = lambda c: np.concatenate([c[1:], [0.0]])[: len(c)]
    has = any(b.article for b in found)
    told = np.array([(b.aside, b.article, has and not b.article, b.content, b.heading) for b in found], float).reshape(len(found), 5)
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), told])


@dataclass
class Node:
    """A leaf has a decision, an inner node a test (column at most ``bound``) and two branches."""

    keep: bool
    column: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _impurity(kept: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = kept / np.maximum(n, 1)
    return n * share * (1 - share)


def grow(x: np.ndarray, keep: np.ndarray, least: int = 2, most_depth: int = 6) -> Node:
    """A decision tree by Gini impurity: the best split of any column, until leaves are pure, small or deep."""
    node = Node(bool(keep.mean() >= 0.5))
    if most_depth == 0 or keep.all() or not keep.any():
        return node
    best = (_impurity(keep.sum(), len(keep)) - 1e-9, -1, 0.0)
    for column in range(x.shape[1]):
        order = np.argsort(x[:, column], kind="stable")
        v, k = x[order, column], np.cumsum(keep[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        n = cut + 1
        cut, n = cut[(n >= least) & (len(v) - n >= least)], n[(n >= least) & (len(v) - n >= least)]
        if len(cut):
            cost = _impurity(k[cut], n) + _impurity(k[-1] - k[cut], len(v) - n)
            i = int(cost.argmin())
            if cost[i] < best[0] - 1e-9:
                best = (cost[i], column, float(v[cut[i]] + v[cut[i] + 1]) / 2)
    if best[1] >= 0:
        node.column, node.bound = best[1], best[2]
        low = x[:, node.column] <= node.bound
        node.low, node.high = (grow(x[s], keep[s], least, most_depth - 1) for s in (low, ~low))
    return node


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    if node.column < 0:
        return np.full(len(x), node.keep)
    low = x[:, node.column] <= node.bound
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(node.low, x[low]), decide(node.high, x[~low])
    return out


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of marked pages; the marks are taken off first."""
    xs, ys = [], []
    for page in pages:
        marks = [b.text[0] for b in blocks(page)]
        if set(marks) - {"+", "-"}:
            raise ValueError("a block has no mark")
        bare = blocks(re.sub(r"(?<=>)\s*[+-]", "", page))
        if len(bare) != len(marks):
            raise ValueError("a mark is no block's start")
        xs.append(features(bare))
        ys.append(np.array([m == "+" for m in marks], bool))
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: list[str] | None = None) -> Node:
    """The block classifier, trained on the labelled pages."""
    return grow(*labelled(PAGES if pages is None else pages))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, decide(tree, features(found))) if keep)


def _extract(tree: Node):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def _all_blocks(tree: Node):
    names = ["page_id", "block", "text", *FEATURES, "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(2)):
                if found := blocks(page.as_py() or ""):
                    x = features(found)
                    ids, texts = pa.array([page_id] * len(found), batch.column(0).type), pa.array([b.text for b in found], pa.string())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(found), dtype=np.int32)), texts, *(pa.array(c.copy()) for c in x.T), pa.array(decide(tree, x))], names=names)

    return run


def _columns(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    prepare(pages.sparkSession)
    return pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"cast(`{html_col}` AS string) AS html")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """One row per page: page_id, url, text (the main text's blocks, a line each) and n_chars (its code points).

    A null or empty page has an empty text; identifiers and addresses pass as they are, null
    too. Pages of any length are read whole; repeated rows give repeated rows, equal pages
    equal texts; extra columns aren't read. An empty table gives an empty table. White space is
    Unicode's; ``<br>`` is white space inside a block. Markup that is cut off at the end of the
    page is dropped, and so is the content of an element that isn't text (scripts and the like).
    """
    rows = _columns(pages, id_col, url_col, html_col)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_extract(tree or fit()), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """Every block of every page with its features and the classifier's decision (a page without text has no row)."""
    rows = _columns(pages, id_col, url_col, html_col)
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, block int, text string, {', '.join(f'{f} double' for f in FEATURES)}, kept boolean"
    return rows.mapInArrow(_all_blocks(tree or fit()), schema)


def op11_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: The blocks of the article, for pages whose main text is one <article> without asides and that use these references only.
OP11_SQL = r"""
WITH inside AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS part FROM pages
), lines AS (
  SELECT page_id, url, string_split(regexp_replace(part, '</?(?:p|h[1-6]|div|ul|li|section)(?: [^>]*)?>', chr(1), 'g'), chr(1)) AS lines FROM inside
), cut AS (
  SELECT page_id, url, places.place AS place, lines[places.place] AS line FROM lines, unnest(generate_series(1, len(lines))) AS places(place)
), bare AS (
  SELECT page_id, url, place, regexp_replace(regexp_replace(line, '<br[^>]*>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g') AS line FROM cut
), decoded AS (
  SELECT page_id, url, place, trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line
  FROM bare
)
SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE line <> ''), '') AS text,
  length(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE line <> ''), ''))::BIGINT AS n_chars
FROM decoded GROUP BY page_id, url
"""
