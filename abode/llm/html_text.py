"""Main text of HTML pages from flat text blocks.

1. A page is cut into flat blocks: text between block-level tags, with inline
   tags dropped.  Scripts, styles, comments and the like are no text.
2. Each block has its number of words, its link density (share of words inside
   links), the same of the block before and after it, whether it is a heading,
   and what the elements around it say: inside an article or main element;
   inside a menu, header, footer, sidebar, notice, advert, form or comment
   section within that; inside one around that; outside of the page's article.
3. A decision tree (``grow``: CART by Gini impurity) tells main text from the
   rest.  It is trained on a small labelled table: the blocks of
   ``LABELLED_PAGES``, where ``data-main`` marks an element whose blocks are
   main text, or rows of the caller's own.
4. Kept blocks, white space turned into one space, are joined by a line feed.

Pages are independent: one Arrow pass, no shuffle.  A task holds one batch
(bounded by rows and bytes) and a page is one string in it, so a single page
has to fit a Python worker (about ten times its size).

Defined results: a null or empty page, and a page without main text, gives an
empty text; markup that is cut off or not closed counts as closed at the end
of the page; repeated rows get the same answer each; null ids and urls are
kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.common import bounded_batches

MAX_DEPTH = 8
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "main", "side", "side_around", "outside")

# fixed lists of HTML element names
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select datalist noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(("article", "main"))
SIDE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())

# words in class, id and role that tell main text from what stands around it
MAIN_NAMES = frozenset("article content post entry story main".split())
TITLE_NAMES = frozenset("article post entry story".split())  # a header of one of these is part of it
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay dialog sidebar aside complementary nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer "
    "contentinfo comment comments disqus reply replies respond discussion related recommended recommendations teaser teasers share sharing social "
    "newsletter subscribe subscription signup login search form pagination pager tags tagcloud widget widgets toolbar copyright disclaimer".split())

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|style|data-main)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def end_of_raw(page: str, name: str, at: int) -> int:
    """Where the text of a raw element that opened before ``at`` ends."""
    m = re.compile(rf"</{name}(?![\w-])", re.I).search(page, at)
    return m.start() if m else len(page)


def element(name: str, attributes: str, state: tuple) -> tuple:
    """State (main, side, side_around, labelled) inside an element."""
    main, side, around, labelled = state
    names: set[str] = set()
    hidden = False
    if attributes:
        for key, value in NAMES.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "style" and UNSEEN.search(value)):
                hidden = True
            elif key == "data-main":
                labelled = value != "0"
            elif key != "style":
                names.update(w.lower() for w in WORD.findall(value))
    beside = names & SIDE_NAMES
    if beside == {"header"} and names & TITLE_NAMES:
        beside = set()
    if hidden or beside or (name in SIDE_TAGS and not (name == "header" and main)):
        return main, 1, around, labelled
    if name in MAIN_TAGS or names & MAIN_NAMES:
        return 1, 0, around | side, labelled
    return main, side, around, labelled


def blocks(page: str) -> list[tuple[str, int, int, int, tuple]]:
    """(text, words, words inside links, heading, state) of every block with a
    word, in page order."""
    out: list[tuple[str, int, int, int, tuple]] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, tuple, int]] = []  # open block elements: name, state outside, heading outside
    opened: dict[str, int] = {}
    state, heading = (0, 0, 0, False), 0
    link = -1  # depth of the stack at which a link is open
    at = 0

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                linked = len(html.unescape(" ".join(links)).split()) if links else 0
                out.append((" ".join(words), len(words), min(linked, len(words)), heading, state))
            parts.clear()
            links.clear()

    while True:
        m = TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if link >= 0:
                links.append(text)
        if not m:
            flush()
            return out
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW:
            if name not in INLINE:
                flush()
            if not m[1] and not m[3].endswith("/"):
                at = end_of_raw(page, name, at)
        elif name == "a":
            link = -1 if m[1] else len(stack)
        elif name in INLINE:
            continue
        else:
            flush()
            if name in VOID or m[3].endswith("/"):
                continue
            if not m[1]:
                if stack and stack[-1][0] == "p":  # a paragraph holds no blocks: its end tag is optional
                    _, state, heading = stack.pop()
                    opened["p"] -= 1
                stack.append((name, state, heading))
                opened[name] = opened.get(name, 0) + 1
                state = element(name, m[3], state)
                heading = 1 if name in HEADINGS else heading
            elif opened.get(name):
                while True:
                    top, state, heading = stack.pop()
                    opened[top] -= 1
                    if top == name:
                        break
                if link > len(stack):
                    link = -1


def features(page: list[tuple[str, int, int, int, tuple]]) -> list[tuple]:
    """The rows of ``FEATURES`` of a page's blocks."""
    size = [(b[1], b[2] / b[1]) for b in page]
    none = (0, 0.0)
    has_main = any(b[4][0] and not b[4][1] for b in page)
    return [(*size[i], *(size[i - 1] if i else none), *(size[i + 1] if i + 1 < len(size) else none), b[3], *b[4][:3], int(has_main and not b[4][0]))
            for i, b in enumerate(page)]


# ---------------------------------------------------------------------------
# the decision tree
# ---------------------------------------------------------------------------

def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> tuple:
    """CART: (feature, threshold, tree for values up to it, tree above) or (label,).
    Splits have the least Gini impurity; ties go to the first feature and the
    smallest threshold; equal counts count as main text."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)):
        return (int(2 * ones >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, up = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n, k = cut + 1.0, up[cut]
        gini = k * (n - k) / n + (ones - k) * (len(y) - n - ones + k) / (len(y) - n)
        i = int(np.argmin(gini))
        if best is None or gini[i] < best[0] - 1e-12:
            best = (float(gini[i]), f, float(v[cut[i]] + v[cut[i] + 1]) / 2)
    if best is None:
        return (int(2 * ones >= len(y)),)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Labels of the rows of ``x``."""
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(tree[2], x[low]), decide(tree[3], x[~low])
    return out


def say(n: int) -> str:
    """Filler of ``n`` words: only numbers of words and links matter."""
    return " ".join(["word"] * n)


def link(n: int) -> str:
    return f"<a href=/>{say(n)}</a>"


def paragraphs(*sizes: int) -> str:
    return "".join(f"<p>{say(n)}</p>" for n in sizes)


MENU = "<ul>" + "".join(f"<li>{link(n)}</li>" for n in (1, 2, 1, 3, 1)) + "</ul>"

# the small labelled table, as pages: blocks inside data-main are main text
LABELLED_PAGES = (
    # an article between menu, advert and footer; short and long paragraphs, headings, lists, quotes, tables and links in it
    f"<body><nav>{MENU}</nav><div class=ad>{say(9)}</div><article data-main><h1>{say(8)}</h1>{paragraphs(60, 1, 12, 3, 90, 2)}<h2>{say(3)}</h2>"
    f"{paragraphs(30, 5)}<ul><li>{say(2)}</li><li>{say(6)}</li><li>{link(4)}</li></ul><p>{say(4)} {link(3)}</p><blockquote>{say(15)}</blockquote>"
    f"<table><tr><td>{say(1)}</td><td>{say(2)}</td></tr></table></article><footer>{say(14)}</footer></body>",
    # a header with a long slogan, a cookie notice of full sentences, a sidebar and comments
    f"<body><header>{say(3)}<p>{say(22)}</p></header><div class='cookie-notice'>{say(45)} {link(2)}</div><main><article data-main><header><h1>{say(6)}</h1>"
    f"</header>{paragraphs(48, 7, 1, 70)}<div data-main=0 class=share>{link(1)} {link(1)}</div><div data-main=0 class=advert>{say(30)}</div>{paragraphs(25, 3)}"
    f"<footer data-main=0>{say(8)}</footer></article><section class=comments><h3>{say(2)}</h3><article class=comment>{paragraphs(35, 4)}</article>"
    f"<article class=comment>{paragraphs(3, 50)}</article><form>{say(5)}<button>{say(1)}</button></form></section></main>"
    f"<aside>{paragraphs(40, 2)}{MENU}</aside><footer>{paragraphs(30, 5)}{link(2)}</footer></body>",
    # comments and a form inside the article element
    f"<body><nav>{say(5)}</nav><article data-main><h1>{say(4)}</h1>{paragraphs(1)}{paragraphs(80, 2, 9)}<div data-main=0 id=comments><p>{say(60)}</p><p>{say(2)}</p>"
    f"</div><form data-main=0>{say(20)}<p>{say(6)}</p></form><aside data-main=0>{say(33)}</aside>{paragraphs(17)}</article><div class=notice>{say(26)}</div></body>",
    # a very short article
    f"<body><nav>{MENU}</nav><article data-main><h1>{say(2)}</h1>{paragraphs(1)}</article><footer>{say(50)}</footer></body>",
    f"<body><div class=banner>{say(70)}</div><article data-main>{paragraphs(3)}</article><div class=sidebar>{paragraphs(55)}</div></body>",
    # main text named by class alone
    f"<body><div id=top-menu>{MENU}</div><div class=post-content data-main><h2>{say(5)}</h2>{paragraphs(40, 2, 1, 66)}</div><div class=related>{link(6)}{say(3)}</div>"
    f"<div id=footer>{say(16)}</div></body>",
    # teasers of other articles beside the article
    f"<body><main><article data-main><h1>{say(7)}</h1>{paragraphs(33, 44)}</article></main><aside><article><h3>{link(6)}</h3><p>{say(11)}</p></article>"
    f"<article><h3>{link(8)}</h3><p>{say(14)} {link(2)}</p></article></aside></body>",
    # an advert that is not closed before the article
    f"<body><div class=ad>{say(8)}<article data-main><h1>{say(6)}</h1>{paragraphs(50, 35, 41)}</article></body>",
    # no element says anything: numbers of words and links of a block and its neighbours do
    f"<body><div>{link(1)} {link(2)} {link(1)}</div><div>{say(3)}</div><div data-main><h1>{say(7)}</h1><p>{say(40)}</p><p>{say(9)}</p><p>{say(52)}</p><p>{say(30)}</p></div>"
    f"<div>{link(4)}</div><div>{link(5)}</div><div>{say(4)}</div></body>",
    f"<body><table><tr><td>{link(2)}</td><td>{link(1)}</td></tr></table><p>{say(2)}</p><div data-main><p>{say(80)}</p><p>{say(60)} {link(4)}</p><p>{say(12)}</p><p>{say(45)}</p>"
    f"</div><p>{link(3)} {say(2)}</p><p>{say(6)}</p></body>",
    f"<body><div>{link(1)} {link(1)}</div><div data-main><p>{say(46)}</p><p>{say(23)}</p></div><div>{link(1)}</div></body>",
    f"<body><div>{link(3)}</div><div data-main><p>{say(19)}</p><p>{say(55)}</p><p>{say(17)}</p></div><div>{link(2)}</div><div>{say(3)}</div></body>",
    f"<body data-main><p>{say(25)}</p><p>{say(33)}</p></body>",
    f"<body><div>{link(20)}</div><div>{link(12)} {say(1)}</div><div>{say(2)} {link(30)}</div></body>",
    f"<body><div>{say(2)}</div><div>{say(5)}</div><div>{say(1)}</div><div data-main><p>{say(38)}</p><p>{say(28)}</p><p>{say(64)}</p></div><div>{say(7)}</div><div>{say(3)}</div>"
    f"<div>{say(8)}</div></body>",
    f"<body><p>{say(1)}</p><p>{say(6)}</p><p>{say(4)}</p><p>{say(2)}</p><p>{say(9)}</p></body>",
    # texts that stand outside of the article, unmarked
    f"<body><div>{say(2)}</div><p>{say(12)}</p><div>{say(40)}</div><article data-main><h1>{say(5)}</h1>{paragraphs(2, 60, 20)}</article><div>{say(75)}</div><p>{say(24)}</p>"
    f"<div>{say(4)}</div></body>",
    f"<body><p>{say(31)}</p><main data-main>{paragraphs(6, 22, 1)}</main><p>{say(52)}</p><div>{say(1)}</div></body>",
)


def labelled_blocks(pages: tuple[str, ...] = LABELLED_PAGES) -> list[tuple]:
    """The labelled table: ``FEATURES`` and the label of every block of the pages."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(*f, int(b[4][3])) for f, b in zip(features(found), found, strict=True)]
    return rows


def trained(rows: list[tuple] | None = None, depth: int = MAX_DEPTH) -> tuple:
    """The tree of a labelled table (rows of ``FEATURES`` and the label)."""
    table = np.array(labelled_blocks() if rows is None else rows, float)
    return grow(table[:, :-1], table[:, -1].astype(int), depth)


def main_texts(pages: list[str | None], tree: tuple) -> list[tuple[str, int, int]]:
    """(main text, blocks, blocks kept) of every page."""
    found = [blocks(p) if p else [] for p in pages]
    rows = [r for f in found for r in features(f)]
    keep = decide(tree, np.array(rows, float)) if rows else np.zeros(0, bool)
    out, at = [], 0
    for f in found:
        kept = [b[0] for b, k in zip(f, keep[at:at + len(f)].tolist(), strict=True) if k]
        at += len(f)
        out.append(("\n".join(kept), len(f), len(kept)))
    return out


def extract_text(pages: DataFrame, labelled: list[tuple] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 max_depth: int = MAX_DEPTH) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_kept of every row.

    ``labelled`` rows (``FEATURES``, label) train the tree; by default the
    blocks of ``LABELLED_PAGES``."""
    bounded_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    tree = trained(labelled, max_depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = main_texts(b.column(2).to_pylist(), tree)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    schema = T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])
    return src.mapInArrow(run, schema)
