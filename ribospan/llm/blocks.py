"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block has its number of words and its
link density (share of its words inside links), those of its neighbours, and two facts of its
place: inside an article-like element, and inside an element that its tag, class, id or role
names as navigation, notice, advert, form or comments. Such a mark holds for text of any length, and
for all that is inside. Only names of the layout (a wrapper with ``sidebar`` in its class) and forms around
a whole page give way to an article or main element inside; comments, notices, footers and
the like do not. A decision tree, trained here on ``LABELLED``, says which blocks are main text.

Scripts, styles and other elements without running text are never blocks. Character references
are decoded, white space inside a block becomes one space, kept blocks are joined by a line feed.

Edge cases: a null or empty page gives an empty text; unclosed and cut-off tags are taken as far
as they go; very long pages are taken whole; null ids and repeated rows keep a row each; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?=/?[A-Za-z])[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)""")
WORD = re.compile(r"[^\W_]+")
#: Elements of HTML without running text.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option datalist textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of HTML inside a line; every other one begins a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words in classes and ids of what is not the article.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside rail widget footer foot masthead topbar toolbar cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments reply replies respond discussion disqus form search pagination pager tags copyright disclaimer "
    "legal skip".split()
)
#: Of these, names that wrappers of a whole page bear too; an article or main element inside lifts their mark.
LAYOUT_NAMES = frozenset("sidebar rail nav navbar navigation menu banner search share sharing social tags ad ads adv promo widget form topbar".split())
#: Words that make a class say how the page is laid out, not what its element is (``has-sidebar``).
STATES = frozenset("has have no with without is not enabled disabled open opened closed active on off layout enable disable show hide".split())
MAIN_NAMES = frozenset("article articlebody content main post entry story body text".split())
LINK = "a"

#: (words, link density, words before, link density before, words after, link density after,
#:  in an article, in an aside) and whether the block is main text.
LABELLED = [
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 1), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 0, 1), 0), ((2, 1.0, 1, 1.0, 1, 1.0, 0, 1), 0),
    ((1, 1.0, 1, 1.0, 12, 0.0, 0, 1), 0), ((12, 0.0, 1, 1.0, 9, 0.0, 0, 1), 0), ((30, 0.0, 1, 1.0, 60, 0.0, 0, 1), 0),
    ((8, 0.1, 40, 0.0, 0, 0.0, 0, 1), 0), ((15, 0.0, 80, 0.0, 0, 0.0, 0, 1), 0), ((45, 0.0, 90, 0.0, 20, 0.2, 0, 1), 0),
    ((25, 0.0, 70, 0.0, 60, 0.0, 1, 1), 0), ((5, 0.4, 90, 0.0, 60, 0.0, 1, 1), 0), ((70, 0.0, 40, 0.0, 50, 0.0, 1, 1), 0),
    ((3, 1.0, 60, 0.0, 4, 1.0, 1, 1), 0), ((6, 0.0, 20, 0.0, 30, 0.0, 1, 1), 0), ((1, 0.0, 30, 0.0, 2, 1.0, 1, 1), 0),
    ((9, 0.0, 1, 1.0, 60, 0.0, 1, 0), 1), ((9, 0.0, 12, 0.0, 80, 0.0, 1, 0), 1), ((5, 0.0, 8, 0.0, 3, 0.0, 1, 0), 1),
    ((120, 0.0, 9, 0.0, 70, 0.0, 1, 0), 1), ((60, 0.02, 80, 0.0, 90, 0.0, 1, 0), 1), ((3, 0.0, 60, 0.0, 90, 0.0, 1, 0), 1),
    ((1, 0.0, 80, 0.0, 60, 0.0, 1, 0), 1), ((2, 0.0, 60, 0.0, 12, 0.1, 1, 0), 1), ((40, 0.2, 60, 0.0, 50, 0.0, 1, 0), 1),
    ((14, 0.5, 60, 0.0, 50, 0.0, 1, 0), 1), ((300, 0.0, 5, 0.0, 10, 0.1, 1, 0), 1), ((20, 0.0, 20, 0.0, 0, 0.0, 1, 0), 1),
    ((4, 1.0, 60, 0.0, 5, 1.0, 1, 0), 0), ((5, 1.0, 4, 1.0, 5, 1.0, 1, 0), 0), ((2, 1.0, 2, 1.0, 40, 0.0, 1, 0), 0),
    ((6, 0.9, 70, 0.0, 6, 0.9, 1, 0), 0), ((1, 1.0, 60, 0.0, 12, 0.1, 1, 0), 0),
    ((9, 0.0, 14, 0.0, 9, 0.0, 1, 0), 1), ((9, 0.0, 0, 0.0, 9, 0.0, 1, 0), 1), ((5, 0.0, 30, 0.0, 0, 0.0, 1, 0), 1),
    ((1, 0.0, 9, 0.0, 1, 0.0, 1, 0), 1), ((1, 0.0, 1, 1.0, 1, 0.0, 1, 0), 1), ((2, 0.0, 3, 0.0, 4, 0.0, 1, 0), 1),
    ((3, 0.3, 40, 0.0, 8, 0.0, 1, 0), 1), ((4, 0.0, 2, 1.0, 3, 0.0, 1, 0), 1), ((6, 0.0, 45, 0.0, 25, 0.1, 1, 0), 1),
    ((7, 0.0, 7, 0.0, 2, 1.0, 1, 0), 1), ((8, 0.1, 8, 0.0, 7, 0.0, 1, 0), 1), ((4, 0.0, 4, 0.0, 0, 0.0, 1, 0), 1),
    ((2, 0.5, 30, 0.0, 30, 0.0, 1, 0), 1), ((6, 0.6, 20, 0.0, 30, 0.0, 1, 0), 1), ((10, 0.0, 25, 0.0, 6, 0.3, 1, 0), 1),
    ((3, 0.0, 0, 0.0, 8, 0.0, 1, 0), 1), ((50, 0.0, 0, 0.0, 4, 0.1, 1, 0), 1), ((8, 0.0, 1, 1.0, 1, 1.0, 1, 0), 1),
    ((5, 0.0, 90, 0.0, 70, 0.0, 1, 0), 1), ((2, 0.0, 70, 0.0, 0, 0.0, 1, 0), 1), ((1, 0.0, 0, 0.0, 0, 0.0, 1, 0), 1),
    ((40, 0.0, 40, 0.0, 40, 0.0, 1, 1), 0), ((90, 0.0, 60, 0.0, 90, 0.0, 1, 1), 0), ((18, 0.0, 9, 0.0, 9, 0.0, 1, 1), 0),
    ((12, 0.0, 1, 1.0, 9, 0.0, 1, 1), 0), ((10, 0.0, 0, 0.0, 50, 0.0, 1, 1), 0), ((22, 0.1, 30, 0.0, 0, 0.0, 1, 1), 0),
    ((60, 0.0, 80, 0.0, 40, 0.0, 0, 1), 0), ((20, 0.0, 0, 0.0, 60, 0.0, 0, 1), 0), ((35, 0.0, 10, 0.0, 35, 0.0, 0, 1), 0),
    ((100, 0.0, 3, 0.0, 60, 0.0, 0, 1), 0), ((50, 0.0, 6, 0.0, 2, 0.0, 0, 1), 0), ((16, 0.1, 90, 0.0, 30, 0.0, 0, 1), 0),
    ((28, 0.0, 15, 0.0, 4, 0.0, 0, 1), 0), ((14, 0.0, 1, 1.0, 14, 0.0, 0, 1), 0), ((75, 0.05, 60, 0.0, 0, 0.0, 0, 1), 0),
    ((10, 0.0, 1, 1.0, 1, 0.0, 0, 1), 0), ((11, 0.0, 1, 1.0, 120, 0.0, 0, 1), 0), ((9, 0.0, 200, 0.0, 0, 0.0, 0, 1), 0),
    ((6, 0.0, 3, 0.0, 0, 0.0, 0, 1), 0), ((2, 0.0, 9, 0.0, 6, 0.0, 0, 1), 0), ((4, 0.0, 60, 0.0, 2, 0.5, 0, 1), 0),
    ((150, 0.0, 120, 0.0, 130, 0.0, 0, 1), 0), ((140, 0.02, 160, 0.0, 120, 0.0, 0, 1), 0), ((260, 0.0, 140, 0.0, 180, 0.0, 0, 1), 0),
    ((180, 0.0, 110, 0.0, 150, 0.0, 1, 1), 0), ((130, 0.0, 200, 0.0, 240, 0.0, 1, 1), 0), ((320, 0.01, 300, 0.0, 280, 0.0, 0, 1), 0),
    ((1, 1.0, 1, 1.0, 2, 1.0, 0, 0), 0), ((3, 1.0, 2, 1.0, 4, 1.0, 0, 0), 0), ((4, 0.8, 3, 1.0, 6, 0.0, 0, 0), 0),
    ((3, 0.0, 0, 0.0, 2, 1.0, 0, 0), 0), ((4, 0.0, 2, 1.0, 3, 1.0, 0, 0), 0), ((6, 0.2, 60, 0.0, 0, 0.0, 0, 0), 0),
    ((5, 0.0, 3, 1.0, 5, 0.3, 0, 0), 0), ((7, 0.4, 6, 0.0, 1, 1.0, 0, 0), 0), ((2, 0.0, 1, 1.0, 0, 0.0, 0, 0), 0),
    ((40, 0.7, 10, 0.5, 12, 0.6, 0, 0), 0), ((25, 0.9, 30, 0.8, 20, 0.9, 0, 0), 0),
    ((60, 0.0, 8, 0.0, 70, 0.0, 0, 0), 1), ((45, 0.05, 60, 0.0, 80, 0.0, 0, 0), 1), ((90, 0.1, 40, 0.0, 3, 1.0, 0, 0), 1),
    ((4, 0.0, 60, 0.0, 80, 0.0, 0, 0), 1), ((7, 0.0, 45, 0.0, 50, 0.0, 0, 0), 1), ((3, 0.0, 90, 0.0, 40, 0.0, 0, 0), 1),
    ((9, 0.0, 80, 0.0, 35, 0.1, 0, 0), 1), ((18, 0.0, 70, 0.0, 60, 0.0, 0, 0), 1), ((25, 0.0, 4, 1.0, 50, 0.0, 0, 0), 1), ((30, 0.2, 50, 0.0, 6, 0.3, 0, 0), 1),
    ((16, 0.0, 40, 0.0, 0, 0.0, 0, 0), 1), ((200, 0.0, 1, 1.0, 0, 0.0, 0, 0), 1), ((22, 0.1, 1, 1.0, 4, 0.5, 0, 0), 1),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | float:
    """A decision tree by Gini impurity: ``(feature, threshold, low side, high side)`` or a share."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return share
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(rows: list = LABELLED) -> tuple | float:
    return grow(np.array([r for r, _ in rows], float), np.array([label for _, label in rows], float))


def decide(tree: tuple | float, features: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def _aside_words(token: str) -> set[str]:
    """The words of a class or id that name what is not the article; none if the token says how the page is laid out."""
    words = {w for w in re.split(r"[^a-z]+", token) if w}
    if words & STATES:
        return set()
    return words & ASIDE_NAMES | {"comments" for w in words if "comment" in w}


def _place(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is article-like, and its mark: 0 none, 1 one that an inner article lifts, 2 one that holds."""
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        return False, 1 if tag == "form" else 2
    if tag in ("html", "body"):
        return False, 0
    named, whole, aside = set(), set(), set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ASIDE_ROLES or key == "style" and re.search(r"display\s*:\s*none", value):
            return False, 2
        if key == "class" and "hidden" in value.split() or key == "aria-label" and value.strip() in ASIDE_NAMES:
            return False, 2
        if key in ("class", "id", "itemprop", "role") or key.startswith("data-ad"):
            for token in value.split():
                named |= {w for w in re.split(r"[^a-z]+", token) if w}
                whole.add(token)
                aside |= _aside_words(token)
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I):
        return False, 2
    if tag in ("article", "main"):
        # A whole class ("comment") puts it beside; a word of one ("ad-free") does not.
        beside = (whole & ASIDE_NAMES or "comments" in aside) and not whole & MAIN_NAMES
        return not beside, 2 if beside else 0
    if aside:
        return False, 1 if aside <= LAYOUT_NAMES else 2
    return bool(named & MAIN_NAMES), 0


def flat_blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """``text, words, link density, in an article, beside it`` of each block in page order."""
    out: list = []
    open_tags: list[tuple[str, bool, int]] = []  # tag, in an article, mark of what is beside it
    parts: list[str] = []
    linked: list[str] = []
    links, silent, at = 0, "", 0

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = len(WORD.findall(text)) or 1
            inside = len(WORD.findall(html.unescape(" ".join(linked)))) if linked else 0
            article, mark = open_tags[-1][1:] if open_tags else (False, 0)
            out.append((text, words, min(1.0, inside / words), int(article), int(mark > 0)))
        parts.clear()
        linked.clear()

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not silent and m.start() > at:
            run = page[at : m.start()]
            parts.append(run)
            if links:
                linked.append(run)
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if silent:
            continue
        if tag in SILENT and not closing:
            if tag not in INLINE and tag != "option":
                close_block()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if end is None and tag == "head":
                    continue
                at = end.end() if end else len(page)
            continue
        if tag == LINK:
            links = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        close_block()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    break
        else:
            links = 0
            if tag == "p" and open_tags and open_tags[-1][0] == "p":
                open_tags.pop()
            article, mark = open_tags[-1][1:] if open_tags else (False, 0)
            begins, own = _place(tag, m[3], article)
            if tag in ("article", "main") and begins and mark == 1 and not article:
                mark = 0
            open_tags.append((tag, article or begins, max(mark, own)))
    if not silent and at < len(page):
        parts.append(page[at:])
        if links:
            linked.append(page[at:])
    close_block()
    return out


def main_text(page: str, tree: tuple | float) -> tuple[str, int, int]:
    """Text, number of blocks, number of blocks kept."""
    blocks = flat_blocks(page)
    none = ("", 0, 0.0, 0, 0)
    kept = []
    for before, here, after in zip([none, *blocks], blocks, [*blocks[1:], none], strict=False):
        if decide(tree, (here[1], here[2], before[1], before[2], after[1], after[2], here[3], here[4])):
            kept.append(here[0])
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages(page_id, url, html)``, in the task that reads it."""
    tree = train()

    def run(found):
        for batch in found:
            rows = [main_text(p or "", tree) for p in batch.column(2).to_pylist()]
            texts = [t for t, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([b for _, b, _ in rows], pa.int32()), pa.array([k for _, _, k in rows], pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")
