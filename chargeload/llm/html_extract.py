"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its word count and link
density, those of the blocks before and after it, and what its open elements say (navigation and the like by tag or
by class and id, an article, a heading). An article, or an element named like one, ends the marks of the layout around it, but
not those of comments, footers or asides; a form around the whole page marks nothing. A decision tree, trained here on a small labelled table,
tells text from boilerplate; the blocks it keeps are joined in page order.

Defined cases: null html is empty; a page without main text gives an empty string (one without any
marks, links and longer texts gives all it has); a quote opens a value only after an equals sign; unclosed and stray tags are
closed by what follows; broken character references stay as they are; repeated rows are extracted alike.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML and words that sites name their parts by.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = "script|style|noscript|title|textarea|iframe"  # their text is no markup: it ends at the next end tag of the kind
SKIPPED_TAGS = frozenset("template svg math object canvas select button".split())
TEXT_TAGS = frozenset("article blockquote h1 h2 h3 h4 h5 h6 main ol p section table ul".split())
CLOSED_BY_TEXT_TAGS = frozenset("svg math select button".split())
VOID_TAGS = frozenset("area base col embed img input link meta param source track wbr".split())
CONTAINERS = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figure footer form header main menu nav ol section table tbody td th tr ul".split())
APART_TAGS = frozenset("aside dir footer menu nav".split())  # never part of an article, whatever stands in them
FORM_TAGS = frozenset("fieldset form".split())  # some sites wrap the whole page in one
ARTICLE_TAGS = frozenset(("article", "main"))
BOILERPLATE_HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|alert|banner|breadcrumbs?|byline|comments?|consent|cookies?|disqus|footer|gdpr|header|login|masthead|menu|meta|modal|nav|navbar|navigation|newsletter|notice|outbrain|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|sign-?up|skip|social|sponsor\w*|subscri\w*|tags?|teasers?|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
# Parts that hold texts of their own, which an inner article does not free; and parts that also name layout: an inner content mark frees it.
APART_HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|comments?|disqus|footer|outbrain|recommend\w*|related|replies|reply|respond|sponsor\w*)(?:$|[\s_-])", re.I)
SOFT_HINT = re.compile(r"(?:^|[\s_-])(?:sidebar|social|share|sharing|widget|header|masthead|toolbar|meta|complementary|login|search)(?:$|[\s_-])", re.I)
# A name with one of these words tells how a wrapper looks or whether a part is open, not what the wrapper holds.
LAYOUT_WORD = re.compile(r"(?:^|[_-])(?:has|have|with|without|no|not|is|are|show|hide|open|opened|closed|active|inactive|visible|hidden|enabled|disabled|on|off|sticky|fixed|layout|wrapper)(?:$|[_-])", re.I)
ARTICLE_HINT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body-?text|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<skip>{RAW_TAGS})(?=[\s/>])(?:[^>]*[^>/])?>.*?(?:</(?P=skip)\s*>|\Z)|<(?P<tag>/?[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?/][^>]*>|<(?=[a-zA-Z/!?])[^>]*>?|[^<]+|<", re.S | re.I)
_HINT_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "boilerplate", "article", "heading", "words_unmarked")
# The labelled table: pages as blocks "place:words:linked words:label". Places: b is marked as boilerplate,
# a stands in an article, ab is marked inside an article, h is a heading in an article, o a heading outside, - has no mark.
LABELLED = (
    "b:6:6:0 b:9:0:0 h:7:0:1 a:80:0:1 a:3:0:1 a:45:2:1 a:1:0:1 b:14:0:0",
    "b:1:1:0 b:1:1:0 b:1:1:0 b:12:0:0 h:5:0:1 a:120:6:1 ab:20:0:0 a:60:0:1 ab:30:2:0 b:40:0:0",
    "-:4:4:0 -:5:5:0 -:3:3:0 o:8:0:1 -:60:2:1 -:95:4:1 -:18:0:1 -:70:0:1 -:6:6:0 -:9:3:0",
    "b:25:0:0 -:2:2:0 -:2:2:0 o:6:0:1 -:40:0:1 -:33:1:1 -:52:0:1 b:90:0:0 b:64:0:0 -:7:0:0",
    "-:3:3:0 -:3:3:0 -:12:0:0 -:2:2:0 o:9:0:1 -:110:0:1 -:25:0:1 -:3:1:0 -:4:4:0 -:8:8:0",
    "b:8:8:0 h:4:0:1 a:12:0:1 a:2:0:1 a:200:11:1 a:7:7:1 a:30:3:1 ab:15:15:0 ab:48:0:0 ab:5:0:0 b:3:3:0",
    "b:60:0:0 b:35:1:0 h:11:0:1 a:22:0:1 a:5:0:1 b:18:18:0 b:75:0:0",
    "-:5:5:0 -:6:1:0 -:55:0:1 -:48:0:1 -:90:3:1 -:5:5:0 -:10:10:0",
    "b:3:0:0 b:4:0:0 h:3:0:1 a:4:0:1 a:6:0:1 a:3:0:1 b:11:1:0",
    "-:1:1:0 -:1:1:0 -:1:1:0 -:1:1:0 o:3:0:0 -:9:9:0 -:11:11:0 -:8:8:0 -:6:0:0",
    "b:28:2:0 ab:33:0:0 h:6:0:1 a:15:15:1 a:64:0:1 ab:22:0:0 a:31:0:1 b:120:0:0 b:85:4:0",
    "h:5:0:1 a:70:0:1 a:12:0:1",
    "b:30:0:0 a:9:0:1",
    "a:40:40:1 a:3:3:1 a:6:2:1 a:90:20:1 a:2:0:1",
    "h:2:2:1 a:1:1:1 b:5:5:0 a:1:0:1 a:11:11:1 b:2:0:0",
    "b:200:3:0 b:150:0:0 b:1:0:0 h:9:0:1 a:5:1:1 a:4:4:1",
    "a:8:0:1 b:110:0:0 a:8:0:1 b:45:45:0 a:8:8:1 b:60:0:0",
    "b:80:0:0 h:3:0:1 a:1:0:1",
    "b:12:0:0 b:95:0:0 a:2:2:1 ab:3:0:0 a:250:0:1 ab:250:0:0",
    "-:2:2:0 -:1:1:0 o:10:0:1 -:45:0:1 -:130:6:1",
    "-:75:0:1",
    "-:3:0:0",
    "-:4:4:0 -:30:0:1 -:28:1:1 -:2:0:0",
    "o:7:0:1 -:62:0:1 -:40:2:1 b:33:0:0 b:18:0:0",
    "-:30:30:0 -:24:20:0 o:6:0:1 -:80:2:1 -:50:40:0 -:22:22:0",
    "-:60:51:0 -:120:4:1 -:35:1:1 -:18:17:0 -:44:44:0",
    "h:4:4:1 a:12:12:1 a:30:28:1 a:6:6:1 a:2:0:1 a:20:19:1 a:9:9:1 a:3:3:1",
    "b:7:7:0 a:18:18:1 a:1:1:1 a:14:14:1 a:5:0:1 a:25:25:1 a:8:7:1 a:4:4:1 b:9:0:0",
    "a:16:15:1 a:3:0:1 a:40:37:1 a:10:10:1 a:2:2:1 a:33:33:1",
    # a page that is marked as a whole: its marks say nothing, words and links do
    "b:4:4:0 b:5:5:0 b:70:0:1 b:95:3:1 b:45:1:1 b:3:3:0 b:14:13:0",
    "-:3:3:0 b:6:6:0 b:60:1:1 b:120:4:1 b:38:0:1 b:9:8:0 b:2:2:0",
    "b:2:2:0 b:2:2:0 b:85:2:1 b:64:0:1 b:150:5:1 b:20:20:0 b:12:11:0",
    "-:2:2:0 b:55:0:1 b:72:1:1 b:41:2:1 b:30:29:0 b:4:0:0",
    "b:7:7:0 b:15:15:0 b:3:0:0 b:6:5:0",
    "b:60:58:0 b:45:45:0 b:50:0:1 b:48:2:1 b:80:77:0 b:110:104:0 b:6:0:0",
    # short headlines outside an article
    "-:2:2:0 -:1:1:0 o:2:0:1 -:70:1:1 -:55:0:1",
    "-:3:3:0 o:3:0:1 -:44:0:1 o:1:0:1 -:90:2:1",
    "o:4:0:1 -:120:3:1 -:35:0:1 o:2:0:0 -:5:5:0 -:8:8:0",
    # short paragraphs and paragraphs with links outside an article
    "-:4:4:0 o:6:0:1 -:50:5:1 -:12:0:1 -:8:0:1 -:9:0:1 -:40:6:1 -:6:0:1 -:11:0:1 -:70:9:1 -:4:4:0 -:7:6:0",
    "-:1:1:0 o:5:0:1 -:80:12:1 -:10:1:1 -:7:0:1 -:12:0:1 -:60:10:1 -:30:5:1 -:15:0:1 -:9:9:0 -:5:4:0",
    "b:5:5:0 o:7:0:1 -:16:0:1 -:10:0:1 -:6:0:1 -:13:1:1 -:9:0:1 -:45:7:1 b:50:0:0 b:26:1:0 -:3:3:0 -:5:5:0",
)


class Marks(NamedTuple):
    """What the elements around a text say of it."""

    apart: int = 0  # 2: in a part with a text of its own; 1: in a notice or the like, which an inner article ends
    wrappers: tuple[tuple[int, bool], ...] = ()  # marks that may wrap a whole page: (element, is it a soft name)
    article: bool = False

    @property
    def boilerplate(self) -> bool:
        return bool(self.apart or self.wrappers)


NO_MARKS = Marks()


class Block:
    __slots__ = ("boilerplate", "heading", "linked", "marks", "parts", "words")

    def __init__(self, marks: Marks, heading: bool):
        self.parts: list[str] = []
        self.words = self.linked = 0
        self.marks, self.boilerplate, self.heading = marks, marks.boilerplate, heading

    @property
    def article(self) -> bool:
        return self.marks.article


def _marks(tag: str, attrs: str, inside: Marks, number: int) -> Marks:
    """Marks inside an element, from its own tag and names and from the element around it."""
    apart, wrappers, article = inside
    named = " ".join(a or b or c for a, b, c in _HINT_ATTRIBUTE.findall(attrs)) if attrs else ""
    names = [n for n in named.split() if not LAYOUT_WORD.search(n)] if named and tag not in ("html", "body") else []
    hinted = [n for n in names if BOILERPLATE_HINT.search(n)]
    article_named = any(ARTICLE_HINT.search(n) for n in names if n not in hinted)
    if tag in ARTICLE_TAGS:
        if not article and not hinted:  # the marks of the page around a first article end with it; comments and the like keep theirs
            apart, wrappers = (apart if apart == 2 else 0), ()
        article = True
    elif tag == "header":
        apart = apart or int(not article)  # an article's own header holds its headline
    elif tag in APART_TAGS:
        apart = 2
    elif tag == "dialog":
        apart = apart or 1
    elif tag in FORM_TAGS:
        wrappers += ((number, False),)
    if hinted:
        if not article_named and not (tag in ARTICLE_TAGS or tag == "header" and article):
            if any(APART_HINT.search(n) for n in hinted):
                apart = 2
            elif all(SOFT_HINT.search(n) for n in hinted):
                wrappers += ((number, True),)
            else:
                apart = apart or 1
    elif article_named:
        article, wrappers = True, tuple(w for w in wrappers if not w[1])
    return Marks(apart, wrappers, article)


def _without_page_wrappers(blocks: list[Block]) -> None:
    """A form or the like around all text of a page that is not marked otherwise says nothing of it."""
    inner = [b.marks.wrappers for b in blocks if not b.marks.apart and not b.heading]
    if len(inner) > 1 and all(inner):
        whole = set(inner[0]).intersection(*inner[1:])
        for b in blocks:
            b.boilerplate = bool(b.marks.apart or set(b.marks.wrappers) - whole)


def text_blocks(html: str) -> list[tuple[str, Block]]:
    """The text blocks of a page in order, with white space made single spaces."""
    out: list[Block] = []
    open_: list[tuple[str, Marks]] = []  # containers
    leaf: Marks | None = None  # marks of the open p, li, heading or the like
    leaf_tag = ""
    inline: list[str] = []  # other elements open in the block
    skipped: list[str] = []  # an element without text of the page, and those open in it
    heading, link = False, 0
    block: Block | None = None
    for m in _TOKEN.finditer(html):
        token = m.group()
        if token[0] != "<" or token == "<":
            if skipped:
                continue
            if block is None:
                around = leaf if leaf is not None else open_[-1][1] if open_ else NO_MARKS
                block = Block(around, heading)
                out.append(block)
            block.parts.append(token)
            if link:
                block.linked += len(token.split())
            continue
        tag = m.group("tag")
        if not tag:
            if m.group("skip") and m.group("skip").lower() in ("title", "iframe") and not skipped:
                block = None
            continue
        tag, closing = (tag[1:].lower(), True) if tag[0] == "/" else (tag.lower(), False)
        empty = m.group("attrs").rstrip().endswith("/")
        if skipped:
            if closing and tag in skipped:
                while skipped.pop() != tag:
                    pass
                continue
            # it ends with the element around it, some kinds also where text begins
            if not (closing and (tag == leaf_tag or tag in inline or any(t == tag for t, _ in open_)) or not closing and tag in TEXT_TAGS and CLOSED_BY_TEXT_TAGS.issuperset(t for t in skipped if t in SKIPPED_TAGS)):
                if not closing and not empty:
                    skipped.append(tag)
                continue
            skipped = []
        if tag in SKIPPED_TAGS:
            if tag == "select":
                block = None
            if not closing and not empty:
                skipped = [tag]
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
        elif tag in BLOCK_TAGS:
            block, link, leaf, leaf_tag = None, 0, None, ""
            inline.clear()
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in CONTAINERS:
                if not closing:
                    if not empty:
                        open_.append((tag, _marks(tag, m.group("attrs"), open_[-1][1] if open_ else NO_MARKS, m.start())))
                elif any(t == tag for t, _ in open_):
                    while open_.pop()[0] != tag:
                        pass
            elif not closing:
                leaf = _marks(tag, m.group("attrs"), open_[-1][1] if open_ else NO_MARKS, m.start())
                leaf_tag = tag
        elif tag not in VOID_TAGS:
            if closing and tag in inline:
                while inline.pop() != tag:
                    pass
            elif not closing and not empty:
                inline.append(tag)
    found = []
    for b in out:
        words = unescape("".join(b.parts)).split()
        if words:
            b.words = len(words)
            found.append((" ".join(words), b))
    _without_page_wrappers([b for _, b in found])
    return found


def features(words: np.ndarray, linked: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Feature rows of a page's blocks; marks: boilerplate, article and heading. The last feature is the page's words
    outside boilerplate marks."""
    density = linked / np.maximum(words, 1)
    before = lambda x: np.append(0, x[:-1])
    after = lambda x: np.append(x[1:], 0)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), marks, np.full(len(words), words[marks[:, 0] == 0].sum())])


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED:
        parts = [p.split(":") for p in page.split()]
        place = [p[0] for p in parts]
        marks = np.array([["b" in x, "a" in x or x == "h", x in "ho"] for x in place], float)
        rows.append(features(np.array([float(p[1]) for p in parts]), np.array([float(p[2]) for p in parts]), marks))
        labels += [int(p[3]) for p in parts]
    return np.vstack(rows), np.array(labels)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A decision tree by Gini impurity: a leaf is a label, a node (feature, threshold, below or at, above)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= limit
            n = left.sum()
            if least <= n <= len(y) - least:
                a, b = y[left].mean(), y[~left].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, float(limit)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return int(share >= 0.5)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[left], y[left], depth - 1, least), grow_tree(x[~left], y[~left], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    out = np.empty(len(x), bool)
    left = x[:, tree[0]] <= tree[1]
    out[left], out[~left] = classify(tree[2], x[left]), classify(tree[3], x[~left])
    return out


def main_text(html: str, tree) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of a page."""
    blocks = text_blocks(html)
    if not blocks:
        return "", 0, 0
    words = np.array([b.words for _, b in blocks], float)
    linked = np.minimum(np.array([b.linked for _, b in blocks], float), words)
    keep = classify(tree, features(words, linked, np.array([[b.boilerplate, b.article, b.heading] for _, b in blocks], float)))
    if words.max() < 12 and not linked.any() and not any(b.boilerplate or b.article for _, b in blocks):
        keep[:] = True  # a page without marks, links and longer texts: all there is
    return "\n\n".join(t for (t, _), k in zip(blocks, keep, strict=True) if k), len(blocks), int(keep.sum())


def _extracted(tree):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [main_text(html or "", tree) for html in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([k for _, _, k in found], pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every row of `pages` (page_id, url, html)."""
    tree = grow_tree(*labelled_table())
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extracted(tree), "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_kept int")
