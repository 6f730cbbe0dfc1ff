"""Main-text extraction from html by a minimum cut.

A page is a sequence of text blocks. A linear classifier scores each block from its containers,
link density, length and tag; softplus of the score are the two costs of a wrong label and become
the block's terminal capacities. Neighbouring blocks, and blocks of the same DOM parent, are tied
by smoothness edges that are weaker the further apart they are in the tree. The minimum cut of
this graph separates content from boilerplate.

Pages are independent rows, so Spark deals them out and nothing is shuffled; each row costs memory
in proportion to its own html.

Defined results: null or empty html gives the empty text; html without markup is one block;
unclosed elements are read to the page's end; a tag, comment or declaration that the end cuts off is dropped, and so is a malformed declaration; repeated rows give equal texts.
Columns other than the html column pass through; a ``text`` or ``n_chars`` among them is replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of html elements, and words that sites use in class and id attributes.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT_WORDS = frozenset("article articlebody post postbody entry story content main maincontent body text".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar header masthead footer sidebar aside widget related recommended comment comments commentlist respond disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager tags toolbar search copyright legal disclaimer form".split())
#: Words that say little where they stand inside content.
MILD_WORDS = frozenset("widget header masthead banner legal form search tags toolbar".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Boilerplate that stays so whatever it holds, as reader comments written as articles.
HARD_TAGS = frozenset("nav footer aside menu dialog".split())
HARD_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored sponsors nav navbar navigation menu menubar footer aside related recommended comment comments commentlist respond disqus reply replies cookie cookies consent gdpr".split())
CLOSES_P = BLOCK_TAGS - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
SELF_CLOSING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}

#: The classifier's weights: log-odds of content. A mark of boilerplate outweighs all else; without marks, length
#: and sentences speak for content and links against it, so a block alone may be wrong and its neighbours decide.
WEIGHTS = {"bias": 0.2, "content": 3.0, "boiler": -6.0, "mild": -5.5, "links": -3.0, "length": 0.45, "sentence": 0.4, "p": 0.6, "heading": 0.4, "item": -0.3, "legal": -1.5}
MOST_LENGTH = 2.0
#: Smoothness: between neighbours (less with their distance in the tree), and between blocks of one parent.
NEAR, SIBLING = 1.5, 0.75
_WORD = re.compile(r"[a-z]+")
_COMMENT, _COMMENT_END, _TAG_END, _TAG = re.compile("-?>"), re.compile("--!?>"), re.compile(">"), re.compile("</?[a-zA-Z]")
#: A document type with declarations of its own in brackets.
_SUBSET = re.compile(r"<!doctype[^>\[]*\[[^\]]*\]\s*>", re.I)


def _names(own: dict) -> tuple[set[str], set[str]]:
    """Words that are a whole class or id, and words that are only a part of one (has-sidebar, header-fixed)."""
    whole = set(f"{own.get('class') or ''} {own.get('id') or ''}".lower().split())
    return whole, {w for name in whole for w in _WORD.findall(name)} - whole


class _Element:
    """An open element. mark: 1 inside content, -1 inside boilerplate, 0 in neither; the nearest marked ancestor
    decides, but only an article or main element is content inside boilerplate, and none inside hard boilerplate.
    mild: inside content, but a class word speaks against it, which its length and neighbours may overrule.

    own: what the element itself says: 1 content by its tag or role, 2 content by a word, -1 boilerplate, -2 hard boilerplate; weak: it says so by a part of a
    name, or as a form, which is void where the element holds most of the page's text."""

    __slots__ = ("tag", "mark", "hard", "mild", "own", "weak", "soft", "size", "silent", "link", "depth", "parent", "block")

    def __init__(self, tag: str, attrs: list, parent: _Element | None):
        self.tag, self.parent, self.size = tag, parent, 0
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK_TAGS or not parent else parent.block
        own = dict(attrs)
        whole, parts = _names(own) if tag not in ("html", "body") else (set(), set())
        role = (own.get("role") or "").lower()
        self.mark, self.hard, self.mild, self.own = 0, False, False, 0
        strong = tag in BOILER_TAGS - {"form"} or role in BOILER_ROLES or bool(whole & BOILER_WORDS) or own.get("aria-hidden") == "true"
        self.weak = not strong
        self.soft = not (tag in BOILER_TAGS or role in BOILER_ROLES or own.get("aria-hidden") == "true" or (whole | parts) & BOILER_WORDS - MILD_WORDS)
        if strong or tag == "form" or parts & BOILER_WORDS:
            self.own = -2 if tag in HARD_TAGS or (whole | parts) & HARD_WORDS else -1
        elif tag in CONTENT_TAGS or role in ("main", "article"):
            self.own = 1
        elif (whole | parts) & CONTENT_WORDS:
            self.own = 2
        self.silent = tag in SILENT_TAGS or "hidden" in own or bool(parent and parent.silent)
        self.link = tag == "a" or bool(parent and parent.link)

    def settle(self, total: int) -> None:
        """Find the mark, after the parent's; ``total``: characters of the page."""
        up, own = self.parent, self.own
        if up:
            self.mark, self.hard, self.mild = up.mark, up.hard, up.mild
        if own < 0 and self.weak and 2 * self.size > total:
            own = 0
        if own == -1 and self.mark == 1 and self.soft:
            self.mild = True
        elif own < 0:
            self.mark, self.mild = -1, False
            self.hard = self.hard or own == -2
        elif own == 1:
            self.mark, self.mild = (-1 if self.hard else 1), False
        elif own == 2 and self.mark == 0:
            self.mark = 1


class Block:
    __slots__ = ("parts", "linked", "element")

    def __init__(self, element: _Element):
        self.parts: list[str] = []
        self.linked = 0
        self.element = element

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Blocks(HTMLParser):
    """The page's text blocks in page order. ``depths``: where elements of a tag are open, so that no tag is looked for in vain."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = _Element("html", [], None)
        self.elements = [self.top]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[tuple[str, Block]] = []
        self.now: Block | None = None
        self.in_head = False

    def parse_html_declaration(self, i: int) -> int:
        """Everything that starts with <! is a comment up to its end, or up to the page's; nothing of it is text."""
        end = _SUBSET.match(self.rawdata, i) or _TAG_END.search(self.rawdata, i)
        return end.end() if end else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = _COMMENT.match(self.rawdata, i + 4) or _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        end = _TAG_END.search(self.rawdata, i)
        return end.end() if end else len(self.rawdata)

    def _break(self) -> None:
        if self.now and (text := self.now.text):
            self.blocks.append((text, self.now))
        self.now = None

    def _up_to(self, depth: int) -> None:
        """Close all elements from the top down to the one at ``depth``."""
        while self.top.depth >= depth:
            self.depths[self.top.tag].pop()
            self.top = self.top.parent

    def _close(self, tag: str, stop: tuple = ()) -> None:
        """Close the nearest open element of a tag and all in it, unless one of the tags of ``stop`` is nearer."""
        open_ = self.depths[tag]
        if open_ and not any(self.depths[s] and self.depths[s][-1] > open_[-1] for s in stop):
            self._up_to(open_[-1])

    def _leave_head(self, always: bool = False) -> None:
        """Close an open head, whose end tag is optional, and what is open in it; a noscript or template in it ends at its own end tag or at body."""
        head = self.depths["head"]
        if head and not always and any(self.depths[t] and self.depths[t][-1] > head[0] for t in ("noscript", "template")):
            return
        self.in_head = False
        if head:
            self._up_to(head[0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.in_head and tag not in HEAD_TAGS:
            self._leave_head(tag == "body")
        elif tag == "head":
            self.in_head = True
        if tag in BLOCK_TAGS:
            self._break()
            if tag in CLOSES_P:
                self._close("p", ("div", "article", "section", "td", "li", "body", "main", "aside", "nav", "footer", "header", "form", "blockquote"))
            if tag in SELF_CLOSING:
                self._close(tag, SELF_CLOSING[tag])
        elif tag == "br" and self.now:
            self.now.parts.append(" ")
        if tag not in VOID_TAGS:
            self.top = _Element(tag, attrs, self.top)
            self.elements.append(self.top)
            self.depths[tag].append(self.top.depth)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._break()
        if tag not in VOID_TAGS:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.in_head and self.top.tag == "head" and data.strip():
            self._leave_head()
        if self.top.silent:
            return
        if not self.now:
            self.now = Block(self.top.block)
        self.now.parts.append(data)
        if self.top.link:
            self.now.linked += len(data)

    def settle(self) -> None:
        """End the page: find what each element holds, children first, and its mark, parents first."""
        self._break()
        for text, block in self.blocks:
            block.element.size += len(text)
        for e in reversed(self.elements):
            if e.parent:
                e.parent.size += e.size
        total = self.elements[0].size
        for e in self.elements:
            e.settle(total)


def score(text: str, block: Block) -> float:
    """Log-odds that the block is content."""
    e, w = block.element, WEIGHTS
    s = w["bias"] + w["content"] * (e.mark > 0) + w["boiler"] * (e.mark < 0) + w["mild"] * e.mild
    s += w["links"] * min(1.0, block.linked / max(1, len(text))) + min(MOST_LENGTH, w["length"] * math.log1p(text.count(" ")))
    s += w["sentence"] * (text[-1] in ".!?…”\"") + w["legal"] * ("©" in text or "(c)" in text)
    if e.tag == "p":
        s += w["p"]
    elif len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1].isdigit():
        s += w["heading"]
    elif e.tag in ("li", "td", "th", "dt", "dd"):
        s += w["item"]
    return s


def apart(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def smoothness(elements: list[_Element]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and blocks of one parent, but for a block of content and one of boilerplate by their marks."""
    edges, last = [], {}
    for i, e in enumerate(elements):
        if i and e.mark * elements[i - 1].mark >= 0:
            edges.append((i - 1, i, NEAR / (1 + apart(elements[i - 1], e))))
        key = id(e.parent or e)
        if key in last and e.mark * elements[last[key]].mark >= 0:
            edges.append((last[key], i, SIBLING))
        last[key] = i
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it stays on the source's side.

    Node i has capacity softplus(gain) from the source and softplus(-gain) to the sink; what both
    share flows straight through, so only the difference is kept. Blocking flows over level graphs
    raise the flow until no path is left.
    """
    n = len(gain)
    surplus, room = [max(0.0, g) for g in gain], [max(0.0, -g) for g in gain]
    arcs: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        cap += (c, c)
    eps = 1e-9

    def levels() -> list[int]:
        level = [-1] * n
        front = [i for i in range(n) if surplus[i] > eps]
        for i in front:
            level[i] = 0
        while front:
            reached = []
            for i in front:
                for k in arcs[i]:
                    if cap[k] > eps and level[to[k]] < 0:
                        level[to[k]] = level[i] + 1
                        reached.append(to[k])
            front = reached
        return level

    while True:
        level = levels()
        if not any(level[i] >= 0 and room[i] > eps for i in range(n)):
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            while surplus[start] > eps:
                path, i = [], start
                while True:
                    if room[i] > eps:
                        push = min([surplus[start], room[i], *(cap[k] for k in path)])
                        surplus[start] -= push
                        room[i] -= push
                        for k in path:
                            cap[k] -= push
                            cap[k ^ 1] += push
                        break
                    while at[i] < len(arcs[i]):
                        k = arcs[i][at[i]]
                        if cap[k] > eps and level[to[k]] == level[i] + 1:
                            break
                        at[i] += 1
                    if at[i] < len(arcs[i]):
                        path.append(arcs[i][at[i]])
                        i = to[path[-1]]
                    elif path:  # dead end
                        i = to[path.pop() ^ 1]
                        at[i] += 1
                    else:
                        break
                if at[start] >= len(arcs[start]) and not path and i == start and room[start] <= eps:
                    break


def labelled(html: str | None) -> list[tuple[str, float, bool]]:
    """(text, classifier's log-odds of content, whether the cut keeps it) of each block in page order."""
    parser = _Blocks()
    parser.feed(html or "")
    if _TAG.match(parser.rawdata):  # what is left unread is a tag that the page's end cuts off
        parser.rawdata = ""
    parser.close()
    parser.settle()
    gain = [score(t, b) for t, b in parser.blocks]
    keep = minimum_cut(gain, smoothness([b.element for _, b in parser.blocks]))
    return [(t, g, k) for (t, _), g, k in zip(parser.blocks, gain, keep)]


def main_text(html: str | None) -> str:
    return "\n".join(t for t, _, k in labelled(html) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of the html column."""
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(html)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=None, names=[*names, "text", "n_chars"])

    return pages.select(*names, html).mapInArrow(extracted, schema)
