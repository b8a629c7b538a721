"""Main-text extraction by tag-path ratios.

Elements that never hold article text (menus, forms, scripts, notices,
comments, ...) are left out by tag or by class, id and role words.  The text of
the whole page is then gathered per root-to-leaf tag path, element numbers left
out: the ratio of a path is its text length, weighted by punctuation and
without most of its link text, over its number of blocks.  Ratios are smoothed
over neighbouring blocks of related elements, and every block at or above
``keep_share`` of the page's highest smoothed ratio is content, in however many
containers.  Neighbours are fused to it: blocks of the same container and
short runs between content, unless they are links.  An article or main element
with content is kept as one; where these hold at least half of the page's
weighted text, nothing outside them is content.

Defined cases: null or empty html gives an empty text; broken markup is read
leniently (open paragraphs and list items close by themselves); other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("head title nav footer aside form script style noscript template button select textarea iframe svg "
                 "canvas object audio video menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img br".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|comments?|disqus|"
                   r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|"
                   r"recommend\w*|newsletter|subscribe|popup|modal|toolbar|widget|login|search|pagination|pager|skip)(?:$|[\s_-])", re.I)
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
CONTAINERS = frozenset(("article", "main"))
BOXES = frozenset(("html", "body", "div", "section"))
WITHIN = frozenset("ul ol li dl dt dd table thead tbody tr td th blockquote pre figure figcaption".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟।]")
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "tr": frozenset(("tr", "td", "th")),
          "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}


class PathText(HTMLParser):
    """Blocks of text with their tag paths."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []   # tag, element number, noise
        self.count = 0
        self.blocks: list[tuple[tuple, str, int]] = []   # path, text, characters in links
        self.text: list[str] = []
        self.linked = 0
        self.path: tuple = ()

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            self.blocks.append((self.path, " ".join(words), self.linked))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
            closes = CLOSES.get(tag, frozenset(("p",)))
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in closes:
                    del self.stack[i:]
                    break
                if self.stack[i][0] not in INLINE:
                    break
        said = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" for k, _ in attrs)
        header = tag == "header" and not any(t in CONTAINERS for t, _, _ in self.stack)
        noise = bool(self.stack and self.stack[-1][2]) or tag in SKIP or header or hidden or (
            tag not in ("html", "body", *CONTAINERS) and NOISE.search(said) is not None)
        self.count += 1
        self.stack.append((tag, self.count, noise))

    def parse_marked_section(self, i, report=1):
        # A section that is none (``<![foo[x]]>``, ``<![ x>``) is a comment.
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            if not self.text or not "".join(self.text).strip():
                self.path = tuple((t, n) for t, n, _ in self.stack if t not in INLINE)
            self.text.append(data)
            if any(t == "a" for t, _, _ in self.stack):
                self.linked += len(data.strip())


def _marked(path: tuple) -> tuple | None:
    """The outermost article or main element."""
    for i, (tag, _) in enumerate(path):
        if tag in CONTAINERS:
            return path[:i + 1]
    return None


def _container(path: tuple) -> tuple:
    """The outermost article or main element, else the parent of the block;
    lists, tables and quotes count to the element they are in."""
    marked = _marked(path)
    if marked:
        return marked
    own = path[:-1] if path and path[-1][0] not in BOXES else path
    while own and own[-1][0] in WITHIN:
        own = own[:-1]
    return own


def _related(a: tuple, b: tuple) -> bool:
    """Whether the parent of one block, below the body, holds the other."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    parent = short[:-1]
    return bool(parent) and parent[-1][0] not in ("html", "body") and long[:len(parent)] == parent


def extract(html: str | None, keep_share: float = 0.25) -> str:
    if not html:
        return ""
    parser = PathText()
    # A tag that the page's end cuts off is no text.
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return ""
    own = [(len(t) - 0.8 * min(linked, len(t))) * (1.0 + len(PUNCTUATION.findall(t)) / (1.0 + len(t.split())))
           for _, t, linked in blocks]
    tags = [tuple(t for t, _ in path) for path, _, _ in blocks]
    total: dict[tuple, float] = {}
    for t, v in zip(tags, own):
        total[t] = total.get(t, 0.0) + v
    count = Counter(tags)
    ratio = [total[t] / count[t] for t in tags]
    n = len(blocks)
    smooth = []
    for i in range(n):
        near = [ratio[j] for j in range(max(0, i - 2), min(n, i + 3)) if j != i and _related(blocks[i][0], blocks[j][0])]
        smooth.append((2 * ratio[i] + sum(near)) / (2 + len(near)))
    marked = [_marked(path) for path, _, _ in blocks]
    if 2 * sum(v for v, m in zip(own, marked) if m) >= sum(own):
        inside = [m is not None for m in marked]
    else:
        inside = [True] * n
    least = keep_share * max(v for v, x in zip(smooth, inside) if x)
    links = [2 * linked > len(t) for _, t, linked in blocks]
    seed = [x and v >= least and not (link and m is None and r < least)
            for x, v, link, m, r in zip(inside, smooth, links, marked, ratio)]
    kept = {_container(b[0]) for b, x in zip(blocks, seed) if x}
    content = [x or (y and _container(b[0]) in kept and (m is not None or not link))
               for b, x, y, m, link in zip(blocks, seed, inside, marked, links)]
    last = None
    for i in range(n):
        if not content[i]:
            continue
        if last is not None and 1 < i - last <= 4:
            depth = next((d for d, (x, y) in enumerate(zip(blocks[last][0], blocks[i][0])) if x != y),
                         min(len(blocks[last][0]), len(blocks[i][0])))
            shared = blocks[i][0][:depth]
            if shared and shared[-1][0] not in ("html", "body"):
                for j in range(last + 1, i):
                    content[j] = inside[j] and not links[j] and blocks[j][0][:depth] == shared
        last = i
    return "\n".join(b[1] for b, x in zip(blocks, content) if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pid = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = b.column("html")
            texts = [extract(html[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pid}, url string, text string, n_chars long")
