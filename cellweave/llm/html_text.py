"""Main text of web pages by composite text density.

The page becomes a tree.  Menus, headers, footers, asides, scripts and styles (by element) and hidden elements are taken away.
Forms, and elements with a boilerplate word in class, id or role, only go if they are small (a quarter of the text, half of it for
words that say so in any place, or beside a main element or article with no less) or mostly links, and hold neither
the main element or largest article nor most of the page's text outside links; if without such an element all that went by words were
most of that text, only mostly links go.  Every node then has characters C, tags T,
characters LC and tags LT inside links, and the density

    C / T * log(C / LC * T / LT) / log(log(C * LC / (C - LC) + LC of body / C of body * C + e) + 1)

with counts of zero taken as one.  The subtree whose child blocks' densities have the greatest sum is the main text.  The least
density on the path from it to the body is the threshold: every branch beside the path that reaches it is main text too, with
what lies between such branches and isn't mostly links, and headings right before them.  All of the path reaches the threshold; the
outermost article or main element on it, if there is one, bounds the main text instead.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Tags, with quoted attribute values as wholes (a quote only counts after an equals sign) ...
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?][^>]*>", re.S)
#: ... and as they are read once a tag doesn't end: up to the next >, so that broken pages take no longer than others.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_OPENING = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = frozenset("ul ol dl table select menu tbody thead".split())
DROPPED = frozenset("head nav header footer aside script style noscript button select textarea iframe template svg object dialog menu input title".split())
#: Words that call an element boilerplate wherever they stand in a class, id or role ...
_STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|sidebar\w*|navbar|breadcrumbs?|masthead|cookies?|consent|gdpr|popup|newsletter|subscribe|signup|login|comments?|respond|replies|disqus|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: ... and those that only do alone, or with a word of layout before or behind them (section-header or social-science say nothing).
_LAYOUT = r"(?:site|page|main|global|top|bottom|primary|secondary|left|right|post|article|entry|blog)"
_KIND = r"(?:bar|bars|links?|buttons?|box|menu|list|nav|area|container|wrap|wrapper|block|panel|posts|articles|items|form|inner|icons?|message|content)"
_WEAK = re.compile(
    rf"(?:^|\s)(?:{_LAYOUT}[_-])?(?:banner|side-?bar|menu|nav|navigation|header|footer|foot|notices?|notification|modal|overlay|subscription|share|sharing|social|related|recommend\w*|widget\w*|toolbar|search|complementary|contentinfo|alert|skip)"
    rf"(?:[_-]{_KIND}|[_-]\d+)?(?:$|\s)",
    re.I,
)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "drop", "soft", "strong", "c", "t", "lc", "lt", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, soft: bool = False, strong: bool = False):
        self.tag, self.parent, self.drop, self.soft, self.strong, self.kids = tag, parent, drop, soft, strong, []


def _dropped(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element goes for certain, whether its words call it boilerplate, and whether they do so wherever they stand."""
    if tag in DROPPED:
        return True, False, False
    soft, strong = tag == "form", False
    if tag in ("html", "body", "article", "main") or not attrs:
        return False, soft, strong
    for kind, a, b, c, hidden in _ATTR.findall(attrs):
        value = a or b or c
        if hidden or (kind.lower() == "aria-hidden" and value.lower() == "true") or (kind.lower() == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, soft, strong
        if kind.lower() in ("class", "id", "role"):
            strong = strong or _STRONG.search(value) is not None
            soft = soft or strong or _WEAK.search(value) is not None
    return False, soft, strong


class _Path:
    """The open elements, outermost first, with the depths at which the tags that rules ask for stand: no rule walks the path."""

    def __init__(self, body: Node):
        self.nodes = [body]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        for name in (node.tag, *(k for k, tags in _SETS.items() if node.tag in tags)):
            self.at.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at a depth, with all in it."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            for name in (node.tag, *(k for k, tags in _SETS.items() if node.tag in tags)):
                self.at[name].pop()

    def deepest(self, *names: str) -> int:
        """Depth of the innermost open element of these tags or sets, 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


#: Sets of tags whose innermost element rules ask for.
_SETS = {"(block)": BLOCK, "(holds)": HOLDS, "(whole)": frozenset(("article", "main"))}


def parse(page: str) -> Node:
    root = Node("html", None)
    body = Node("body", root)
    root.kids.append(body)
    path, pos, n, soft = _Path(body), 0, len(page), []
    last, tags = page.rfind(">") + 1, _TAG
    ends: dict[str, bool] = {}
    while pos < n:
        at, i = path.nodes[-1], page.find("<", pos)
        if i < 0 or i >= last:  # no tag ends from here on
            at.kids.append(page[pos : i if i >= 0 and page.startswith("<!--", i) else n])
            break
        m = tags.match(page, i)
        if m is None and tags is _TAG and _OPENING.match(page, i):
            tags = _PLAIN  # this tag runs to the end of the page
            m = tags.match(page, i)
        if (i if m else i + 1) > pos:
            at.kids.append(page[pos : i if m else i + 1])
        pos = m.end() if m else i + 1
        if m is None:
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = path.deepest(tag)
            if depth and (tag in BLOCK or depth > path.deepest("(whole)")):
                path.cut(depth)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:  # a block ends an open paragraph, also one with inline elements left open
            depth = path.deepest("(block)")
            if depth and path.nodes[depth].tag == "p":
                path.cut(depth)
        if tag in CLOSES:
            depth = path.deepest(*CLOSES[tag])
            if depth and depth > path.deepest("(holds)") or depth and path.nodes[depth].tag in HOLDS and depth == path.deepest("(holds)"):
                path.cut(depth)
                while path.nodes[-1].tag in CLOSES[tag]:
                    path.cut(len(path.nodes) - 1)
        attrs, at = m[3] or "", path.nodes[-1]
        node = Node(tag, at, *_dropped(tag, attrs))
        if tag == "header" and path.deepest("(whole)"):
            node.drop = False  # an article's own title
        node.drop |= at.drop
        at.kids.append(node)
        if node.soft and not node.drop:
            soft.append(node)
        if tag in RAW:
            end = None
            if ends.get(tag, True):  # else none was found before
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos, max(pos, last))
                ends[tag] = end is not None
            if not node.drop:
                node.kids.append(page[pos : end.start() if end else n])
            pos = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            path.push(node)
    if soft:
        _settle(body, soft)
    return body


def _count(body: Node) -> list[tuple[Node, bool]]:
    """Nodes that aren't dropped, with whether they are in a link, parents first; c, t, lc and lt are set."""
    order, stack = [], [(body, False)]
    while stack:
        node, link = stack.pop()
        node.c = node.t = node.lc = node.lt = 0
        order.append((node, link or node.tag == "a"))
        stack += [(k, link or node.tag == "a") for k in node.kids if isinstance(k, Node) and not k.drop]
    for node, link in reversed(order):
        own = sum(len(_SPACE.sub("", html.unescape(k))) for k in node.kids if isinstance(k, str))
        node.c += own
        node.lc += own * link
        if node.parent is not None and node is not body:
            p = node.parent
            p.c, p.t, p.lc, p.lt = p.c + node.c, p.t + node.t + 1, p.lc + node.lc, p.lt + node.lt + (node.tag == "a")
    return order


def _settle(body: Node, soft: list[Node]) -> None:
    """Drop what words call boilerplate, unless it holds the page's text; what then stays beside an article or main adds nothing to its parent's sum."""
    nodes = [x for x, _ in _count(body)]  # parents first
    text = body.c - body.lc
    holders = {x for x in nodes if x.tag == "main" and x.c > x.lc}
    articles = [x for x in nodes if x.tag == "article" and x.c > x.lc]
    if articles:
        holders.add(max(articles, key=lambda x: x.c - x.lc))
    held: set[Node] = set()  # above some holder
    for x in reversed(nodes):
        if (x in holders or x in held) and x.parent is not None:
            held.add(x.parent)
    inner: set[Node] = set()  # within some holder
    for x in nodes:
        if x.parent in holders or x.parent in inner:
            inner.add(x)
    most = max((x.c - x.lc for x in holders), default=0)
    small, links = set(), set()
    for x in soft:
        inside = x in inner
        x.soft = bool(holders) and not inside and x not in held
        if x in held:
            continue
        if x.strong and x.soft:  # beside an article
            small.add(x)
        elif 2 * (x.c - x.lc) > text:
            continue
        elif 2 * x.lc >= x.c:
            links.add(x)
        elif (2 if x.strong else 4) * (x.c - x.lc) <= text or (not inside and x.c - x.lc <= most):
            small.add(x)
    below: set[Node] = set()  # within some small one
    for x in nodes:
        if x.parent in small or x.parent in below:
            below.add(x)
    if not holders and 2 * sum(x.c - x.lc for x in small if x not in below) > text:
        small = set()
    for x in small | links:
        x.drop = True


def _measure(body: Node) -> list[Node]:
    """Kept nodes, with their counts and densities."""
    order = _count(body)
    ratio = body.lc / max(body.c, 1)
    for node, _ in reversed(order):
        c, t, lc, lt = node.c, max(node.t, 1), max(node.lc, 1), max(node.lt, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(math.log(c * node.lc / max(c - node.lc, 1) + ratio * c + math.e) + 1)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / base
        node.total = sum(k.density for k in node.kids if isinstance(k, Node) and not k.drop and not k.soft and k.tag in BLOCK)
    return [node for node, _ in order]


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _parts(parent: Node, path: Node, threshold: float) -> tuple[list, list[bool]]:
    """What a node on the path holds (elements with text, and strings), and which of it belongs to the main text.

    Branches that reach the threshold do, with the one on the path; so does what lies between two of them and is not
    mostly links, and a heading right before one.  If all elements do, all strings do.
    """
    kids = [k for k in parent.kids if (k.strip() if isinstance(k, str) else not k.drop and k.c)]
    keep = [isinstance(k, Node) and (k is path or k.density >= threshold) for k in kids]
    if all(x or isinstance(k, str) for k, x in zip(kids, keep, strict=True)):
        return kids, [True] * len(kids)
    at = [i for i, x in enumerate(keep) if x]
    for i in range(at[0], at[-1]):
        keep[i] = keep[i] or isinstance(kids[i], str) or 2 * kids[i].lc < kids[i].c
    for i in reversed(range(len(kids) - 1)):
        if keep[i + 1] and isinstance(kids[i], Node) and kids[i].tag in HEADINGS and 2 * kids[i].lc < kids[i].c:
            keep[i] = True
    return kids, keep


def _spread(path: Node, threshold: float) -> bool:
    """Whether the main text takes in more of the parent than this branch, or all that it holds."""
    kids, keep = _parts(path.parent, path, threshold)
    return all(keep) or sum(keep) > 1


def _strip(path: Node, threshold: float) -> None:
    """Take from the parent what isn't main text."""
    kids, keep = _parts(path.parent, path, threshold)
    gone = {id(k) for k, x in zip(kids, keep, strict=True) if not x}
    path.parent.kids = [k for k in path.parent.kids if id(k) not in gone]


def main_node(body: Node) -> Node:
    nodes = _measure(body)
    best = max(nodes, key=lambda x: x.total)  # the first in page order, of equals
    if best.total <= 0:
        best = body
    path, up = [], best
    while up is not None and up is not body:
        path.append(up)
        up = up.parent
    around = [x for x in path if x.tag in ("article", "main")]
    if around:
        return around[-1]
    if best is not body:
        threshold = min(x.density for x in (*path, body))
        top = best
        for x in path:
            if _spread(x, threshold):
                top = x.parent
        for x in path[: path.index(top)] if top in path else path if top is body else []:
            _strip(x, threshold)
        best = top
    else:
        threshold = body.density
    # Of the main text itself, blocks of links that don't reach the threshold go.
    best.kids = [k for k in best.kids if isinstance(k, str) or k.drop or k.tag not in BLOCK or k.density >= threshold or 2 * k.lc < k.c or not k.c]
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif not x.drop:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            elif x.tag in ("br", "img", "wbr"):
                held.append(" " if x.tag == "br" else "")
            stack += reversed(x.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(main_node(parse(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page row; empty text for null, blank or boilerplate-only pages.

    Character references are decoded, white space within a block becomes one space, blocks are joined by a newline.
    Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
