"""Main text of web pages by tree scoring.

Paragraphs pass points, for their length and their commas, to their ancestors; a container's
points are discounted by its link density; the best container and those of its siblings that
look like it are kept, without the parts that are menus, notices, adverts and the like.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import text_slices
from fleetlens.llm.common import text_or_empty

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    # quotes count only behind an equals sign: elsewhere they are part of a name or a value
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

# Fixed values of HTML: elements without content, with raw text, and those that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre "
    "search section select summary table tbody td tfoot th thead tr ul br".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"},
    "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("ul ol dl table select article section div body".split())
# Never part of the text, wherever they stand.
DROPPED = frozenset(
    "head script style textarea title xmp iframe noembed noframes noscript template svg math canvas "
    "object embed audio video button select input nav menu footer aside dialog search".split())
FORMS = frozenset(["form", "fieldset"])
# Words of class, id and role that name what is not the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|disqus|reply|replies|"
    r"respond|footer|foot|menu|menubar|nav|navbar|navigation|breadcrumbs?|pagination|"
    r"pager|sidebar|side|aside|widget|related|recommend\w*|share|sharing|social|subscribe|newsletter|"
    r"signup|login|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|complementary|"
    r"contentinfo|search|toolbar|copyright|legal|disclaimer|alert|hidden)(?=$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
# Of these, words that are never part of a wrapper's name.
APART = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|comments?|disqus|respond|cookies?|consent|gdpr|newsletter|popup|modal|"
    r"hidden)(?=$|[\s_-])", re.I)
# Of these, words that also name parts of an article: there, only lists of links go by them.
IN_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:related|recommend\w*|side|notices?|notification|complementary|search|copyright|legal|disclaimer|"
    r"alert)(?=$|[\s_-])", re.I)
HOLDS_TEXT = frozenset("p pre td blockquote li dd div section article main body".split())
MIN_PARAGRAPH = 25
MAX_LINKED = 0.5
MOST = 0.5                  # a node with more than this share of a page's text is not dropped for its name


class Node:
    __slots__ = ("tag", "parent", "order", "hints", "parts", "points", "chars", "linked", "out", "wraps")

    def __init__(self, tag: str, parent: Node | None, order: int, hints: str):
        self.tag, self.parent, self.order, self.hints = tag, parent, order, hints
        self.parts: list[str | Node] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.out = self.wraps = False


def hints_of(attributes: str) -> str:
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    words = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            words.append("hidden")
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                words.append("hidden")
        elif name in ("class", "id", "role"):
            words.append(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
    return " ".join(words)


def parse(page: str) -> list[Node]:
    """The nodes of the tree in page order, the root first. Unclosed and stray tags are allowed."""
    root = Node("body", None, 0, "")
    nodes, stack, at = [root], [root], 0
    raw: str | None = None
    last = page.rfind(">") + 1      # no tag ends behind it
    for m in TOKEN.finditer(page, 0, last):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in ("p", "li", "td", "th", "tr") and stack[i].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in BLOCKS and tag != "br":
            # a block ends an open paragraph; list items, cells and options end their like
            ends = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        node = Node(tag, stack[-1], len(nodes), hints_of(m[3]))
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return nodes


def within_article(node: Node) -> bool:
    up = node.parent
    while up and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def in_form(node: Node) -> bool:
    up = node.parent
    while up and up.tag not in FORMS:
        up = up.parent
    return up is not None


def is_unlikely(node: Node, by_name: bool, forms: bool) -> bool:
    if node.tag in ("html", "body", "main"):
        return "hidden" in node.hints.split()
    if node.tag in DROPPED:
        return True
    if node.tag in FORMS:
        # a form around the page is a wrapper, whose controls alone go
        return not forms and not node.wraps
    if node.tag == "label":
        return in_form(node) or any(isinstance(x, Node) and x.tag in DROPPED for x in node.parts)
    if node.tag == "header":
        return not within_article(node)
    if not node.hints or node.tag == "article":
        return False
    by_name = by_name and not node.wraps
    if HEADER.search(node.hints):
        return by_name and not within_article(node)
    named = by_name and UNLIKELY.search(node.hints)
    if named and within_article(node):
        # whatever else the name says, or nothing but links
        named = UNLIKELY.search(IN_ARTICLE.sub(" ", node.hints)) or is_links(node)
    return bool(named) or "hidden" in node.hints.split()


def is_links(node: Node) -> bool:
    """Whether links hold most of the text below a node."""
    chars = linked = 0
    work: list[tuple[Node, bool]] = [(node, False)]
    while work:
        one, in_link = work.pop()
        in_link = in_link or one.tag == "a"
        for part in one.parts:
            if isinstance(part, Node):
                if part.tag not in DROPPED:
                    work.append((part, in_link))
            else:
                n = len(" ".join(part.split()))
                chars, linked = chars + n, linked + n * in_link
    return linked > MAX_LINKED * chars


def plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def measure(nodes: list[Node], by_name: bool = True, forms: bool = False) -> None:
    """Marks what is out, and sums characters and linked characters up the tree."""
    for node in nodes:
        node.out = node.parent is not None and (node.parent.out or is_unlikely(node, by_name, forms))
        node.points, node.chars, node.linked = 0.0, 0, 0
    for node in reversed(nodes):
        if node.out:
            continue
        own = sum(len(" ".join(plain(x).split())) for x in node.parts if isinstance(x, str))
        node.chars += own
        node.linked = node.chars if node.tag == "a" else node.linked
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def mark_wrappers(nodes: list[Node]) -> None:
    """Marks the forms and the nodes with an unlikely name that hold most of the page's text: of the characters of
    articles and main parts or, without any, of the points of paragraphs."""
    named = [n for n in nodes if n.tag in FORMS or n.hints and (UNLIKELY.search(n.hints) or HEADER.search(n.hints))]
    if not named:
        return
    measure(nodes, by_name=False, forms=True)
    held = [0.0] * len(nodes)
    for node in nodes:
        if node.tag in ("article", "main") and not node.out and not within_article(node):
            held[node.order] = float(node.chars - node.linked)
    by_points = not any(held)
    if by_points:
        for node in nodes:
            held[node.order] = points_of(node)
    inside = held[:]
    for node in reversed(nodes):
        if node.parent:
            inside[node.parent.order] += inside[node.order]
    total = inside[0]
    for node in named:
        own = inside[node.order]
        if not by_points and within_article(node):
            own = float(node.chars - node.linked) if not node.out else 0.0
        node.wraps = own > MOST * total and not (APART.search(node.hints) and (by_points or within_article(node)))


def points_of(node: Node) -> float:
    if node.out or node.tag not in HOLDS_TEXT:
        return 0.0
    text = " ".join(inline_text(node).split())
    return 1.0 + text.count(",") + min(len(text) // 100, 3) if len(text) >= MIN_PARAGRAPH else 0.0


def score(nodes: list[Node]) -> Node | None:
    """Spreads points and returns the best container, None if no paragraph has any."""
    for node in nodes:
        points = points_of(node)
        if not points:
            continue
        up, level = (node.parent if node.tag in ("p", "pre", "td", "li", "dd", "blockquote") else node), 0
        while up is not None and level < 4:
            up.points += points / (1, 2, 6, 9)[level]
            up, level = up.parent, level + 1
    best = None
    for node in nodes:
        node.points *= 1 - node.linked / max(node.chars, 1)
        if not node.out and node.points > (best.points if best else 0):
            best = node
    return best


def inline_text(node: Node) -> str:
    """The text of a node without the blocks in it."""
    out, work = [], [node]
    while work:
        part = work.pop()
        if isinstance(part, str):
            out.append(plain(part))
        elif part is node or not part.out and part.tag not in BLOCKS:
            work += reversed(part.parts)
    return "".join(out)


def blocks_of(root: Node) -> Iterator[str]:
    """The text of each block below ``root`` in page order, white space as single spaces."""
    open_text: list[str] = []
    work: list[tuple[Node, int]] = [(root, 0)]
    while work:
        node, i = work.pop()
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if isinstance(part, str):
                open_text.append(plain(part))
            elif not part.out:
                if part.tag in BLOCKS:
                    yield "".join(open_text)
                    open_text = []
                work += [(node, i), (part, 0)]
                break
        else:
            if node.tag in BLOCKS:
                yield "".join(open_text)
                open_text = []
    yield "".join(open_text)


def kept_parts(best: Node) -> list[Node]:
    """The best container, or the article around it, and siblings that look like it."""
    up = best
    while up.parent is not None:
        if up.parent.tag in ("article", "main"):
            best = up.parent
        up = up.parent
    if best.tag in ("td", "tr", "tbody", "li", "ul", "ol", "p", "pre", "blockquote", "dd", "dl"):
        while best.parent is not None and best.tag in (
                "td", "tr", "tbody", "thead", "table", "li", "ul", "ol", "p", "pre", "blockquote", "dd", "dl"):
            best = best.parent
    if best.parent is None:
        return [best]
    limit, keep = max(10.0, best.points * 0.2), []
    for x in best.parent.parts:
        if not isinstance(x, Node) or x.out:
            continue
        density = x.linked / max(x.chars, 1)
        similar = x.points + (best.points * 0.2 if x.hints and x.hints == best.hints else 0) >= limit
        paragraph = x.tag == "p" and (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and not x.linked)
        heading = x.tag in ("h1", "h2", "h3") and density < 0.25 and x.order < best.order
        if x is best or similar or paragraph or heading:
            keep.append(x)
    return keep


def main_text(page: str) -> str:
    """The article of a page: character references decoded, white space inside a block as one
    space, blocks trimmed and joined by one space. Pages without paragraphs of some length give
    all their text outside menus and the like; the empty page gives the empty text."""
    if not page:
        return ""
    nodes = parse(page)
    mark_wrappers(nodes)
    measure(nodes)
    best = score(nodes)
    if best is None and not nodes[0].chars:
        # names alone must not empty a page: without them, is there an article?
        measure(nodes, by_name=False)
        best = score(nodes)
        if best is None:
            measure(nodes)
    parts = [nodes[0]] if best is None else kept_parts(best)
    for node in nodes:
        # lists of links are menus, whatever they are called; in an article they are part of it
        if (node.tag in ("ul", "ol", "div", "section", "table") and node.chars and node not in parts
                and not within_article(node)):
            links = sum(isinstance(x, Node) and (x.tag == "a" or x.linked > 0) for x in node.parts)
            if links > 2 and node.linked > MAX_LINKED * node.chars:
                node.out = True
    blocks = (" ".join(b.split()) for part in parts for b in blocks_of(part))
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row of ``pages``. Null html is the empty page; null ids
    and urls stay null; repeated rows give equal rows; the whole page is parsed, whatever its
    length. An empty table gives an empty result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed(
        {"id": id_col, "url": url_col})
