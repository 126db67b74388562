"""Main text of web pages by composite text density.

A page is parsed into a tree of elements. Every node gets its characters, tags,
link characters and link tags, and from these its density: characters per tag,
reduced the more of them stand in links, relative to the page. A node's density
sum is the sum of its children's densities. The node with the greatest density
sum holds the content; the least density on its path to the body is the
threshold above which other parts of the body are searched for content in the
same way. Only blocks count in the sums; inline elements belong to the block around them.

Elements that are never content (menus, forms, notices, scripts, ...) are recognised by tag
or role, or by a class or id that names them (its last word that is not a general one: ``user-comments``,
``ad-box``), and take no part. Where such a word only stands before another (``related-work``), the
element must be made up of links or list items, hold a form, or have a few characters only and be less
dense than the threshold.

Bare text and inline elements beside blocks take part as an anonymous block: a
node of its own with a density that counts in its parent's sum, searched like
any other. It is no tag, and line breaks in it count as none. Inline elements
are never chosen alone, as the text around them belongs to them.

Null or empty pages give an empty text. Unclosed, misnested and cut-off markup
is taken as browsers take it, roughly: an unknown end is ignored, an open
paragraph ends with the next block. Repeated rows and extra columns do no harm.
Every page is a row of its own; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
FORMS = frozenset("form button select textarea input fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
SAME_KIND_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
LIST_BOUND = frozenset("ul ol menu dl table select body html".split())
#: In place of the tag of an anonymous block; no element can have it.
RUN = "#run"
# Elements that hold no article text.
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select textarea input label fieldset iframe "
    "object embed canvas svg math audio video dialog menu title xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
NOISE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus dropdown footer gdpr legal login masthead menu "
    "modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets".split()
)

#: Words of a class or id that say nothing about its kind.
GENERAL = frozenset(
    "area bar block body bottom box btn button buttons col column container content footer header holder inner item items "
    "label left link links list main module outer panel right row section slot text title top unit wrap wrapper".split()
) - NOISE
NO, DOUBTFUL, NOISY = range(3)
#: Characters a tag below which an element of a doubtful name is no running text.
SHORT = 20
#: Elements nested deeper belong to the one at this depth, as in browsers.
MAX_DEPTH = 256

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = (
        *("children", "density", "density_sum", "noise", "parent", "tag", "chars", "tags", "link_chars", "link_tags", "text"),
        *("breaks", "flow", "depth", "doubtful", "list_chars", "forms", "best"),
    )

    def __init__(self, tag: str, parent: Node | None, noise: int):
        self.tag, self.parent, self.noise, self.doubtful = tag, parent, noise == NOISY, noise == DOUBTFUL
        self.children: list[Node] = []
        self.text = ""  # of text nodes, whose tag is empty
        self.chars = self.tags = self.link_chars = self.link_tags = self.breaks = self.list_chars = self.forms = 0
        self.flow = tag in BLOCK or tag == RUN  # a block, or an element around blocks
        self.density = self.density_sum = 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.best = self  # the node of greatest density sum in this subtree


def named_noise(value: str) -> int:
    """Whether a class or id names something that is never content, by its last telling word."""
    out = NO
    for name in value.split():
        words = [w for w in (p.lower() for p in _PARTS.findall(name)) if len(w) > 1 and not w.isdigit()]
        if NOISE.isdisjoint(words):
            continue
        telling = [w for w in words if w not in GENERAL]
        out = max(out, NOISY if telling[-1] in NOISE else DOUBTFUL)
    return out


def is_noise(tag: str, attributes: str) -> int:
    if tag in NEVER:
        return NOISY
    if not attributes or tag in ("body", "html", "article", "main") and "comment" not in attributes:
        return NO
    out = NO
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return NOISY
        if name in ("class", "id"):
            out = max(out, named_noise(value))
    return NOISY if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) else out


class Parser:
    """One pass over the page; every step moves forward or up the open elements."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.root = self.here = Node("body", None, NO)
        self.opened: dict[str, int] = {}  # open elements by tag
        self.beyond: list[str] = []  # open elements nested too deeply
        self.beyond_open: dict[str, int] = {}
        self.unmatched: set[str] = set()  # quotes that do not occur again
        self.lacking: set[str] = set()  # raw elements whose end does not occur again

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends here; quoted values may hold the sign."""
        while True:
            stop = _STOP.search(self.page, at)
            if stop is None:
                return self.size
            at, sign = stop.end(), stop.group()
            if sign == ">":
                return at
            if sign in self.unmatched or not self.page[max(0, stop.start() - 8) : stop.start()].rstrip().endswith("="):
                continue
            close = self.page.find(sign, at)
            if close < 0:
                self.unmatched.add(sign)
            else:
                at = close + 1

    def parse(self) -> Node:
        page, position, text = self.page, 0, 0
        while True:
            less = page.find("<", position)
            if less < 0:
                break
            end = self.markup(less)
            if end is None:
                position = less + 1  # a sign, no markup
                continue
            if less > text:
                self.add_text(page[text:less])
            position = text = self.element(less, end)
        if text < self.size:
            self.add_text(page[text:])
        return self.root

    def markup(self, at: int) -> int | None:
        """Where the markup ends that begins here; None if it is none."""
        follows = self.page[at + 1 : at + 3]
        if self.page.startswith("<!--", at):
            end = self.page.find("-->", at + 4)
            return self.size if end < 0 else end + 3
        if follows[:1] in ("!", "?"):
            end = self.page.find(">", at + 2)
            return self.size if end < 0 else end + 1
        name = _NAME.match(self.page, at + 2 if follows[:1] == "/" else at + 1)
        return self.tag_end(name.end()) if name else None

    def element(self, at: int, end: int) -> int:
        """Take in a tag; returns where the page goes on."""
        page = self.page
        closing = page[at + 1] == "/"
        if page[at + 1] in "!?":
            return end
        name = _NAME.match(page, at + 1 + closing)
        tag = name.group().lower()
        if closing:
            self.close(tag)
            return end
        if tag in ("html", "body"):
            return end
        attributes = page[name.end() : end].removesuffix(">")
        self.make_room(tag)
        node = Node(tag, self.here, is_noise(tag, attributes))
        self.here.children.append(node)
        if tag in RAW:
            return self.raw_end(tag, end)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("path", "use", "circle", "rect")):
            if node.depth > MAX_DEPTH:
                self.beyond.append(tag)
                self.beyond_open[tag] = self.beyond_open.get(tag, 0) + 1
            else:
                self.here = node
                self.opened[tag] = self.opened.get(tag, 0) + 1
        return end

    def raw_end(self, tag: str, position: int) -> int:
        if tag not in self.lacking:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(self.page, position)
            if end:
                return end.end()
            self.lacking.add(tag)
        return self.size

    def add_text(self, raw: str) -> None:
        node = Node("", self.here, NO)
        node.text = html.unescape(raw) if "&" in raw else raw
        self.here.children.append(node)

    def go_up(self, to: Node) -> None:
        node = self.here
        while node is not to:
            self.opened[node.tag] -= 1
            node = node.parent
        self.here = to
        self.beyond.clear()
        self.beyond_open.clear()

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            self.go_up(self.root)
            return
        if self.beyond_open.get(tag):
            last = None
            while last != tag:
                last = self.beyond.pop()
                self.beyond_open[last] -= 1
            return
        if not self.opened.get(tag):
            return
        node = self.here
        while node is not self.root and node.tag != tag:
            if node.tag in BLOCK and tag not in BLOCK:
                return  # an inline end does not close blocks
            node = node.parent
        if node is not self.root:
            self.go_up(node.parent)

    def make_room(self, tag: str) -> None:
        """Close what cannot stay open when this element begins."""
        if tag in ENDS_PARAGRAPH and self.opened.get("p"):
            node = self.here
            while node.parent is not None and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p":
                self.go_up(node.parent)
                return
        ends = SAME_KIND_ENDS.get(tag)
        if ends and any(self.opened.get(e) for e in ends):
            node, last = self.here, None
            while node.parent is not None and node.tag not in LIST_BOUND:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                self.go_up(last.parent)


def parse(page: str) -> Node:
    """The tree below the body; text nodes have an empty tag and decoded text."""
    return Parser(page).parse()


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def gather_runs(root: Node) -> None:
    """Put runs of text and inline elements that stand beside blocks into anonymous blocks."""
    nodes = in_order(root)
    said: set[int] = set()  # nodes with text to be read
    for node in reversed(nodes):
        up = node.parent
        if node.text.strip():
            said.add(id(node))
        if up is not None and not node.noise:
            up.flow |= node.flow and not up.noise
            if id(node) in said:
                said.add(id(up))
    for node in nodes:
        if node.noise or not any(c.flow for c in node.children):
            continue
        children: list[Node] = []
        run: list[Node] = []
        for child in [*node.children, None]:
            if child is not None and not child.flow:
                run.append(child)
                continue
            if any(id(c) in said and not c.noise for c in run):
                block = Node(RUN, node, NO)
                block.children = run
                for c in run:
                    c.parent = block
                run = [block]
            children += run
            run = []
            if child is not None:
                children.append(child)
        node.children = children


def weigh(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes; returns them in page order.

    Doubtful nodes made up of links, list items or forms turn out to be noise.
    """
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        nodes.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(nodes):
        if not node.tag:
            node.chars = len(" ".join(node.text.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        elif node.tag in ("li", "dt", "dd"):
            node.list_chars = node.chars
        node.forms += sum(c.noise and c.tag in FORMS for c in node.children)
        if node.doubtful and (node.forms or node.link_chars * 3 > node.chars or node.list_chars * 2 > node.chars):
            node.noise = True
            continue
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + (node.tag not in ("", RUN))
            up.breaks += node.breaks + (node.tag == "br")
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.list_chars += node.list_chars
            up.forms += node.forms
    share = root.link_chars / root.chars if root.chars else 0.0
    nodes = [n for n in nodes if not n.noise]
    for node in nodes:
        if node.tag:
            node.density = composite(node, share)
    for node in nodes:
        if node.flow and node.parent is not None:
            node.parent.density_sum += node.density
    for node in reversed(nodes):
        for child in node.children:
            if child.flow and not child.noise and child.best.density_sum > node.best.density_sum:
                node.best = child.best
    return nodes


def composite(node: Node, page_link_share: float) -> float:
    """Characters per tag, times a logarithm that falls with the share of link text and link tags."""
    if not node.chars:
        return 0.0
    tags = (node.tags - node.breaks if node.tag == RUN else node.tags) or 1
    plain = max(1, node.chars - node.link_chars)
    ratio = (node.chars / (node.link_chars or 1)) * (tags / (node.link_tags or 1))
    base = math.log(node.chars * node.link_chars / plain + page_link_share * node.chars + math.e)
    return node.chars / tags * (math.log(max(ratio, 1.0)) / math.log(max(base, math.e / 2)) if base > 0 else 0.0)


def content(root: Node) -> tuple[set[int], float]:
    """Ids of the nodes whose whole subtree is content, and the threshold."""
    gather_runs(root)
    weigh(root)
    if not root.chars:
        return set(), 0.0
    best = root.best  # the first, hence outermost, of equals
    threshold, up = math.inf, best
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    chosen: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        if node.density < threshold or node.noise:
            continue
        chosen.add(id(node.best))
        # Search the rest of this subtree beside the path to what was chosen.
        step = node.best
        while step is not node and step.parent is not None:
            stack.extend(c for c in step.parent.children if c is not step and c.flow and not c.noise)
            step = step.parent
    return chosen, threshold


def blocks(root: Node, chosen: set[int], threshold: float) -> list[str]:
    """The text of the chosen subtrees, block by block."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | None, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            end()
            continue
        if node.noise or node.doubtful and node.density < threshold and node.chars < SHORT * max(1, node.tags):
            if node.tag in BLOCK:
                end()
            continue
        if not node.tag:
            if inside:
                line.append(node.text)
            continue
        inside = inside or id(node) in chosen
        if node.tag == "br":
            line.append(" ")
        if node.tag in BLOCK:
            end()
            stack.append((None, inside))
        stack.extend((c, inside) for c in reversed(node.children))
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    drop_page_headers(root)
    return "\n\n".join(blocks(root, *content(root)))


def drop_page_headers(root: Node) -> None:
    """A header is the page's unless it stands in the article, where it holds the title."""
    nodes = in_order(root)
    headed: set[int] = set()
    for node in reversed(nodes):
        if node.tag in HEADINGS or id(node) in headed:
            headed.add(id(node))
            headed.add(id(node.parent))
    within: set[int] = set()
    for node in nodes:
        if node.tag in ("article", "main") or id(node.parent) in within:
            within.add(id(node))
        elif node.tag == "header":
            node.noise = True
        if node.tag == "header" and id(node) not in headed:
            node.noise = True


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            lengths = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array(lengths, type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
