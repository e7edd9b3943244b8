"""Main text of web pages by composite text density.

Every DOM node gets its characters, tags, link characters and link tags. A node's
composite density is characters per tag, lowered for links; its density sum adds up its
children's densities. The subtree with the greatest sum is kept whole, and the least
density on the path from it up to the body is the threshold from which other parts of the
page, outside its frame, are kept too. An ``article`` or ``main`` mark around the subtree
tells where the text ends: only other marks are then added. Lists of links are dropped
outside the subtree, or where it is the whole body.

Tags and class words mark the page's frame before that, but words alone cannot erase a
page: a form, a header or a node marked by its words is opened again if it holds parts of an
article and over ``OPENED`` times the text of all that is unmarked. Class words count
as whole tokens; a compound one (``site-footer``) is a weaker mark and one that tells of a layout
(``has-sidebar``) is none. A header inside an article is part of it.

Pages are independent, so this is one map over them; a page's tree lives only while its
text is made.

Defined results: a null or empty page and a page without text give an empty text; broken
markup is read as browsers do (open paragraphs and list items end at the next one, unknown
ends are ignored); repeated rows give equal rows; an empty table gives none; other columns
are ignored. Pages of any size or depth are read whole, without recursion, in time that grows
with the page and not with its depth.
"""

from __future__ import annotations

import heapq
import html as entities
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.llm.common import column, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is raw text up to their end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Parts of a page that are never its article.
CHROME = frozenset(
    "nav footer aside script style noscript template iframe button select option textarea input head menu "
    "dialog svg canvas object".split()
)
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer gdpr header masthead menu menubar nav navbar navigation newsletter notice notices pagination pager popup promo "
    "related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
#: A class word that begins so tells of the layout, not of the node.
LAYOUT = frozenset("has no not with without is".split())
#: Marks of the frame, from none to those that are never opened again.
NONE, SOFT, WORD, HARD = range(4)
#: How many times the text outside the frame a marked node must hold to be opened.
OPENED = 4
#: An opening tag of the first kind ends an open one of the second kind.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody"),
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
SCOPES = frozenset("table td th ul ol dl div article section body html main blockquote aside nav header footer form".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "parts", "mark", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int = NONE):
        self.tag, self.parent, self.parts, self.mark = tag, parent, [], mark
        self.depth = parent.depth + 1 if parent is not None else 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    @property
    def chrome(self) -> bool:
        return self.mark != NONE


def frame_mark(tag: str, attributes: str, in_article: bool) -> int:
    """How strongly tag, class, id and role mark a part of the page's frame."""
    if tag in CHROME:
        return HARD
    mark = SOFT if tag == "form" or tag == "header" and not in_article else NONE
    if not attributes or attributes.isspace():
        return mark
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = "".join(values).lower()
        if name in ("class", "id"):
            for token in value.split():
                words = re.split(r"[_\-]+", token)
                if token in CHROME_WORDS:
                    mark = max(mark, WORD)
                elif words[0] not in LAYOUT and not CHROME_WORDS.isdisjoint(words):
                    mark = max(mark, SOFT)
        elif name == "role" and value.strip() in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD
    return mark


class Open:
    """The open nodes, by tag: the innermost of any tags is found without walking up."""

    def __init__(self, root: Node):
        self.node, self.by_tag = root, defaultdict(list)

    def enter(self, node: Node) -> None:
        self.by_tag[node.tag].append(node)
        self.node = node

    def innermost(self, tags) -> Node | None:
        found = [self.by_tag[t][-1] for t in tags if self.by_tag.get(t)]
        return max(found, key=lambda n: n.depth, default=None)

    def leave(self, last: Node) -> None:
        """Close everything down to ``last``; each node is closed once."""
        while True:
            node = self.node
            self.by_tag[node.tag].pop()
            self.node = node.parent
            if node is last:
                return


#: Ends of these do not reach beyond the innermost scope.
SCOPED = INLINE | {"p", "li"}
#: What an opening tag looks for: the tags that it closes, and the scopes that hide them.
REACH = {tag: (closed, SCOPES - set(closed)) for tag, closed in ({t: ("p",) for t in ENDS_P - set(CLOSES)} | CLOSES).items()}


def parse(page: str) -> Node:
    """The page's tree; ``parts`` of a node are its texts and children in order."""
    root = Node("html", None)
    tree, at = Open(root), 0

    def text(raw: str) -> None:
        if raw:
            tree.node.parts.append(entities.unescape(raw))

    while True:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            return root
        text(page[at : found.start()])
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            last = tree.innermost((tag,))
            hides = tree.innermost(SCOPES) if last is not None and tag in SCOPED else None
            if last is not None and (hides is None or hides.depth < last.depth):
                tree.leave(last)
            continue
        if not found[2]:
            continue  # a comment, a doctype or a processing instruction
        tag, attributes = found[2].lower(), found[3] or ""
        if tag in ("html", "body"):
            first = next((n for n in itertools.chain(*tree.by_tag.values()) if n.depth == 1), None) if tag == "body" else None
            if first is not None:
                tree.leave(first)
            continue
        if tag in REACH:
            closed, scopes = REACH[tag]
            last = tree.innermost(closed)
            hides = tree.innermost(scopes) if last is not None else None
            if last is not None and (hides is None or hides.depth < last.depth):
                tree.leave(last)
        node = tree.node
        if tag in VOID:
            if tag not in CHROME:
                node.parts.append(Node(tag, node))
            continue
        in_article = bool(tree.by_tag.get("article") or tree.by_tag.get("main"))
        child = Node(tag, node, HARD if tag in ("textarea", "title") else frame_mark(tag, attributes, in_article))
        node.parts.append(child)
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        tree.enter(child)


def settle(root: Node) -> None:
    """Open marked nodes that hold the page's text: the largest first, while they hold over
    ``OPENED`` times what is unmarked. A whole word's mark gives way to an article, main part or
    headline inside only, a weaker one also to three paragraphs. Every node is visited twice."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [c for c in node.parts if isinstance(c, Node) and c.mark != HARD]
    if all(n.mark == NONE for n in nodes):
        return
    held = {id(n): [sum(len(SPACE.sub("", x)) for x in n.parts if isinstance(x, str)), 0, 0] for n in nodes}
    own = {k: v[0] for k, v in held.items()}
    for node in reversed(nodes):
        chars, heads, paragraphs = held[id(node)]
        if node.parent is not None:
            up = held[id(node.parent)]
            up[0] += chars
            up[1] += heads + (node.tag in ("article", "main", "h1"))
            up[2] += paragraphs + (node.tag == "p")
    outside, marked, stack, order = 0, [], [root], itertools.count()
    while True:
        while stack:
            node = stack.pop()
            outside += own[id(node)]
            for child in node.parts:
                if isinstance(child, Node) and child.mark == NONE:
                    stack.append(child)
                elif isinstance(child, Node) and child.mark != HARD:
                    heapq.heappush(marked, (-held[id(child)][0], next(order), child))
        if not marked:
            return
        size, _, node = heapq.heappop(marked)
        if -size <= OPENED * outside:
            return
        _, heads, paragraphs = held[id(node)]
        if heads or node.tag in ("article", "main") or node.mark == SOFT and paragraphs >= 3:
            node.mark = NONE
            stack.append(node)


def preorder(root: Node) -> list[Node]:
    """Nodes outside the page's frame, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.parts) if isinstance(c, Node) and not c.chrome]
    return out


def link_share(body: Node) -> float:
    return body.link_chars / max(body.chars, 1)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, lowered for links."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    if c / lc * t / lt <= 1:
        return 0.0
    base = math.log(c / max(c - link_chars, 1) * link_chars + share * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9, max(base, 1.0 + 1e-9))


def measure(nodes: list[Node]) -> None:
    """Counts bottom-up, then composite densities and their sums."""
    for node in reversed(nodes):
        node.chars += sum(len(SPACE.sub("", p)) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = link_share(nodes[0])
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.total += node.density


#: How a part is read: looked through for parts above the threshold, kept without its lists of links, kept whole.
SEARCH, KEEP, WHOLE = range(3)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def flows(part: Node | str, path: set[Node]) -> bool:
    """Text or an inline tag without blocks in it."""
    if isinstance(part, str):
        return True
    return part.tag in INLINE | {"br"} and part not in path and not any(isinstance(c, Node) and c.tag not in INLINE | {"br"} for c in part.parts)


def admitted(node: Node, path: set[Node], threshold: float, share: float, marked: bool) -> list[Node | str]:
    """Parts of a looked-through node; its own text only from the threshold on."""
    out: list[Node | str] = []
    for flowing, run in itertools.groupby(node.parts, lambda part: flows(part, path)):
        parts = list(run)
        if flowing:
            tags = [x for x in parts if isinstance(x, Node)]
            chars = sum(len(SPACE.sub("", x)) if isinstance(x, str) else x.chars for x in parts)
            sums = [sum(getattr(x, name) for x in tags) for name in ("tags", "link_chars", "link_tags")]
            if marked or density(chars, sums[0] + len(tags), sums[1], sums[2], share) < threshold:
                continue
        out += parts
    return out


def blocks(root: Node, best: Node, threshold: float, marked: bool) -> list[str]:
    """Texts of the kept blocks in page order; parts of the frame left out."""
    out: list[str] = []
    held: list[str] = []
    share, path, up = link_share(root), set(), best
    while up is not None:
        path.add(up)
        up = up.parent

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    # Each entry is a node still to open, a text, or None for the end of a block.
    stack: list = [(root, SEARCH)]
    while stack:
        part, how = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif part.chrome:
            continue
        elif part.tag == "br":
            held.append(" ")
        elif how == SEARCH and part is not best and flows(part, path):
            stack += [(x, WHOLE) for x in reversed(part.parts)]
        elif how != SEARCH and part.tag in INLINE:
            stack += [(x, how) for x in reversed(part.parts)]
        else:
            flush()
            if part is best:
                how = KEEP if best is root else WHOLE
            elif how == SEARCH and part not in path and part.density >= threshold and (not marked or part.tag in ("article", "main")):
                how = KEEP
            elif how == KEEP and part.link_chars > 0.5 * part.chars and part.density < threshold and part.tag not in PARAGRAPHS:
                continue
            stack.append((None, how))
            parts = admitted(part, path, threshold, share, marked) if how == SEARCH else part.parts
            stack += [(x, how) for x in reversed(parts)]
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    settle(root)
    nodes = preorder(root)
    measure(nodes)
    best = max(nodes, key=lambda n: n.total if n.tag not in INLINE else -1.0)
    if not best.total:
        best = nodes[0]
    # What an open inline tag swallowed belongs to the block around it.
    while best.parent is not None and best.tag in INLINE | {"p", "h1", "h2", "h3", "li", "blockquote", "pre"}:
        best = best.parent
    # An article mark around the subtree tells where it ends.
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    threshold, up = best.density, best.parent
    while up is not None:
        if up.density:
            threshold = min(threshold, up.density)
        up = up.parent
    return "\n\n".join(blocks(nodes[0], best, threshold, best.tag in ("article", "main")))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            texts = [main_text(h) for h in column(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
