"""Main text of web pages by composite text density.

A page becomes a tree of elements. Every element gets its density: characters per tag, adjusted by the share of them
that links hold and by the page's own share. An element's density sum is the sum of its children's densities; the
subtree with the largest one is the core of the main text. The least density on the path from there to the body is
the threshold for what hangs on that path beside the core: a subtree belongs to the main text if its density reaches
the threshold and its own largest density sum is at least SHARE of the core's. Inside an article element all of the
path's other subtrees belong to it, too, and so does a first heading if the core has none.

Elements that by name, role or attribute aren't main text (navigation, forms, hidden elements and the like) count for
nothing and give no text. Names in class and id are weak evidence: a class counts if all of its words do, and an
element that holds most of the page's text isn't dropped for it (see `doubted`).

Defined results: null or blank html and a page without main text give an empty string; unclosed and stray tags are
mended as browsers do; time grows linearly with the page, however deep it is; null page_id and url are carried;
repeated rows are each returned; other columns than page_id and url are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, ship, table

#: Element names as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template nav aside footer form button select option input dialog menu svg math object embed applet audio video canvas map search label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words in a class or id that say what an element is for.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification alert popup pop modal overlay newsletter subscribe subscription paywall sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar comment comments disqus reply replies respond discussion share sharing social related recommended recommendations widget widgets login signin signup register search pagination pager toolbar copyright legal disclaimer hidden skip".split()
)
#: Words that may stand beside them and say nothing else.
NEUTRAL = frozenset("site page global top bottom left right upper lower primary secondary user users reader readers box wrap wrapper container inner outer block area section zone slot list links bar row col unit item group panel text body js the our us up".split())
#: An open element of the first name ends when one of the others begins.
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
}
#: For a beginning element, the open ones that it ends.
ENDS = {tag: [x for x, names in CLOSES.items() if tag in names] for tag in BLOCK if any(tag in names for names in CLOSES.values())}
SCOPES = frozenset("table td th ul ol dl body html article section div".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
_markup = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
_attribute = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
_named = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


#: Of the core's density sum, what another subtree needs at least. Of the page's text, what an element holds that isn't
#: dropped for its class if it has a heading or an article, and what it holds if it has none.
SHARE, MOST, NEARLY_ALL = 0.15, 0.5, 0.8
_weighty = frozenset("article main h1 h2".split())


class Node:
    __slots__ = ("tag", "up", "items", "off", "named", "weighty", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, off: bool = False, named: bool = False):
        self.tag, self.up, self.items, self.off, self.named, self.weighty = tag, up, [], off, named, tag in _weighty
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def says(name: str) -> bool:
    """Whether a class or an id says by all of its words that an element isn't main text."""
    words = [w.lower() for w in _named.findall(name)]
    return any(w in NAMED for w in words) and all(w in NAMED or w in NEUTRAL for w in words)


def not_main(tag: str, attributes: str, within_article: bool) -> tuple[bool, bool]:
    """Whether an element isn't main text, by name, role or being hidden; whether its class or id says so."""
    if tag in DROPPED or tag == "header" and not within_article:
        return True, False
    named = False
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, a, b, c in _attribute.findall(attributes):
            value = (a or b or c).strip()
            name, low = name.lower(), value.lower()
            if name == "hidden" or name == "aria-hidden" and low == "true" or name == "role" and low in ROLES or name == "style" and "display:none" in low.replace(" ", ""):
                return True, False
            if name in ("class", "id") and not (within_article and "header" in low and tag in ("header", "div", "h1")):
                named = named or any(map(says, value.split()))
    return False, named


def parse(source: str) -> Node:
    """The tree of a page; a node's items are its children and pieces of text in order.

    `places` has the depths at which elements of a name are open, so that no tag needs a walk up the tree."""
    top = Node("html", None)
    path, places, blocks, scopes = [top], defaultdict(list), [0], [0]
    at, n = 0, len(source)

    def text(s: str) -> None:
        if s and not path[-1].off:
            path[-1].items.append(entities.unescape(s) if "&" in s else s)

    def enter(node: Node) -> None:
        depth = len(path)
        places[node.tag].append(depth)
        if node.tag in BLOCK:
            blocks.append(depth)
        if node.tag in SCOPES and node.tag not in INLINE:
            scopes.append(depth)
        path.append(node)

    def leave(depth: int) -> None:
        """Close all elements from this depth on."""
        while len(path) > depth:
            places[path.pop().tag].pop()
        while blocks[-1] >= depth:
            blocks.pop()
        while scopes[-1] >= depth:
            scopes.pop()

    while at < n:
        m = _markup.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group(0).startswith("<![CDATA["):
                text(m.group(0)[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            if places[tag]:
                if tag not in INLINE or places[tag][-1] > blocks[-1]:  # a stray end of an inline element ends no block
                    leave(places[tag][-1])
            elif tag == "p" and not path[-1].off:
                path[-1].items.append(Node("p", path[-1]))
            continue
        if tag == "html":
            continue
        if tag in ENDS:
            ends = max((places[x][-1] for x in ENDS[tag] if places[x]), default=0)
            if ends and ends >= scopes[-1]:
                leave(ends)
        attributes = m.group(3) or ""
        here = path[-1]
        off, named = not_main(tag, attributes, bool(places["article"] or places["main"]))
        new = Node(tag, here, here.off or off, named)
        here.items.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            enter(new)
    return top


def walk(top: Node) -> list[Node]:
    """All nodes that count, parents first."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        if not node.off:
            out.append(node)
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def own_chars(node: Node) -> int:
    return sum(len(w) for x in node.items if isinstance(x, str) for w in x.split())


def doubted(nodes: list[Node]) -> None:
    """Drop elements whose class says that they aren't main text, unless they hold most of the text."""
    top, held = nodes[0], {}
    for node in reversed(nodes):
        held[id(node)] = held.get(id(node), 0) + own_chars(node)
        if node.up is not None:
            held[id(node.up)] = held.get(id(node.up), 0) + held[id(node)]
            node.up.weighty |= node.weighty
    for node in nodes:
        if node.named and held[id(node)] <= (MOST if node.weighty else NEARLY_ALL) * held[id(top)]:
            node.off = True


def weigh(nodes: list[Node]) -> None:
    """Counts, densities and density sums of all nodes."""
    for node in reversed(nodes):
        node.chars += own_chars(node)
        if node.tag == "a":
            node.link_chars = node.chars
        if node.up is not None:
            up = node.up
            up.chars += node.chars
            up.tags += node.tags + (node.tag not in ("br", "wbr"))
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.up is not None:
            node.up.total += node.density


def composite(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Composite text density of an element; logarithms are shifted by one, so that they exist without links, too."""
    if not chars:
        return 0.0
    base = math.log(chars * link_chars / max(1, chars - link_chars) + page_share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(ratio, 1.0) + 1) / math.log(base + 1)


def core(nodes: list[Node]) -> Node:
    """The node with the largest density sum; the first one of equals."""
    best = max(nodes, key=lambda x: x.total)
    return best if best.total else max(nodes, key=lambda x: x.density)


def narrow(top: Node) -> bool:
    """Cut from the tree what isn't main text; whether anything is left."""
    nodes = walk(top)
    if any(x.named for x in nodes):
        doubted(nodes)
        nodes = walk(top)
    weigh(nodes)
    if not nodes[0].chars:
        return False
    best = core(nodes)
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold = min(x.density for x in path)
    if best.tag in ("body", "html"):  # all of the page but lists of links thinner than it
        best.items = [x for x in best.items if isinstance(x, str) or x.density >= threshold or 2 * x.link_chars <= x.chars]
        return True
    largest = {id(x): x.total for x in nodes}  # density sum of any node of the subtree
    headed = set()
    for node in reversed(nodes):
        if node.tag == "h1" and node.chars:
            headed.add(id(node))
        if node.up is not None:
            largest[id(node.up)] = max(largest[id(node.up)], largest[id(node)])
            if id(node) in headed:
                headed.add(id(node.up))
    articles = [k for k, x in enumerate(path) if x.tag == "article"]
    title = id(best) in headed
    for k, node in enumerate(path[1:], 1):
        if articles and k <= articles[-1]:
            title = title or id(node) in headed
            continue
        found = []
        for x in node.items:
            if isinstance(x, str) or x.off:
                continue
            if x is path[k - 1] or x.density >= threshold and largest[id(x)] >= SHARE * best.total:
                found.append(x)
            elif x.tag == "h1" and not title:
                found.append(x)
                title = True
        node.items = found
    return True


def extract(source: str | None) -> str:
    """Main text of a page: white space is one space, blocks are joined by one."""
    if not source or not source.strip():
        return ""
    top = parse(source)
    if not narrow(top):
        return ""
    out: list[str] = []
    todo: list = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.off:
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.items)
    return " ".join("".join(out).split())


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return by_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), make, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark, sf_dir):
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
