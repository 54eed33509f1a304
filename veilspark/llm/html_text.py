"""HTML extraction by composite text density.

Each page becomes a tree; every node gets its composite
density, characters per tag adjusted by the characters and tags of links; densities of children are summed, and the
subtree with the largest sum is the main text, together with the outermost nodes, and runs of loose text, whose density
reaches the least density on the path from the body to it. A text in several paragraphs that stands before that subtree, with a sum of at least
RIVAL of its, belongs to it too, so one long comment never takes the place of an article. Articles and main regions have a weight in that search, and nodes that are named or tagged as boilerplate a
penalty, unless they hold a main region or most of the page's unlinked text; in the main text such nodes stay if their
density still reaches that threshold. Pages are independent, so one pass over the rows does it all.

Behaviour: null, empty and markup-free pages work (text without any tag is one block); unclosed and stray tags
are repaired as browsers do for paragraphs, list items and table parts; repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes xmp svg audio video canvas".split())
TAGGED = frozenset("nav footer aside form button select dialog menu datalist fieldset label noscript".split())
#: Those of them that stand inside paragraphs.
PHRASING = frozenset("button select datalist label noscript".split())
BLOCK = frozenset(
    "address article blockquote body center dd details dialog dir div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Words of class and id names that mark boilerplate.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alerts?|popup|modal|overlay|newsletter|subscri\w+|sidebar|side|aside|menu|nav|navbar|navigation|navi|breadcrumbs?|footer|foot|masthead|topbar|site-?header|page-?header|comments?|commentlist|comment-\w+|disqus|replies|respond|social|share|sharing|related|recommend\w*|pagination|pager|login|signin|signup|register|search|toolbar|widget|copyright|legal|disclaimer|skip\w*|paywall|tags?|taglist)(?:$|[\s_-]|\d)",
    re.I,
)
#: Those of them that sections of an article's own text have too.
DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:banner|notices?|notification|alerts?|overlay|side|menu|nav|navigation|navi|foot|respond|social|share|sharing|related|recommend\w*|login|signin|signup|register|search|toolbar|widget|copyright|legal|disclaimer|skip\w*|tags?|taglist)(?=$|[\s_-]|\d)",
    re.I,
)
#: A name of its own that marks a page's header, outside of articles.
HEADER = re.compile(r"(?:^|\s)(?:header|top|banner-top)(?:\s|$)", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Which open elements a start tag ends, and where that search stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Weight of the density of nodes named or tagged as boilerplate.
PENALTY = 0.01
#: Share of the threshold that decides on nodes of doubtful names in articles, and on forms around blocks.
DOUBT = 0.5
#: Share of the largest density sum from which an earlier subtree of more paragraphs is main text as well.
RIVAL = 0.5
#: Unlinked characters from which a named node may hold the text although the page has articles.
MUCH = 200
#: Weight of the density sum of articles and main regions: all that such a tag, role or itemprop counts for.
SEMANTIC = 4.0
OWN_SCOPE = frozenset("table td th caption button object html body article section main div blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "items", "names", "tagged", "main", "chars", "tags", "link_chars", "link_tags", "density", "total", "weight", "sign", "paragraphs", "inner", "filled", "headed")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.items, self.names = tag, parent, [], []
        self.tagged = tag in TAGGED
        self.main = tag in ("article", "main")
        self.weight, self.sign = 1.0, None
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    if tag not in ("body", "html"):
                        self.names.append(value)
                elif name == "role":
                    self.tagged, self.main = self.tagged or value in NOISE_ROLES, self.main or value in ("main", "article")
                elif name == "itemprop":
                    self.main = self.main or value == "articlebody"
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    self.tagged = True

    @property
    def plain(self) -> int:
        return self.chars - self.link_chars


def tree(page: str) -> Node:
    """The element tree; `items` of a node holds its text pieces and its child nodes in page order."""
    root = Node("#root", None)
    here, at, end = root, 0, len(page)
    # How many elements of each tag are open, so that none is looked for in vain.
    open_tags: Counter[str] = Counter()

    def close(to: Node) -> Node:
        up = here
        while up is not to:
            open_tags[up.tag] -= 1
            up = up.parent
        return to

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            here.items.append(page[at:stop])
        if not m:
            break
        at = m.end()
        # Where a quote is never closed, the tag ends at the next >, and its attributes do not count.
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or ""
        if not tag:
            continue
        if closing:
            up = here if open_tags[tag] > 0 else None
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = close(up.parent)
            elif tag == "p":
                here.items.append(Node("p", here))
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                done = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = done.end() if done else end if tag in ("script", "style") else at
            continue
        if open_tags["p"] > 0 and (tag in BLOCK or (tag in TAGGED and tag not in PHRASING) or tag == "body"):
            up = here
            while up is not None and up.tag != "p" and up.tag not in OWN_SCOPE:
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                here = close(up.parent)
        if tag in ENDS:
            ended, limit = ENDS[tag]
            up, last = here if any(open_tags[x] > 0 for x in ended) else None, None
            while up is not None and up.tag not in limit:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None and last.parent is not None:
                here = close(last.parent)
        if here.tag == "head" and tag not in VOID:
            here = close(here.parent)  # as browsers do when the end tag is left out
        node = Node(tag, here, attributes)
        here.items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            here = node
            open_tags[tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(x for x in reversed(n.items) if isinstance(x, Node))
    return out


def sign(node: Node, inside: bool) -> str | None:
    """What marks a node as boilerplate: 'tag', 'name' or, with less certainty, 'doubt'; `inside` a main region or not."""
    if node.tag == "form" and node.filled:
        return "doubt"
    if node.tagged or (node.tag == "header" and not (inside and node.headed)):
        return "tag"
    for value in node.names:
        if NOISE.search(DOUBTFUL.sub(" ", value) if inside else value) or (HEADER.search(value) and not inside):
            return "name"
    return "doubt" if inside and any(NOISE.search(value) for value in node.names) else None


def weigh(root: Node, nodes: list[Node]) -> None:
    """Signs and weights of all nodes. A node that holds a main region, or most of the page's unlinked text, has no sign.

    Regions of under a third of the largest one's text, such as teasers, do not count.
    """
    largest = max((n.plain for n in nodes if n.main), default=0)
    regions = {id(n) for n in nodes if n.main and n.plain and n.plain * 3 >= largest}
    holds = set(regions)
    for n in reversed(nodes):
        if id(n) in holds and n.parent is not None:
            holds.add(id(n.parent))
    inside: set[int] = set()
    for n in nodes:
        up = n.parent
        if up is not None:
            n.weight = up.weight
            if id(up) in inside or id(up) in regions:
                inside.add(id(n))
        if id(n) in holds or n.tag in ("#root", "html", "body") or not n.chars:
            continue
        n.sign = sign(n, id(n) in inside)
        if n.sign and n.plain * 2 > root.plain and (not regions or (n.sign != "tag" and n.plain >= MUCH and n.plain > 4 * largest)):
            n.sign = None
        if n.sign in ("tag", "name"):
            n.weight *= PENALTY


def composite(c: int, t: int, lc: int, lt: int, linked: float) -> float:
    """Density of c characters in t tags, of which lc and lt are links', where `linked` is the page's share of link text."""
    if not c:
        return 0.0
    # The logarithm's base is above e, so it never divides by zero; a node of links only keeps a trace of its density.
    base = math.log(c / max(c - lc, 1) * lc + linked * c + math.e * math.e)
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    return c / t * max(math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.5)), 1e-3)


def densities(root: Node) -> tuple[list[Node], float]:
    """All nodes in page order, and the page's share of link text."""
    nodes = in_order(root)
    for n in nodes:
        n.chars = sum(len("".join(x.split())) for x in n.items if isinstance(x, str))
        n.tags, n.link_chars, n.link_tags = 0, 0, 0
        n.paragraphs = int(n.tag in BLOCK and n.chars > 0)
        # Whether it holds a block, one with unlinked text, a heading.
        n.inner, n.filled, n.headed = False, False, n.tag in ("h1", "h2")
    for n in reversed(nodes):
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
            p.paragraphs += n.paragraphs
            p.inner |= n.inner or n.tag in BLOCK
            p.filled |= n.filled or (n.tag in BLOCK and n.plain > 0)
            p.headed |= n.headed
    weigh(root, nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    linked = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        n.density = n.weight * composite(n.chars, n.tags, n.link_chars, n.link_tags, linked)
    for n in nodes:
        n.total = sum(x.density for x in n.items if isinstance(x, Node))
    return nodes, linked


def content(root: Node) -> list[Node]:
    """The outermost nodes of the main text, in page order."""
    nodes, linked = densities(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    top = body if body.chars == root.chars else root
    best = max((n for n in in_order(top) if n.weight == 1), key=lambda n: n.total * (SEMANTIC if n.main else 1.0))
    if best.total == 0:
        best = top
    above = _path(best)[: _path(best).index(top) + 1]
    threshold = min(n.density for n in above)
    path = {id(n) for n in above}
    rivals = {id(n) for n in _earlier(above) if n.weight == 1 and n.total >= RIVAL * best.total and n.paragraphs > best.paragraphs}
    out, stack = [], [top]
    while stack:
        n = stack.pop()
        if n is best or id(n) in rivals or (id(n) not in path and n.density >= threshold):
            out.append(n)
        else:
            stack.extend(reversed(_units(n, path, linked)))
    for o in out:
        for n in in_order(o):
            n.items = [x for x in n.items if isinstance(x, str) or not x.sign or x.density >= threshold * (DOUBT if x.sign == "doubt" else 1.0) or (o is best and best is not top and titled(x))]
    return out


def _earlier(path: list[Node]) -> Iterator[Node]:
    """Nodes that stand before the nodes of a path, from the lowest up, beside them."""
    for n in path[:-1]:
        for x in n.parent.items:
            if x is n:
                break
            if isinstance(x, Node):
                yield x


def titled(node: Node) -> bool:
    """A header with a heading; in the chosen subtree it is the text's own."""
    return node.tag == "header" and node.headed


def _units(node: Node, path: set[int], linked: float) -> list[Node]:
    """Blocks in a node, and its runs of text and inline elements, as nodes of their own."""
    out: list[Node] = []
    run: list[object] = []
    for x in [*node.items, None]:
        if x is not None and (isinstance(x, str) or (x.tag not in BLOCK and x.tag != "br" and id(x) not in path and not x.inner)):
            run.append(x)
            continue
        if any(not isinstance(y, str) or y.strip() for y in run):
            n = Node("#run", node)
            inside = [y for y in run if isinstance(y, Node)]
            n.items = list(run)
            n.chars = sum(len("".join(y.split())) for y in run if isinstance(y, str)) + sum(y.chars for y in inside)
            n.tags, n.link_chars, n.link_tags = sum(y.tags + 1 for y in inside), sum(y.link_chars for y in inside), sum(y.link_tags for y in inside)
            n.density = node.weight * composite(n.chars, n.tags, n.link_chars, n.link_tags, linked)
            out.append(n)
        run = []
        if x is not None:
            out.append(x)
    return [] if node.tag == "#run" else out


def _path(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def blocks(node: Node) -> list[str]:
    out, run = [], []

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if x is None or (isinstance(x, Node) and x.tag == "br"):
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            edge = x.tag in BLOCK or x is node
            if edge:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    for n in in_order(root):
        n.items = [x for x in n.items if isinstance(x, str) or x.tag != "head"]
    return "\n".join(b for n in content(root) for b in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
