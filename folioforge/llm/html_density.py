"""Main text of web pages by composite text density.

A page becomes a tree of all its elements, with the end tags that HTML lets authors omit. First goes what is never the
article: scripts, styles and the like; and suspects, which are navigation, page headers and footers, asides and forms by
their tags, and adverts, notices, sidebars and comments by words of class, id and role. A suspect that holds the article
is spared: an article or main element while there is none outside of suspects, or, for forms and for marks other than
comments, a top heading or two blocks with more text than all that lies outside of suspects.

Every node left has a density: its characters per tag, adjusted by the logarithm of its links' share (both shares of
links have a least value, so that a text's size alone changes nothing). A node's sum is that of its children's
densities. The node with the largest sum is the core; the least density on the path from the body to it is the
threshold. In every node that reaches the threshold the subtree of the largest sum stays. Article elements stay
whole, as does a main element if any of it stays. So do the headings above what stays, what lies between two parts that
stay in one parent, and paragraphs next to them. Of these, blocks below the threshold that are mostly links go; inside
of article elements only those that are links and nothing else.

The blocks of what stays, in page order, character references decoded and white space joined, are put together by
blank lines. Null or empty pages, and pages without text, give an empty string. Pages are read in linear time. Other
columns are ignored, rows may repeat.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import bounded_batches

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("head noscript template object svg canvas audio video select button datalist option optgroup".split())
SUSPECT = frozenset("nav footer aside form menu dialog fieldset label legend".split())
HEAD_PARTS = frozenset("title meta link script style base noscript template".split())
INLINE = frozenset("a abbr acronym area b bdi bdo big button cite code data del dfn em embed font i img input ins kbd label link map mark math meter output picture progress q rp rt ruby s samp select small source span strike strong sub sup svg time track tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside of which list items, cells and paragraphs have their own scope.
SCOPES = frozenset("ul ol dl table td th caption article section main aside nav header footer form blockquote button object template select fieldset dialog details figure".split())
CELLS = frozenset("td th caption".split())
#: An open element of the second kind, in the same scope, ends where one of the first begins.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "p": ("p",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

# Words of class and id. One token of strong words marks an element, weak ones do if all its tokens are
# marks or neutral; a token counts if all its words do.
STRONG = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion sidebar sidebars menu menus navbar nav navigation breadcrumb breadcrumbs cookie cookies gdpr consent notice notices notification notifications popup modal newsletter subscribe subscription comment comments disqus replies masthead footer pagination pager toolbar".split())
WEAK = frozenset("alert social share sharing shares related recommended recommendations widget widgets tags toplinks skip login signup header".split())
COMMENTS = frozenset("comment comments disqus replies".split())
# Beside such tokens, any word that is strong or begins like this marks an element that holds neither an article nor an h1 of its own.
STEMS = ("comment", "advert", "sponsor", "promo")
LOOSE = frozenset("respond related".split())
NEUTRAL = frozenset("box block section sections area wrapper wrap container list lists item items bar inner outer top bottom left right main site page global links link buttons button panel group text body col column row primary secondary header side small large fixed sticky js the".split())
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: The least shares that links can have: of characters, and of tags.
LINK_CHARS, LINK_TAGS = 1 / 1000, 1 / 50
LEAST_BLOCKS = 2


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "links", "first", "end", "density", "total", "suspect", "closed", "depth", "own", "clear", "blocks", "top", "unit", "best", "article", "block")

    def __init__(self, tag: str, parent: Node | None, first: int, suspect: str = "") -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.first, self.end, self.density, self.total = first, 0, 0.0, 0.0
        self.suspect = suspect  # "", "gone", "tag", "form", "mark", "loose" or "comments"
        self.closed, self.depth = False, 0
        self.own = self.clear = self.blocks = 0
        self.top = self.unit = False
        self.best = self.block = self
        self.article: Node | None = None


def _mark(attributes: str) -> str:
    """ "mark" or "comments" by the words of class, id and role, "loose" by any of their words, else ""."""
    strong = weak = comments = loose = False
    every = True
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            strong |= value.strip().lower() in ROLES
            continue
        for token in value.split():
            words = [w.lower() for w in WORDS.findall(token)]
            known = [w for w in words if w in STRONG or w in WEAK]
            loose |= any(w in STRONG or w in LOOSE or w.startswith(STEMS) for w in words)
            if not words or not all(w in STRONG or w in WEAK or w in NEUTRAL or w.isdigit() for w in words):
                every = False
            elif known:
                strong |= any(w in STRONG for w in known)
                comments |= any(w in COMMENTS for w in known)
                weak = True
    return "comments" if comments else "mark" if strong or (weak and every) else "loose" if loose else ""


def _suspect(tag: str, attributes: str, in_article: bool) -> str:
    if tag in DROPPED:
        return "gone"
    if tag in SUSPECT or (tag == "header" and not in_article):
        return "form" if tag in ("form", "fieldset", "dialog") else "tag"
    return _mark(attributes) if attributes and tag not in ("html", "body", "main") else ""


def parse(page: str) -> tuple[list[Node], list[str | None]]:
    """The nodes of the tree in page order and its stream: texts, and None where a block begins or ends. Nodes know
    their part of the stream."""
    stream: list[str | None] = []
    root = Node("body", None, 0)
    order = [root]
    stack, opened = [root], defaultdict(list)
    scopes: list[tuple[int, defaultdict[str, int]]] = [(0, defaultdict(int))]
    cells = [0]  # depths of the open cells
    at, size, last_tag_end, quotes = 0, len(page), page.rfind(">"), True
    endless: set[str] = set()  # raw elements that no end tag follows any more

    def close_top() -> None:
        node = stack.pop()
        if node is not root:
            if not node.closed:
                opened[node.tag].pop()
                node.closed = True
            scopes[-1][1][node.tag] -= 1
            if node.tag in SCOPES:
                scopes.pop()
                scopes[-1][1][node.tag] -= 1
            if node.tag in CELLS:
                cells.pop()
        node.end = len(stream)
        if node.tag not in INLINE:
            stream.append(None)

    def close(node: Node) -> None:
        while stack[-1] is not node:
            close_top()
        close_top()

    def text(value: str) -> None:
        if opened["head"] and value.strip():
            close(opened["head"][-1])
        while stack[-1].closed:
            close_closed()
        value = html.unescape(value) if "&" in value else value
        stream.append(value)
        stack[-1].chars += len("".join(value.split()))

    def close_closed() -> None:
        node = stack.pop()
        scopes[-1][1][node.tag] -= 1
        node.end = len(stream)

    while at < size:
        if page[at] != "<":
            upto = page.find("<", at)
            upto = size if upto < 0 else upto
            text(page[at:upto])
            at = upto
            continue
        m = OPEN.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                text("<")
                at += 1
            continue
        tag, start = m[2].lower(), m.end()
        if at > last_tag_end:  # a tag that is cut off
            upto = page.find("<", start)
            at = size if upto < 0 else upto
            continue
        rest = REST.match(page, start) if quotes else None
        if rest is None:
            # A quote that nothing closes: from here on quotes mean nothing, or every tag would look for its end.
            quotes = False
            at = page.find(">", start) + 1
        else:
            at = rest.end()
        if m[1]:
            if tag in VOID or tag in ("html", "body") or not opened[tag]:
                continue
            node = opened[tag][-1]
            if node.depth < cells[-1] and tag != "table":
                continue
            if tag in INLINE and stack[-1] is not node and tag not in SCOPES:
                # Blocks that begin inside of it go on: it is only left when they end.
                opened[tag].pop()
                node.closed = True
            else:
                close(node)
            while stack[-1].closed:
                close_closed()
            continue
        if opened["head"] and tag not in HEAD_PARTS and tag != "head":
            close(opened["head"][-1])
        if tag in ("html", "body") or (tag == "head" and (opened["head"] or stream)):
            continue
        while stack[-1].closed:
            close_closed()
        if tag in VOID:
            if tag in ("br", "hr"):
                stream.append(" " if tag == "br" else None)
            if tag == "hr" and scopes[-1][1]["p"]:
                close(opened["p"][-1])
            stack[-1].tags += tag not in ("link", "meta", "base")
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or size
            elif tag in ("script", "style"):
                at = size
            else:
                endless.add(tag)
            continue
        scope = scopes[-1][1]
        if tag not in INLINE and scope["p"]:
            close(opened["p"][-1])
        for name in IMPLIED.get(tag, ()):
            if scope[name]:
                close(opened[name][-1])
        if tag in ("tr", "td", "th", "tbody", "thead", "tfoot") and opened["table"]:
            for name in ("td", "th") if tag in ("td", "th") else ("td", "th", "tr") if tag == "tr" else ("td", "th", "tr", "tbody", "thead", "tfoot"):
                if opened[name] and opened[name][-1].depth > opened["table"][-1].depth:
                    close(opened[name][-1])
        if tag == "button" and opened["button"]:
            close(opened["button"][-1])
        rest_text = page[start : at - 1]
        in_article = bool(opened["article"] or opened["main"])
        parent = stack[-1]
        if tag not in INLINE:
            stream.append(None)
        node = Node(tag, parent, len(stream), _suspect(tag, rest_text, in_article))
        node.depth = parent.depth + 1
        parent.children.append(node)
        order.append(node)
        stack.append(node)
        opened[tag].append(node)
        scopes[-1][1][tag] += 1
        if tag in SCOPES:
            scopes.append((node.depth, defaultdict(int)))
            scopes[-1][1][tag] += 1
        if tag in CELLS:
            cells.append(node.depth)
    while stack:
        close_top()
    return order, stream


def leave_out(order: list[Node], stream: list[str | None]) -> list[Node]:
    """Takes what isn't the article by its tags and marks from the tree and the stream; the nodes that stay, in page order."""
    root = order[0]
    for node in reversed(order):
        # own: text in no link and in nothing that goes in any case; clear: that outside of suspects further in.
        node.own += node.chars
        node.clear += node.chars
        if node.tag == "a":
            node.own = node.clear = 0
        node.blocks = node.blocks or int(node.tag not in INLINE and node.clear > 0)
        node.top |= node.tag == "h1"
        node.unit |= node.tag in ("article", "main") and node.suspect in ("", "mark", "loose")
        if node.suspect == "loose" and (node.unit or node.top):
            node.suspect = ""
        parent = node.parent
        if parent is not None and node.suspect != "gone":
            parent.own += node.own
            parent.unit |= node.unit
            if not node.suspect:
                parent.clear += node.clear
                parent.blocks += node.blocks
                parent.top |= node.top
    outside_unit = False  # an article or main element outside of suspects
    todo = [root]
    while todo and not outside_unit:
        node = todo.pop()
        outside_unit = node.tag in ("article", "main") and node.own > 0
        todo.extend(c for c in node.children if not c.suspect)
    kept, gone, shorter = [root], set(), set()
    for node in order[1:]:
        if node.parent in gone:
            gone.add(node)
            continue
        if node.suspect:
            spared = False
            if not outside_unit and node.suspect != "comments":
                spared = node.unit and node.suspect != "gone"
                if node.suspect in ("form", "mark", "loose"):
                    spared |= node.clear > root.clear and (node.top or node.blocks >= LEAST_BLOCKS)
                if node.tag == "button":
                    spared |= node.unit or (node.own > root.clear and node.top)
            if not spared:
                gone.add(node)
                shorter.add(node.parent)
                stream[node.first : node.end] = [None if node.tag not in INLINE else ""] * (node.end - node.first)
                continue
        kept.append(node)
    for node in shorter:
        node.children = [c for c in node.children if c not in gone]
    return kept


def measure(order: list[Node]) -> None:
    """Counts, densities and sums of all nodes."""
    root = order[0]
    for node in reversed(order):
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
        parent = node.parent
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.links += node.links
    share = root.link_chars / max(1, root.chars)
    for node in order:
        c, t, plain = node.chars, max(1, node.tags), max(1, node.chars - node.link_chars)
        if c:
            linked = max(node.link_chars / c, LINK_CHARS) * max(min(1.0, node.links / t), LINK_TAGS)
            base = math.log(c / plain * node.link_chars + share * c + math.e)
            node.density = c / t * max(0.0, -math.log(linked)) / (1.0 + math.log(base))
            if node.parent is not None:
                node.parent.total += node.density


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def content(order: list[Node]) -> tuple[list[Node], float]:
    """The subtrees that stay, in page order and none within another, and the threshold."""
    root = order[0]
    for node in reversed(order):  # best: in each subtree the node of the largest sum, the first of equals
        parent = node.parent
        if parent is not None and (parent.best is parent or node.best.total >= parent.best.total):
            if node.best.total > parent.total:
                parent.best = node.best
    core = root.best
    threshold = min(n.density for n in _path(core))
    chosen = {n.best for n in order[1:] if n.chars and n.density >= threshold} | {core}
    # Inline parts stand for their blocks, parts of an article for the whole of it.
    for node in order:
        node.article = node if node.tag in ("article", "main") else node.parent and node.parent.article
        node.block = node.parent.block if node.tag in INLINE else node
    whole = {n.article or n.block for n in chosen if 2 * n.link_chars <= n.chars}
    whole |= {n for n in order if n.tag == "article" and n.chars and 2 * n.link_chars <= n.chars}
    # Above the parts: the headings that no heading of their rank or a higher one follows before the part; what lies
    # between two parts of one parent; paragraphs next to a part.
    above: set[Node] = set()
    for node in whole:
        if node.tag not in ("article", "main"):
            for parent in _path(node.parent):
                if parent in above or parent.tag in ("article", "main"):
                    break
                above.add(parent)
    more: set[Node] = set()
    for parent in above:
        plain = lambda n: n.chars and 2 * n.link_chars <= n.chars
        leads = [c in above or c in whole for c in parent.children]
        parts = [i for i, c in enumerate(parent.children) if c in whole]
        open_headings: list[Node] = []
        for i, child in enumerate(parent.children):
            if leads[i]:
                more.update(open_headings)
            elif child.tag in HEADINGS and plain(child):
                while open_headings and open_headings[-1].tag >= child.tag:
                    open_headings.pop()
                open_headings.append(child)
        if parts:
            more.update(c for c in parent.children[parts[0] : parts[-1]] if plain(c) and c not in above)
            for step, at in ((-1, parts[0] - 1), (1, parts[-1] + 1)):
                while 0 <= at < len(parent.children) and (parent.children[at].tag == "p" or not parent.children[at].chars) and not leads[at]:
                    if plain(parent.children[at]):
                        more.add(parent.children[at])
                    at += step
    stays, inside = whole | more, set()
    out = []
    for node in order:
        if node.parent in inside:
            inside.add(node)
        elif node in stays:
            inside.add(node)
            out.append(node)
    return out, threshold


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order, stream = parse(page)
    order = leave_out(order, stream)
    measure(order)
    whole, threshold = content(order)
    kept = set(whole)
    in_article: set[Node] = set()
    menus: list[Node] = []
    for node in order:
        if node.tag == "article" or node.parent in in_article:
            in_article.add(node)
        if node.tag not in INLINE and node not in kept and node.chars and node.density < threshold and node.links > 1:
            if (node.links > 2 and 20 * node.link_chars >= 19 * node.chars) if node in in_article else 2 * node.link_chars > node.chars:
                menus.append(node)
    upto = 0
    for node in menus:
        if node.first >= upto:
            upto = node.end
            stream[node.first : node.end] = [None] * (node.end - node.first)
    blocks, parts = [], []
    for node in whole:
        for i in range(node.first, node.end + 1):
            piece = stream[i] if i < node.end else None
            if piece is not None:
                parts.append(piece)
            elif parts:
                if block := " ".join("".join(parts).split()):
                    blocks.append(block)
                parts = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
