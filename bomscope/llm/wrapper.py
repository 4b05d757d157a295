"""HTML main text by wrapper induction.

All pages of a host are aligned with one of them by simple tree matching.  A text node of that page whose
text comes back at the same place in most of the others belongs to the host's template.  Every element of it is
weighed by the prose without links that differs from page to page below it, summed over the host's pages; the
content slot is found from the root by going on into the element that holds most of that prose, until an element
holds paragraphs or headings of its own.  A page's text is what stands in its counterpart of the slot, less
template nodes.  Element and class names decide little there: menus, forms, notices, adverts and comments inside
the slot go, and prose so named weighs less.  Where the slot of a page holds a marked article, that is the text.

Hosts with too few pages, or without prose that differs, have no slot.  Their text is what the marks (article, main)
hold, or all that no element, role or class name excludes.  A mark that holds template only says nothing if other
slots of the page vary; if none does, the page repeats the article of most others and keeps it.

One page per host travels to the host's other pages; of each page only counts per node come back.  Hosts of
any size are therefore dealt like any other rows.

Defined cases: a null html has an empty text.  A page without a host belongs to the host ''.  A host with
fewer than MIN_PAGES other pages has no template and no slot.  Elements nested deeper than MAX_DEPTH are read as
if they lay at that depth.  Rows that repeat a page are rows of the result.  Extra columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import staged

#: A node is template if at least SHARE of at least MIN_PAGES other pages have its text at its place.
SHARE, MIN_PAGES = 0.8, 4
MAX_DEPTH = 150
#: The slot goes on into an element that holds this share of the differing prose, unless the rest has paragraphs with OWN.
INTO, OWN = 0.5, 0.1
#: Prose in elements whose class or id excludes them weighs one part in so many.
NAMED = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav header footer aside form menu dialog button select option input svg canvas object audio video head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is not the article.
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices banner cookie cookies consent gdpr "
    "alert ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments commentlist disqus respond replies widget pagination pager "
    "toolbar copyright disclaimer form search".split()
)
CONTENT = frozenset(("article", "main"))
#: Why an element is left out: its tag, role or style; a word of its names; the word "header" alone.
BY_KIND, BY_NAME, BY_HEADER = 1, 2, 3
#: An open element that a new one closes: the new element, those it closes, where the search stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]++|[^\s=>/"'][^\s=>/]*+(?:\s*=\s*(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+))?+|["'=])*+)(?P<stop>>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""", re.S)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "children", "text", "drop", "number", "shape")

    def __init__(self, tag: str, text: str | None = None, drop: int = 0):
        self.tag, self.text, self.drop = tag, text, drop
        self.children: list[Node] = []
        self.number = -1
        self.shape = -1


def _dropped(tag: str, attrs: str) -> int:
    if tag in DROPPED or tag in RAW:
        return BY_HEADER if tag == "header" else BY_KIND
    if not attrs or tag in ("html", "body") or tag in CONTENT:
        return 0
    named: set[str] = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            named.update(w.lower() for w in NAME_WORD.findall(value))
        elif name == "role":
            if value.strip().lower() in DROPPED_ROLES:
                return BY_KIND
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return BY_KIND
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return BY_KIND
    named &= DROPPED_WORDS
    return 0 if not named else BY_HEADER if named == {"header"} else BY_NAME


def parse(source: str) -> Node:
    """A tree of elements and text leaves (tag '#'); raw elements keep no text."""
    top = Node("#root")
    stack = [top]
    at = 0
    end = len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            parent = stack[-1]
            if parent.children and parent.children[-1].tag == "#":
                parent.children[-1].text += text
            elif not text.isspace():
                parent.children.append(Node("#", text))
            elif parent.children and parent.children[-1].tag in INLINE:
                parent.children.append(Node("#space"))
            continue
        tag = m["tag"]
        if tag is None or m["stop"] == "" or m["stop"] is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "p" and all(n.tag != "p" for n in stack[-8:]):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in CLOSES:
            closed, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    if tag != "tr" or stack[-1].tag != "tr":
                        break
                elif stack[k].tag in stops:
                    break
        node = Node(tag, drop=_dropped(tag, m["attrs"]))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(source, at)
            at = close.end() if close else end
        elif tag not in VOID and not m["attrs"].endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return top


class Matcher:
    """Simple tree matching; scores of pairs of shapes are remembered, since a host's pages repeat them."""

    def __init__(self, bound: int = 200_000):
        self.shapes: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.parts: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.bound = bound

    def shape(self, node: Node) -> int:
        key = (node.tag, tuple([self.shape(c) for c in node.children]))
        found = self.shapes.get(key)
        if found is None:
            found = self.shapes[key] = len(self.tags)
            self.tags.append(node.tag)
            self.parts.append(key[1])
            self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
        node.shape = found
        return found

    def score(self, a: int, b: int) -> int:
        """Nodes of the largest order-preserving match of two subtrees whose roots match."""
        if a == b:
            return self.sizes[a]
        if self.tags[a] != self.tags[b]:
            return 0
        key = (a, b)
        found = self.scores.get(key)
        if found is None:
            if len(self.scores) > self.bound:
                self.scores.clear()
            found = self.scores[key] = 1 + self._best(self.parts[a], self.parts[b])[0]
        return found

    def _best(self, xs, ys, trace: bool = False):
        """Score of two child lists, and the pairs of their places that reach it.

        Equal shapes at both ends are matched at once: no other match of them counts more.
        """
        head = 0
        while head < len(xs) and head < len(ys) and xs[head] == ys[head]:
            head += 1
        tail = 0
        while tail < len(xs) - head and tail < len(ys) - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        total = sum(self.sizes[x] for x in xs[:head]) + sum(self.sizes[x] for x in xs[len(xs) - tail :])
        mx, my = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        table = [[0] * (len(my) + 1)]
        for x in mx if my else ():
            above, row = table[-1], [0]
            for j, y in enumerate(my):
                row.append(max(above[j] + self.score(x, y), above[j + 1], row[j]))
            table.append(row)
        if not trace:
            return total + table[-1][-1], None
        pairs = [(k, k) for k in range(head)]
        i, j = len(table) - 1, len(my)
        middle = []
        while i and j:
            w = self.score(mx[i - 1], my[j - 1])
            if w and table[i][j] == table[i - 1][j - 1] + w:
                middle.append((head + i - 1, head + j - 1))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        pairs += reversed(middle)
        pairs += [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
        return total + table[-1][-1], pairs

    def align(self, reference: Node, page: Node) -> Iterator[tuple[Node, Node]]:
        """Matched nodes, the roots first."""
        work = [(reference, page)]
        while work:
            a, b = work.pop()
            yield a, b
            if a.tag == "#":
                continue
            _, pairs = self._best([c.shape for c in a.children], [c.shape for c in b.children], trace=True)
            work += [(a.children[i], b.children[j]) for i, j in pairs]


def numbered(tree: Node) -> Node:
    n = 0
    work = [tree]
    while work:
        node = work.pop()
        node.number, n = n, n + 1
        work += reversed(node.children)
    return tree


def _has(node: Node, tags: frozenset[str]) -> bool:
    work = [node]
    while work:
        n = work.pop()
        if n.tag in tags:
            return True
        if not n.drop:
            work += n.children
    return False


HEADINGS = frozenset(("h1", "h2"))
#: Elements that hold words themselves, not the page's larger parts.
BLOCKS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table figure address hr".split())


def weights(reference_pairs: list[tuple[Node, Node]], page: Node) -> list[tuple[int, int, int]]:
    """Of matched larger parts and headings: number, differing prose below in the page, and that in words of their own."""
    twin = {b: a for a, b in reference_pairs}
    below: dict[Node, int] = {}
    found: list[tuple[int, int, int]] = []
    order: list[tuple[Node, int]] = []
    work = [(page, NAMED)]
    while work:
        node, factor = work.pop()
        if node.tag == "a" or node.drop == BY_KIND:
            factor = 0
        elif node.drop:
            factor = 1
        order.append((node, factor))
        if factor:
            work += [(c, factor) for c in node.children]
    for node, factor in reversed(order):
        if node.tag == "#":
            other, words = twin.get(node), _plain(node.text)
            below[node] = 0 if other is not None and _plain(other.text) == words else factor * len(words)
            continue
        parts = [(c, below.pop(c, 0)) for c in node.children]
        total = sum(w for _, w in parts)
        own = sum(w for c, w in parts if c.tag == "#" or c.tag in INLINE or c.tag in BLOCKS)
        below[node] = total
        if total and node in twin and (node.tag in HEADINGS or node.tag not in BLOCKS and node.tag not in INLINE):
            found.append((twin[node].number, total, own))
    return found


def content_slot(reference: Node, weight: dict[int, int], own: dict[int, int]) -> int | None:
    """Number of the element that holds the host's content; none if nothing differs."""
    node = reference
    if not weight.get(node.number):
        return None

    def headed(n: Node) -> bool:
        return n.tag in HEADINGS and weight.get(n.number, 0) > 0 or any(headed(c) for c in n.children)

    while True:
        total = weight[node.number]
        inner = max((c for c in node.children if c.tag not in BLOCKS and c.tag not in INLINE), key=lambda c: weight.get(c.number, 0), default=None)
        if inner is None or weight.get(inner.number, 0) < INTO * total or own.get(node.number, 0) > OWN * total:
            return node.number
        if any(headed(c) for c in node.children if c is not inner):
            return node.number
        node = inner


def main_text(tree: Node, template: set[Node], slot: Node | None = None) -> str:
    """Text of the content slot; without one, of the slots that are not template: those of the article, or all where none is marked."""
    if slot is not None:
        if _has(slot, CONTENT) and slot.tag not in CONTENT:
            found = _slots_text(slot, template, True)
            if found:
                return found
        found = _slots_text(slot, template, False, slotted=True)
        if found:
            return found
    if not _has(tree, CONTENT):
        return _slots_text(tree, template, False)
    found = _slots_text(tree, template, True)
    if template and not found:
        found = _slots_text(tree, template, False) or _slots_text(tree, set(), True)
    return found


def _slots_text(tree: Node, template: set[Node], marked: bool, slotted: bool = False) -> str:
    out: list[str] = []
    known = marked or slotted

    def walk(node: Node, inside: bool) -> None:
        if node.tag == "#":
            if inside and node not in template:
                out.append(node.text)
            return
        if node.tag == "#space":
            out.append(" ")
            return
        if node.drop and node is not tree and not (inside and known and node.drop == BY_HEADER and _has_heading(node)):
            out.append(" ")
            return
        inside = inside or node.tag in CONTENT
        block = node.tag not in INLINE
        if block:
            out.append(" ")
        if not block or not _link_list(node, known):
            for c in node.children:
                walk(c, inside)
        if block:
            out.append(" ")

    walk(tree, not marked)
    return " ".join(entities.unescape("".join(out)).split())


def _has_heading(node: Node) -> bool:
    return any(c.tag in HEADINGS or _has_heading(c) for c in node.children)


def _link_list(node: Node, marked: bool) -> bool:
    """A list whose text lies in links: a menu.  Only asked for where no article is marked."""
    if marked or node.tag not in ("ul", "ol"):
        return False
    linked = total = 0
    work = [(c, False) for c in node.children]
    while work:
        n, link = work.pop()
        if n.tag == "#":
            size = len(n.text.strip())
            total += size
            linked += size * link
        work += [(c, link or n.tag == "a") for c in n.children]
    return total > 0 and linked >= 0.8 * total


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _plain(text: str) -> str:
    return " ".join(text.split())


def references(pages: DataFrame) -> DataFrame:
    """One page per host: of the smallest id among those at the lower quartile of html lengths."""
    sizes = pages.filter("html IS NOT NULL").select("host", "page_id", F.length("html").alias("size"))
    typical = sizes.groupBy("host").agg(F.percentile_approx("size", 0.25).alias("size"))
    chosen = sizes.join(typical, ["host", "size"]).groupBy("host").agg(F.min("page_id").alias("page_id"))
    rows = pages.filter("html IS NOT NULL").join(chosen, ["host", "page_id"]).groupBy("host").agg(F.min("html").alias("reference"))
    return staged(rows, "references")


def slots(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """host, n, constant, weights: distinct other pages of a host, the reference's text nodes that come back in most of
    them, and its elements with the differing prose that the pages have in their place."""
    vote = pa.struct({"node": pa.int32(), "same": pa.int32(), "weight": pa.int64(), "own": pa.int64()})
    kinds = {"host": pa.string(), "digest": pa.string(), "votes": pa.list_(vote)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        for batch in batches:
            rows = []
            for host, digest, source, reference in zip(*(c.to_pylist() for c in batch.columns)):
                if source != reference:
                    page = parse(source)
                    pairs = list(trees.aligned(reference, page))
                    votes = [(-1, 1, 0, 0)]
                    votes += [(a.number, 1, 0, 0) for a, b in pairs if a.tag == "#" and _plain(a.text) == _plain(b.text)]
                    votes += [(n, 0, weight, own) for n, weight, own in weights(pairs, page)]
                    rows.append((host, digest, [dict(zip(("node", "same", "weight", "own"), v)) for v in votes]))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], list(kinds))

    joined = pages.filter("html IS NOT NULL").join(refs, "host").select("host", F.md5("html").alias("digest"), "html", "reference")
    votes = joined.mapInArrow(run, "host string, digest string, votes array<struct<node:int,same:int,weight:bigint,own:bigint>>")
    # Copies of a page say nothing more about its template: one vote each.
    votes = votes.groupBy("host", "digest").agg(F.first("votes").alias("votes"))
    counts = votes.select("host", F.inline("votes")).groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("same", "weight", "own")])
    # As many entries as the reference has nodes.
    nodes = counts.groupBy("host").agg(
        F.max(F.when(F.col("node") < 0, F.col("same"))).alias("n"), F.collect_list(F.struct("node", "same", "weight", "own")).alias("nodes")
    )
    constant = F.expr(f"transform(filter(nodes, x -> x.node >= 0 AND n >= {MIN_PAGES} AND x.same >= {SHARE} * n), x -> x.node)")
    weighed = F.expr(f"transform(filter(nodes, x -> x.weight > 0 AND n >= {MIN_PAGES}), x -> struct(x.node, x.weight, x.own))")
    return nodes.select("host", "n", constant.alias("constant"), weighed.alias("weights"))


class Trees:
    """Reference trees of one task; a few stay at hand."""

    def __init__(self) -> None:
        self.matcher, self.known = Matcher(), {}

    def aligned(self, reference: str, page: Node) -> Iterator[tuple[Node, Node]]:
        tree = self.known.get(reference)
        if tree is None:
            if len(self.known) > 64:
                self.matcher, self.known = Matcher(), {}
            tree = self.known[reference] = numbered(parse(reference))
            self.matcher.shape(tree)
        self.matcher.shape(page)
        return self.matcher.align(tree, page)


def induce(pages: DataFrame) -> DataFrame:
    """host, reference, constant, slot: one row per host."""
    refs = references(pages)
    kinds = {"host": pa.string(), "reference": pa.string(), "constant": pa.list_(pa.int32()), "slot": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, reference, constant, weighed = batch.columns
            found = []
            for source, entries in zip(reference.to_pylist(), weighed.to_pylist()):
                entries = entries or []
                weight, own = ({x["node"]: x[k] for x in entries} for k in ("weight", "own"))
                found.append(content_slot(numbered(parse(source)), weight, own) if entries else None)
            cols = [host, reference, constant, pa.array(found, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, kinds.values())], list(kinds))

    rows = refs.join(slots(pages, refs), "host", "left").select("host", "reference", "constant", "weights")
    return staged(rows.mapInArrow(run, "host string, reference string, constant array<int>, slot int"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and slotted of every row; slotted where the text comes from the host's content slot."""
    pages = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        host_of(F.col("url").cast("string")).alias("host"),
    )
    wrappers = induce(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        for batch in batches:
            ids, urls, sources, refs, constants, places = batch.columns
            texts, slotted = [], []
            for source, reference, constant, place in zip(*(c.to_pylist() for c in (sources, refs, constants, places))):
                page, template, slot = parse(source or ""), set(), None
                if source and (constant or place is not None):
                    numbers = set(constant or ())
                    for a, b in trees.aligned(reference, page):
                        if a.number == place:
                            slot = b
                        if a.number in numbers and _plain(a.text) == _plain(b.text):
                            template.add(b)
                texts.append(main_text(page, template, slot))
                slotted.append(slot is not None)
            cols = [ids, urls, pa.array(texts, pa.string()), pa.array(slotted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "slotted"])

    rows = pages.join(wrappers, "host", "left").select("page_id", "url", "html", "reference", "constant", "slot")
    return rows.mapInArrow(run, "page_id long, url string, text string, slotted boolean")
