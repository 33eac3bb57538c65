"""Main text of pages by wrapper induction over the pages of a host.

SEEDS pages of each host (those with the smallest hash of their id and text)
are parsed into DOM trees and aligned by simple tree matching with the one
among them that is most like the others. A node whose text is the same on all
seeds that have it, at least half of them, is template; every other node is a
slot. The main region is found by going down from the root, always to the
child that holds most of the slots' text outside of links; where that leaves a
doubt, its role (element or class name) weighs in. Every page is then aligned
with its host's template: nodes on constant ones lose their text, and of the
rest the main region stays, without what is never main text (forms, scripts,
styles, menus) or bears a class such as advert or comments.

A page that has nothing like its host's main region is judged by itself.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

#: Pages of a host that its template is induced from.
SEEDS = 8
#: Bytes of all templates up to which they are sent to every executor; more of them are joined by host, in SALTS parts.
SMALL_BYTES, SALTS = 8 << 20, 16
#: Rows of seeds (host and hash) up to which they are sent to every executor.
SENT = 200_000
#: Share of the slots' text that a child needs to be gone down to (more if a like one stands beside it), and how much a role weighs.
MOST, MOST_OF_LIKE, WEIGHT = 0.6, 0.8, 8.0
#: Pages that must agree on a text before it goes from the main region: two pages can share a paragraph of their own.
WITNESSES = 3
#: Depth of the tree: deeper elements hang at this depth, with all their text.
DEPTH = 200
#: Pairs of siblings that are matched with each other in full; in longer lists siblings with equal texts are matched first and those between them in order.
CELLS = 2500

# Elements without content, elements that end an open paragraph, and roles that are not main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCKS - {"br", "body", "html", "head", "td", "th", "tr", "li", "title", "caption", "legend", "summary"}
DROPPED = frozenset("aside button dialog footer form head header iframe input menu nav noscript option script select style svg template textarea title".split())
ROLES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
MAIN_ROLES = frozenset("article content entry main post story".split())
CONTAINERS = frozenset("article body center div html main section table tbody td tr #root".split())

# no alternative looks beyond the next '<' but through quotes, so a page of broken tags takes time in proportion to its length
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg)\b[^<>]*>.*?(?:</\1\s*>|$)|<[!?][^<>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S | re.I)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("constant", "depth", "elements", "kids", "main", "name", "parent", "tag", "text")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent, self.kids, self.elements = tag, name, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.text, self.constant, self.main = "", False, False
        if parent:
            parent.kids.append(self)
            parent.elements.append(self)

    def all(self):
        """The node and all below it, in page order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.elements)


def parse(page: str) -> Node:
    """The DOM tree of a page; unclosed and stray tags are mended. A node's text is what is not in child elements."""
    root = at = Node("#root", "", None)
    for m in _TOKEN.finditer(page):
        raw, end, tag, attributes, text = m.groups()
        if text is not None:
            at.kids.append(entities.unescape(text) if "&" in text else text)
        elif tag:
            tag = tag.lower()
            if end:
                node = at
                while node is not None and node.tag != tag:
                    node = node.parent
                if node is not None and node.parent is not None:
                    at = node.parent
                continue
            if tag in ENDS_P or tag in ("li", "td", "th", "tr"):  # these end an open paragraph or a like item
                node, stop = at, ("p",) if tag in ENDS_P else (tag,)
                while node is not None and node.tag not in ("#root", "article", "body", "div", "section", "ul", "ol", "table", "main"):
                    if node.tag in stop:
                        at = node.parent
                        break
                    node = node.parent
            name = " ".join(x for y in _NAME.findall(attributes) for x in y if x) if attributes else ""
            node = Node(tag, name, at)
            if tag not in VOID and not attributes.endswith("/") and node.depth < DEPTH:
                at = node
    for node in root.all():
        node.text = " ".join(" ".join(x for x in node.kids if isinstance(x, str)).split())
    return root


def role(node: Node) -> int:
    """1: of main text, -1: not, 0: nothing is known. Of a class name such as cookie-notice the last word counts."""
    if node.tag in ("article", "main"):
        return 1
    if node.tag in DROPPED:
        return -1
    words = {w for x in node.name.lower().split() for w in (x, re.split("[-_]", x)[-1])}
    return -1 if words & ROLES else 1 if words & MAIN_ROLES else 0


class Alignment:
    """Simple tree matching of two trees: pairs of nodes of the same element, children in order.

    A pair counts one, and one more each for the same class names and the same
    text, so that of several alignments one that keeps equal texts together wins.
    """

    def __init__(self, a: Node, b: Node):
        self.ways: dict[tuple[int, int], list] = {}
        self.score = self._score(a, b)
        self.pairs: list[tuple[Node, Node]] = []
        todo = [(a, b)] if self.score else []
        while todo:
            x, y = todo.pop()
            self.pairs.append((x, y))
            todo += self.ways.get((id(x), id(y)), ())

    def _score(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        own = 1 + (a.name == b.name) + (a.text == b.text != "")
        x, y = a.elements, b.elements
        if not x or not y:
            return own
        total, way = 0, []
        if len(x) * len(y) <= CELLS:
            total, way = self._fully(x, y)
        else:
            left = right = 0
            for i, j in [*self._equals(x, y), (len(x), len(y))]:
                for p, q in [*zip(x[left:i], y[right:j], strict=False), *zip(x[i : i + 1], y[j : j + 1], strict=True)]:
                    if n := self._score(p, q):
                        total += n
                        way.append((p, q))
                left, right = i + 1, j + 1
        self.ways[id(a), id(b)] = way
        return own + total

    def _fully(self, x: list[Node], y: list[Node]) -> tuple[int, list]:
        scores = [[self._score(p, q) for q in y] for p in x]
        best = [[0] * (len(y) + 1)]
        for row in scores:
            above, new = best[-1], [0]
            for j, n in enumerate(row):
                new.append(max(above[j + 1], new[j], above[j] + n if n else 0))
            best.append(new)
        way, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                way.append((x[i], y[j]))
        return best[-1][-1], way[::-1]

    @staticmethod
    def _equals(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
        """Places of siblings with the same element and text, each once in both lists, in rising order."""
        sides = []
        for nodes in (x, y):
            found: dict = {}
            for i, n in enumerate(nodes):
                found.setdefault((n.tag, n.text), []).append(i)
            sides.append({k: v[0] for k, v in found.items() if len(v) == 1 and k[1]})
        out, last = [], -1
        for k, i in sides[0].items():
            if (j := sides[1].get(k, -1)) > last:
                out.append((i, j))
                last = j
        return out


def _masses(trees: list[tuple[Node, dict[int, Node]]]) -> dict[int, float]:
    """Slots' text outside of links below each node of the template; trees: each with the template's nodes by id of its own."""
    own: dict[int, float] = {}
    for tree, of in trees:
        todo = [(tree, of.get(id(tree)), False)]
        while todo:
            node, at, link = todo.pop()
            at, link = of.get(id(node), at), link or node.tag == "a"
            if node.tag in ("script", "style", "head", "title", "noscript", "template", "option"):
                continue
            if at is not None and not link and not (at.constant and at.text == node.text):
                own[id(at)] = own.get(id(at), 0.0) + len(node.text)
            todo += [(k, at, link) for k in node.elements]
    return own


def _mark_main(template: Node, own: dict[int, float]) -> None:
    below: dict[int, float] = {}
    for node in reversed(list(template.all())):
        below[id(node)] = own.get(id(node), 0.0) + sum(below[id(k)] for k in node.elements)
    at = template
    while at.elements and role(at) < 1:
        weights = [below[id(k)] * WEIGHT ** role(k) for k in at.elements]
        most = max(range(len(weights)), key=weights.__getitem__)
        alone = sum(k.tag == at.elements[most].tag and k.name == at.elements[most].name for k in at.elements) == 1
        here = own.get(id(at), 0.0)
        if at.elements[most].tag not in CONTAINERS or weights[most] <= 0 or weights[most] < (MOST if alone else MOST_OF_LIKE) * (here + sum(weights)):
            break
        at = at.elements[most]
    at.main = True


def induce(pages: list[str]) -> Node:
    """The template of some pages of a host: the nodes that at least half of them have, with constant texts and the main region marked.

    Pages with the same text are copies: their agreement says nothing, so one of them stands for all.
    """
    trees = list({" ".join(n.text for n in t.all() if n.text and role(n) >= 0): t for t in map(parse, pages)}.values())
    aligned = {(i, j): Alignment(a, b) for i, a in enumerate(trees) for j, b in enumerate(trees) if i != j} if len(trees) > 1 else {}
    middle = max(range(len(trees)), key=lambda i: (sum(aligned[i, j].score for j in range(len(trees)) if j != i), -i))
    template = trees[middle]
    texts = {id(n): [n.text] for n in template.all()}
    others = []
    for j, tree in enumerate(trees):
        pairs = aligned[middle, j].pairs if j != middle else [(n, n) for n in template.all()]
        others.append((tree, {id(q): p for p, q in pairs}))
        if j != middle:
            for p, q in pairs:
                texts[id(p)].append(q.text)
    enough = max(2, -(-len(trees) // 2))
    for n in template.all():
        found = texts[id(n)]
        n.constant = n.text != "" and len(found) >= enough and len(set(found)) == 1
    if len(trees) > 1:
        for n in list(template.all()):
            n.elements = [k for k in n.elements if len(texts[id(k)]) >= enough]
    _mark_main(template, _masses(others))
    for n in next(n for n in template.all() if n.main).all():
        n.constant = n.constant and len(texts[id(n)]) >= WITNESSES
    return template


def packed(node: Node) -> list:
    """The template as [element, class names, constant text or null, main region, children]."""
    return [node.tag, node.name, node.text if node.constant else None, int(node.main), [packed(k) for k in node.elements]]


def unpacked(data: list, parent: Node | None = None) -> Node:
    node = Node(data[0], data[1], parent)
    node.text, node.constant, node.main = data[2] or "", data[2] is not None, bool(data[3])
    for k in data[4]:
        unpacked(k, node)
    return node


def main_text(page: str, template: Node | None) -> str:
    """The main text of a page; template: of its host, or none."""
    root = parse(page)
    region, constants = None, set()
    if template is not None:
        for t, n in Alignment(template, root).pairs:
            if t.main:
                region = n
            if t.constant and t.text == n.text:
                constants.add(id(n))
    if region is None or role(region) < 1 and any(n.tag in ("article", "main") for n in root.all() if not _within(n, region)):
        _mark_main(root, _masses([(root, {id(n): n for n in root.all()})]))
        region = next(n for n in root.all() if n.main)
    out = [""]

    def walk(node: Node) -> None:
        if node is not region and role(node) < 0:
            return
        block = node.tag in BLOCKS
        if block:
            out.append("")
        for k in node.kids:
            if isinstance(k, str):
                if id(node) not in constants:
                    out[-1] += k
            else:
                walk(k)
        if block:
            out.append("")

    walk(region)
    parts = (" ".join(b.split()) for b in out)
    return " ".join(p for p in parts if p)


def _within(node: Node | None, region: Node) -> bool:
    while node is not None and node is not region:
        node = node.parent
    return node is region


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON): one row per host with pages that are not blank.

    Seeds are ranked by ids and hashes alone, which Spark limits per task before
    its shuffle, so a large host is no heavy group; their pages are fetched by a join.
    """
    rows = pages.select(_host().alias("host"), F.xxhash64("page_id", "html").alias("h"), "html").where(F.length(F.trim("html")) > 0)
    order = Window.partitionBy("host").orderBy("h")
    seeds = cut(rows.select("host", "h").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SEEDS))
    # SEEDS short rows a host: sent to the pages, so that no page is shuffled, if their number allows it
    found = rows.join(F.broadcast(seeds) if seeds.count() <= SENT else seeds, ["host", "h"]).dropDuplicates(["host", "h"])

    def run(frame):
        import pandas as pd

        own = frame.sort_values("nth")
        return pd.DataFrame({"host": [own["host"].iloc[0]], "template": [json.dumps(packed(induce(own["html"].tolist())))]})

    return found.groupBy("host").applyInPandas(run, "host string, template string")


def _extract(batches):
    held: dict[str, Node] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            page_id, url, html, template = (some.column(i) for i in range(4))
            out = []
            for page, t in zip(html.to_pylist(), template.to_pylist(), strict=True):
                if t is not None and t not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[t] = unpacked(json.loads(t))
                out.append(main_text(page, held.get(t)) if page else "")
            yield pa.record_batch([page_id, url, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has an empty text. A null url counts as the host ''.
    Repeated rows and ids are extracted each by itself; a page of any length or
    depth is parsed whole. Other columns of ``pages`` are not read.
    """
    found = cut(templates(pages))
    size = found.agg(F.coalesce(F.sum(F.octet_length("template")), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", _host().alias("host"))
    if size <= SMALL_BYTES:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        parts = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(parts, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
