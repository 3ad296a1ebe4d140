"""Main text of web pages by wrapper induction.

Pages of one host share a template. Up to ``REFERENCE_PAGES`` trees of a host are merged into a reference
tree by simple tree matching: what one page has at a place that the others leave open is added to it.
Every page is aligned with its host's reference, and over all pages is counted, for each node, how often
it holds text, how much, and whether the text is ever another. From these the wrapper follows:

* A node with one text on ``CONSTANT_SHARE`` of the pages is template.
* The content region is found from the root downwards: into the box that holds most of the varying
  text, as long as no other heading, paragraph or article would be left behind (``_region``).

What stands outside the region, and constant nodes in it, are left out. Names of elements and classes
decide only on parts of the region (comments, forms, adverts), and on pages without a wrapper: those of
hosts with fewer than ``LEAST_PAGES`` pages, and those that do not fill their host's region.

Counts are formed with map-side partial sums, so a host with a third of all pages is no heavier than
its share. The matching is exact at every size: long lists of children are halved until they fit into
memory (Hirschberg, 1975), which changes no weight.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import checkpointed, per_batch

#: A node is template if one text fills it on this share of the host's pages, and the host has so many.
CONSTANT_SHARE, LEAST_PAGES = 0.9, 5
#: Pages of a host whose trees make up its reference.
REFERENCE_PAGES = 5
#: A box is entered if it holds this share of the varying text, and nodes filled on this share of pages count.
REGION_SHARE, FILLED_SHARE = 0.6, 0.5
#: Templates are broadcast up to this many bytes; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20
#: Cells of the alignment of two lists that are held at once.
_CELLS = 1 << 20
#: Shapes of trees that a worker remembers; a full memory is emptied.
_MEMORY = 500_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Element names of the HTML standard by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset(
    "head nav aside footer form button select option input dialog menu object canvas audio video map".split()
)
_BOXES = frozenset("#root html body main article section div center table tbody tr td".split())
_PROSE = frozenset("article blockquote h1 h2 h3 h4 h5 h6 main p pre".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_PARAGRAPH = ({"p"}, {"td", "th", "li", "article", "section", "div", "blockquote"})
#: Words in a class, id or role that mark parts other than the article.
_ASIDE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies discussion disqus footer gdpr login menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets alert dialog form masthead".split()
)
#: Words that say nothing of their own after one of these: ``comment-list``, but not ``search-engine-news``.
_PARTS = frozenset(
    "area bar block body bottom box button buttons column container content group header heading icon icons inner "
    "item items left link links list main message outer panel posts right row section slot space text title top "
    "unit wrap wrapper zone".split()
)
_MAIN = frozenset("article content entry main post story".split())
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def _names_aside(name: str) -> bool:
    """Whether one class, id or role marks another part than the article: its last word does, or its first
    with nothing telling after it."""
    words = _WORDS.findall(name)
    if not words:
        return False
    return words[-1] in _ASIDE or words[0] in _ASIDE and all(w in _ASIDE or w in _PARTS for w in words[1:])


class Node:
    __slots__ = ("blocks", "children", "main", "shape", "sig", "skip", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.children, self.blocks, self.shape = tag, [], [], -1
        words: list[str] = []
        hidden, names, aside = False, "", False
        if attrs and not attrs.isspace():
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role"):
                    value = value.lower()
                    words += _WORDS.findall(value)
                    aside = aside or any(map(_names_aside, value.split()))
                    names += ".".join(_DIGITS.sub("#", value).split()) if name == "class" else ""
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
                elif name == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
        self.sig = f"{tag}.{names}" if names else tag
        inside = parent is not None and parent.main
        self.main = inside or tag in ("article", "main") or not _MAIN.isdisjoint(words)
        aside = aside or not inside and (tag == "header" or "header" in words)
        self.skip = hidden or tag in _NEVER or aside and tag not in ("html", "body", "article", "main")


def parse(page: str) -> Node:
    """The tree of a page. Each node holds its block texts, in place among its children."""
    root = Node("#root", "", None)
    stack, held, run = [root], {}, []

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1].blocks.append((len(stack[-1].children), text))

    def leave(depth: int) -> None:
        flush()
        while len(stack) > depth:
            held[stack.pop().tag] -= 1

    def close(tags: set[str], until: set[str]) -> None:
        if any(held.get(t) for t in tags):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in until:
                    return
                if stack[depth].tag in tags:
                    return leave(depth)

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            run.append(page[last : m.start()])
        last = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                run.append(" ")
            continue  # inline elements neither start a block nor take part in the template
        if m["end"]:
            if held.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                leave(depth)
            continue
        close(*_CLOSES.get(tag, _PARAGRAPH))
        flush()
        child = Node(tag, m["attrs"], stack[-1])
        stack[-1].children.append(child)
        if tag not in _VOID and not m["attrs"].endswith("/"):
            stack.append(child)
            held[tag] = held.get(tag, 0) + 1
    run.append(page[last:])
    flush()
    return root


def _preorder(root) -> list:
    """(depth, node) of a tree of nodes or slots, in page order."""
    out, todo = [], [(0, root)]
    while todo:
        depth, node = todo.pop()
        out.append((depth, node))
        todo += [(depth + 1, c) for c in reversed(node.children)]
    return out


def skeleton(root) -> str:
    """A tree of element names as JSON: depths and names in page order."""
    found = _preorder(root)
    return json.dumps([[d for d, _ in found], [n.sig for _, n in found]], separators=(",", ":"))


class Slot:
    """A node of a reference tree; numbers follow page order."""

    __slots__ = ("children", "number", "shape", "sig")

    def __init__(self, sig: str) -> None:
        self.sig, self.children, self.number, self.shape = sig, [], -1, -1


def slots(tree: str) -> list[Slot]:
    """The slots of a skeleton in page order, the root first."""
    out, path = [], []
    for number, (depth, sig) in enumerate(zip(*json.loads(tree), strict=True)):
        slot = Slot(sig)
        slot.number = number
        if depth:
            path[depth - 1].children.append(slot)
        del path[depth:]
        path.append(slot)
        out.append(slot)
    return out


class Shapes:
    """Trees by their shape: equal ones share a number, and the matching of two shapes is worked out once."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.sig: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def mark(self, root) -> None:
        """Give every node of a tree the number of its shape."""
        for _, node in reversed(_preorder(root)):
            key = (node.sig, tuple(c.shape for c in node.children))
            at = self.number.get(key)
            if at is None:
                at = self.number[key] = len(self.sig)
                self.sig.append(key[0])
                self.children.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            node.shape = at

    def weight(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes that match in order under matching parents."""
        if a == b:
            return self.size[a]
        if self.sig[a] != self.sig[b]:
            return 0
        if not self.children[a] or not self.children[b]:
            return 1
        out = self.known.get((a, b))
        if out is None:
            head, tail, a_rest, b_rest = self._trimmed(self.children[a], self.children[b])
            out = 1 + head + tail
            if a_rest and b_rest:
                out += int(_scores(*self._table(a_rest, b_rest))[-1])
            self.known[a, b] = out
        return out

    def _trimmed(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int, tuple, tuple]:
        """Equal shapes at both ends match in some best alignment; their sizes, and the rest of both lists."""
        least, head, tail, front, back = min(len(a), len(b)), 0, 0, 0, 0
        while head < least and a[head] == b[head]:
            front += self.size[a[head]]
            head += 1
        while tail < least - head and a[-1 - tail] == b[-1 - tail]:
            back += self.size[a[-1 - tail]]
            tail += 1
        return front, back, a[head : len(a) - tail], b[head : len(b) - tail]

    def _table(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights of distinct shapes, which of them each of ``a`` is, and each of ``b``)."""
        a_of, b_of = {s: i for i, s in enumerate(dict.fromkeys(a))}, {s: i for i, s in enumerate(dict.fromkeys(b))}
        named: dict[str, list[int]] = {}
        for s in b_of:
            named.setdefault(self.sig[s], []).append(s)
        table = np.zeros((len(a_of), len(b_of)), np.int64)
        for s, i in a_of.items():
            for t in named.get(self.sig[s], ()):
                table[i, b_of[t]] = self.weight(s, t)
        return table, np.array([a_of[s] for s in a]), np.array([b_of[s] for s in b])

    def pairs(self, a: list, b: list) -> list[tuple]:
        """The pairs of two lists of marked nodes in a best alignment, in order."""
        x, y = tuple(n.shape for n in a), tuple(n.shape for n in b)
        least, head, tail = min(len(x), len(y)), 0, 0
        while head < least and x[head] == y[head]:
            head += 1
        while tail < least - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        out = list(zip(a[:head], b[:head], strict=True))
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if x and y:
            out += [(a[head + i], b[head + j]) for i, j in _traced(*self._table(x, y))]
        return out + list(zip(a[len(a) - tail :], b[len(b) - tail :], strict=True))


def _scores(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best weight of ``a`` against every beginning of ``b``."""
    best = np.zeros(len(b) + 1, np.int64)
    for i in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + table[i][b]))
    return best


def _traced(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of the pairs of a best alignment."""
    if len(a) * len(b) > _CELLS and len(a) > 1:
        half = len(a) // 2
        both = _scores(table, a[:half], b) + _scores(table, a[half:][::-1], b[::-1])[::-1]
        cut = int(both.argmax())
        return _traced(table, a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _traced(table, a[half:], b[cut:])]
    rows = [np.zeros(len(b) + 1, np.int64)]
    for i in a:
        row = rows[-1].copy()
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[i][b]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


_SHAPES = [Shapes()]


def _shapes() -> Shapes:
    """This worker's memory of shapes."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be as deep as pages are long
    if len(_SHAPES[0].sig) + len(_SHAPES[0].known) > _MEMORY:
        _SHAPES[0] = Shapes()
        reference.cache_clear()
        wrapper.cache_clear()
    return _SHAPES[0]


def align(root: Node, slot: Slot, shapes: Shapes) -> dict[int, Node]:
    """Which node fills which slot, by simple tree matching. Both trees are marked by ``shapes``."""
    out, todo = {}, [(root, slot)]
    while todo:
        node, at = todo.pop()
        out[at.number] = node
        if node.children and at.children:
            todo += shapes.pairs(node.children, at.children)
    return out


def merged(trees: list[str]) -> str:
    """One reference for several skeletons: the largest, and what others have in places it leaves open."""
    shapes = _shapes()
    trees = sorted(dict.fromkeys(trees), key=lambda t: (-len(t), t))
    root = slots(trees[0])[0]
    for tree in trees[1:]:
        other = slots(tree)[0]
        for number, (_, slot) in enumerate(_preorder(root)):
            slot.number = number
        shapes.mark(root)
        shapes.mark(other)
        by_number = {slot.number: slot for _, slot in _preorder(root)}
        for number, node in align(other, root, shapes).items():
            _insert(by_number[number], node, shapes)
    return skeleton(root)


def _insert(slot: Slot, node: Slot, shapes: Shapes) -> None:
    """Add to ``slot`` the children of ``node`` that match none of its own, where their place is plain: between
    two neighbours, or at an end."""
    if not node.children:
        return
    match = {id(n): s for n, s in shapes.pairs(node.children, slot.children)}
    place = {id(s): i for i, s in enumerate(slot.children)}
    new: dict[int, list[Slot]] = {}
    run, before = [], -1
    for child in [*node.children, None]:
        found = None if child is None else match.get(id(child))
        if child is not None and found is None:
            run.append(child)
            continue
        at = len(slot.children) if child is None else place[id(found)]
        if run and at == before + 1:
            new.setdefault(at, []).extend(run)
        run, before = [], at
    if new:
        slot.children = [c for i in range(len(slot.children) + 1) for c in [*new.get(i, ()), *slot.children[i : i + 1]]]


def _text_hash(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


def _own(node: Node) -> str:
    return "\n".join(text for _, text in node.blocks)


def _region(order: list[Slot], varying: dict[int, int], filled: dict[int, int], pages: int) -> int:
    """The number of the slot that holds the content, by the varying text of a host's pages.

    From the root, the box with ``REGION_SHARE`` of the varying text is entered, unless that would leave
    varying text of the node itself, or a heading, paragraph or article on ``FILLED_SHARE`` of the pages,
    behind. Parts that are named as menus, adverts and the like may be left behind; an article is never left.
    """
    mass, prose = dict(varying), {}
    for slot in reversed(order):
        tag, _, names = slot.sig.partition(".")
        prose[slot.number] = tag in _PROSE and varying.get(slot.number, 0) > 0 and filled[slot.number] >= FILLED_SHARE * pages
        for child in slot.children:
            mass[slot.number] = mass.get(slot.number, 0) + mass.get(child.number, 0)
            prose[slot.number] |= prose[child.number]
        if tag in _NEVER or tag == "header" or any(map(_names_aside, names.split("."))):
            prose[slot.number] = False
    at = order[0]
    while at.children and not at.sig.startswith(("article", "main")):
        total = mass.get(at.number, 0)
        heavy = max(at.children, key=lambda c: mass.get(c.number, 0))
        if not total or mass.get(heavy.number, 0) < REGION_SHARE * total or heavy.sig.partition(".")[0] not in _BOXES:
            break
        if varying.get(at.number, 0) > 0.02 * total or any(prose[c.number] for c in at.children if c is not heavy):
            break
        at = heavy
    return at.number


def induced(tree: str, pages: int, nodes: list[tuple[int, int, int, int | None]]) -> str:
    """A host's wrapper as JSON: reference tree, region, and the hash of the text of every constant node.

    ``nodes``: (number, pages on which it holds text, characters of varying text, hash of a constant text or
    None) of every slot that holds text on some page.
    """
    varying, filled = {n: v for n, _, v, _ in nodes}, {n: f for n, f, _, _ in nodes}
    region = _region(slots(tree), varying, filled, pages)
    return json.dumps([tree, region, {n: h for n, _, _, h in sorted(nodes) if h is not None}], separators=(",", ":"))


@lru_cache(maxsize=512)
def reference(tree: str) -> Slot:
    """The root of a skeleton, marked."""
    root = slots(tree)[0]
    _SHAPES[0].mark(root)
    return root


class Wrapper:
    def __init__(self, text: str) -> None:
        tree, self.region, constant = json.loads(text)
        self.constant = {int(n): h for n, h in constant.items()}
        self.root = reference(tree)


@lru_cache(maxsize=512)
def wrapper(text: str) -> Wrapper:
    return Wrapper(text)


def _collect(node: Node, constant: set[int], out: list[str]) -> None:
    """The block texts under a node in page order, without those of constant and of skipped nodes."""

    def parts(n: Node):
        at, texts = 0, [] if id(n) in constant else n.blocks
        for place, text in texts:
            yield from (c for c in n.children[at:place] if not c.skip)
            at = place
            yield text
        yield from (c for c in n.children[at:] if not c.skip)

    todo = [parts(node)]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        elif isinstance(part, str):
            out.append(part)
        else:
            todo.append(parts(part))


def _containers(base: Node) -> tuple[list[Node], list[Node]]:
    """The outermost articles and the outermost main containers under a node, in page order."""
    articles, mains, todo = [], [], [(c, base, False) for c in reversed(base.children)]
    while todo:
        node, parent, within = todo.pop()
        if node.skip:
            continue
        if node.tag == "article" and not within:
            articles.append(node)
        elif node.main and not parent.main:
            mains.append(node)
        todo += [(c, node, within or node.tag == "article") for c in reversed(node.children)]
    return articles, mains


def main_text(page: str, host: Wrapper | None = None) -> str:
    """The text of a page's article: its blocks in page order, joined by newlines.

    With the host's wrapper, the region it names, without constant nodes; if all of the region is constant,
    its text stays. Inside the region (or the page, where there is no wrapper or it does not fit) articles
    are taken, else main containers, else all of it.
    """
    root, bases, fixed = parse(page), [], set()
    if host is not None:
        shapes = _SHAPES[0]
        shapes.mark(root)
        filled = align(root, host.root, shapes)
        fixed = {id(n) for k, n in filled.items() if host.constant.get(k) == _text_hash(_own(n))}
        if host.region in filled:
            bases.append(filled[host.region])
    bases.append(root)
    for base in bases:
        groups = [[base]] if base.main else [*_containers(base), [base]]
        for leave_out in (fixed, set()) if fixed else (fixed,):
            for nodes in groups:
                texts: list[str] = []
                for n in nodes:
                    _collect(n, leave_out, texts)
                if texts:
                    return "\n".join(texts)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> (page_id, url, text, n_chars), one row per row.

    A null or empty html, and a page without text, give an empty text. A page whose url is null or
    names no host has no wrapper; its article is found by element names alone. Null page_ids and
    repeated rows stay; other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit("")))
    key = F.xxhash64("html")
    # The least hash of each of 16 residues: a few rows a host at most, formed with partial sums.
    few = (
        rows.where("host IS NOT NULL AND html <> ''")
        .groupBy("host", F.pmod(key, F.lit(16)).alias("part"))
        .agg(F.min(key).alias("key"), F.count("*").alias("n"))
    )
    hosts = checkpointed(
        few.groupBy("host")
        .agg(F.sum("n").alias("n_pages"), F.slice(F.array_sort(F.collect_list("key")), 1, REFERENCE_PAGES).alias("keys"))
        .where(F.col("n_pages") >= LEAST_PAGES)
    )

    def bounded(df: DataFrame, size) -> DataFrame:
        total = df.agg(F.sum(size)).first()[0] or 0
        return F.broadcast(df) if total <= BROADCAST_BYTES else df

    def skeletons(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([skeleton(parse(h)) for h in batch.column("html").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), made], ["host", "key", "tree"])

    wanted = hosts.select("host", F.explode("keys").alias("key"))
    chosen = rows.withColumn("key", key).join(bounded(wanted, F.length("host") + 40), ["host", "key"]).select("host", "key", "html")
    found = per_batch(chosen, skeletons, "host string, key long, tree string").dropDuplicates(["host", "key"])
    by_host = found.groupBy("host").agg(F.collect_list("tree").alias("trees"))  # REFERENCE_PAGES at most

    def references(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [merged(trees) for trees in batch.column("trees").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], ["host", "tree"])

    trees = checkpointed(per_batch(by_host, references, "host string, tree string"))

    def filled(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes, seen = _shapes(), {}
        for host, page, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tree")), strict=True):
            root = parse(page)
            shapes.mark(root)
            for number, n in align(root, reference(tree), shapes).items():
                if n.blocks:
                    text = _own(n)
                    at = seen.setdefault((host, number, _text_hash(text)), [0, 0])
                    at[0] += 1
                    at[1] += len(text)
        made = [[k[0] for k in seen], [k[1] for k in seen], [k[2] for k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["host", "node", "text", "n", "chars"])

    seen = rows.select("host", "html").join(bounded(trees, F.length("tree") + 40), "host").select("host", "html", "tree")
    counts = per_batch(seen, filled, "host string, node int, text long, n long, chars long").groupBy("host", "node", "text").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars")
    )
    sized = counts.join(bounded(hosts.select("host", "n_pages"), F.length("host") + 40), "host")
    constant = F.col("n") >= CONSTANT_SHARE * F.col("n_pages")
    nodes = sized.groupBy("host", "n_pages", "node").agg(
        F.sum("n").alias("filled"), F.coalesce(F.sum(F.when(~constant, F.col("chars"))), F.lit(0)).alias("varying"),
        F.max(F.when(constant, F.col("text"))).alias("text"),
    )
    # One entry for each node of a host's tree.
    per_host = nodes.groupBy("host", "n_pages").agg(F.collect_list(F.struct("node", "filled", "varying", "text")).alias("nodes"))

    def wrappers(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [
            induced(tree, n, [(x["node"], x["filled"], x["varying"], x["text"]) for x in found])
            for tree, n, found in zip(*(batch.column(c).to_pylist() for c in ("tree", "n_pages", "nodes")), strict=True)
        ]
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], ["host", "wrapper"])

    templates = checkpointed(per_batch(trees.join(per_host, "host"), wrappers, "host string, wrapper string"))

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        _shapes()
        found = [
            main_text(page, wrapper(made) if made else None)
            for page, made in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper")), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                pa.array([len(t) for t in found], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    joined = rows.join(bounded(templates, F.length("wrapper") + 40), "host", "left").select("page_id", "url", "html", "wrapper")
    return per_batch(joined, texts, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    """The rows of query op3."""
    return extract(pages)
