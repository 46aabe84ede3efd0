"""Main text of web pages by wrapper induction over the pages of a host.

1. Layouts. Pages of a host are told apart by layout: the containers of the first levels and how
   they are nested. Up to ``references`` distinct contents of each layout, the least by keyed hashes of
   page_id, stand for it, so no layout is without, however many a host has.
2. Alignment. Every page is aligned with each reference of its layout by simple tree matching
   (equal root labels, then the best order-preserving matching of the children); it belongs to the
   one it matches best. For every reference node this counts the pages that have it, those
   whose text there is the same, and the varying text below it. Counts are summed per task before
   the shuffle, so a host that holds most pages costs no more rows than another. Only distinct contents
   of a host count, so copies of one page make nothing constant.
3. Wrapper. Nodes whose text is constant over a layout's contents are template, on pages with that
   text. The content slot is found from the root: as long as one container below holds most of the
   varying text, it is entered. Menus, comments and footers lie beside it, whatever they are called.
4. Extraction. Of each page, the subtree aligned with the slot is read, without template nodes.

Names of parts (nav, aside, class="ad" and the like) decide only where induction can't: on pages of a
layout with fewer than ``constant_pages`` contents, and on pages without a node at the slot. Inside the
slot, they leave out what no other page has at its place: blocks that the alignment left over.

Text: character references decoded once, white space inside a block becomes one space, blocks in page
order joined by one space; nothing else is dropped. Markup is read as browsers do: an unclosed tag
or quote takes the rest of the page, and elements nested deeper than 512 become siblings.
Defined results: a null or empty page has an empty text; broken or cut-off markup is read as far as it
goes; pages without host share the empty host; repeated rows are extracted each; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, drop_cut, gathered, map_rows, small_batches, table

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # trees of DEEPEST levels, a few calls each


@dataclass(frozen=True)
class Params:
    """``constant``: share of at least ``constant_pages`` pages on which a template text is the same;
    ``slot``: share of the varying text that leads into a container. References and counts of up to
    ``broadcast_bytes`` in all are broadcast; more are joined by layout."""

    references: int = 3
    levels: int = 3
    constant: float = 0.8
    constant_pages: int = 4
    slot: float = 0.5
    broadcast_bytes: int = 32 << 20


INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rb rt rp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math object select canvas audio video".split())
NAMED = set("nav aside footer form button dialog menu fieldset".split())
CONTAINERS = set("html body main article section div table tbody tr td center".split())
SECTIONS = set("p h1 h2 h3 h4 h5 h6 ul ol dl div section article aside nav header footer main table form blockquote pre hr figure figcaption address fieldset".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class or id that name a part which is no article, whatever else is there.
STRONG = set("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promotion comment comments commentlist disqus replies respond cookie cookies consent gdpr newsletter subscribe signup popup modal paywall".split())
#: The same unless other words name content.
WEAK = set("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead banner notice notices notification alert share sharing social related recommended recommendations widget widgets toolbar login search pagination pager copyright disclaimer hidden skip topbar".split())
CONTENT = set("content article main post entry body story text".split())

#: A comment, a tag (closing mark, name, attributes), or other markup. Whatever follows the name is some
#: attribute, and the end of the page ends each of them, so a match never fails after its start and
#: no character is looked at twice.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_HEAD = re.compile(r"<(?:(/head)\b[^>]*>|body\b)", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NUMBER = re.compile("[0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DEEPEST = 512


class Node:
    __slots__ = ("children", "index", "items", "label", "linked", "named", "shape", "size", "tag", "text")

    def __init__(self, tag: str, label: str, named: bool) -> None:
        self.tag, self.label, self.named = tag, label, named
        self.items: list = []  # strings and nodes, in order
        self.linked = 0  # characters inside links
        self.children: list[Node] = []
        self.text, self.index, self.size, self.shape = "", 0, 1, 0


def parse(page: str | None) -> Node:
    """The block tree of a page; inline markup is dissolved, text is decoded."""
    root = Node("html", "html", False)
    stack, inline, page, at = [root], [], page or "", 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            top = stack[-1]
            plain = entities.unescape(text) if "&" in text else text
            top.items.append(plain)
            if "a" in inline:
                top.linked += len(plain.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in RAW and not end and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            stack[-1].items.append("\n" if tag != "wbr" else "")
            if tag != "hr":
                continue
        if tag == "head" and not end:
            shut = _HEAD.search(page, at)
            at = shut.end() if shut and shut[1] else at  # a head that ends before the body is passed over
            continue
        if tag in VOID or tag in ("html", "body", "head"):
            continue
        if tag in INLINE and not _named(tag, m[3])[1]:
            if not end:
                inline.append(tag)
            elif tag in inline:
                del inline[len(inline) - 1 - inline[::-1].index(tag)]
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    inline = [x for x in inline if x != "a"]
                    break
            continue
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in SECTIONS else set())
        while len(stack) > 1 and (stack[-1].tag in closes or len(stack) > DEEPEST):
            stack.pop()
        label, named = _named(tag, m[3])
        node = Node(tag, label, named)
        stack[-1].items.append(node)
        stack.append(node)
        if m[3].endswith("/"):
            stack.pop()
    _finish(root)
    return root


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether the part names itself as no article)."""
    if not attributes or attributes == "/":
        return tag, tag in NAMED
    a = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    words = {w.lower() for w in _WORD.findall(a.get("class", "") + " " + a.get("id", ""))}
    label = f"{tag}.{_NUMBER.sub('', a['class'])}" if a.get("class") else tag  # class="post-17" is that of its siblings
    if tag in ("main", "html", "body") or a.get("role") == "main":
        return label, False
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    return label, tag in NAMED or hidden or a.get("role") in ROLES or bool(words & STRONG) or (bool(words & WEAK) and not words & CONTENT and tag != "article")


def _finish(root: Node) -> None:
    """Preorder numbers, sizes, own texts and children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(order)
        order.append(node)
        node.children = [x for x in node.items if isinstance(x, Node)]
        node.text = " ".join(" ".join(x if isinstance(x, str) else "\n" for x in node.items).split())
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.label, *(c.shape for c in node.children)))
        if node.tag == "header" and not any(c.tag in ("h1", "h2") for c in node.children):
            node.named = True


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|svg|template|noscript)\b.*?(?:</\1\b|\Z)", re.S | re.I)
_BOX = re.compile(r"<(/?)(article|aside|center|dialog|div|fieldset|footer|form|header|main|menu|nav|section|table)\b([^>]*+)", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'>]*)""", re.I)


def layout(page: str | None, levels: int) -> int:
    """A number for the containers of the first levels: their tags and first class words without digits,
    by the path to them; how often they come doesn't count. Read off the tags, without a tree."""
    paths, stack = set(), []
    for m in _BOX.finditer(_HIDDEN.sub(" ", page or "")):
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, _ in stack[-64:]):
                while stack.pop()[0] != tag:
                    pass
            continue
        path = None
        if len(stack) < levels:
            word = _CLASS.search(m[3])
            path = (stack[-1][1] if stack else "") + "/" + tag + "." + (_NUMBER.sub("", word[1]) if word else "")
            paths.add(path)
        stack.append((tag, path))
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Match:
    """Simple tree matching of nodes; scores are remembered by the shapes of the two subtrees."""

    CELLS = 1 << 22  # of a table of scores that is kept whole; longer lists are halved

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def score(self, a: Node, b: Node) -> int:
        """The number of pairs of the largest matching that keeps order and parents."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = a.shape, b.shape
        if key not in self.known:
            low, high = self._ends(a.children, b.children)
            own = 1 + sum(c.size for c in a.children[:low]) + sum(c.size for c in a.children[len(a.children) - high :])
            x, y = a.children[low : len(a.children) - high], b.children[low : len(b.children) - high]
            self.known[key] = own + (int(self._rows(x, y)[-1]) if x and y else 0)
        return self.known[key]

    def pairs(self, a: Node, b: Node, out: list[tuple[Node, Node]]) -> None:
        """The pairs of one such matching."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a.label != b.label:
                continue
            out.append((a, b))
            if a.shape == b.shape:
                todo += zip(a.children, b.children, strict=True)
                continue
            low, high = self._ends(a.children, b.children)
            todo += zip(a.children[:low], b.children[:low], strict=True)
            if high:
                todo += zip(a.children[-high:], b.children[-high:], strict=True)
            todo += self._chosen(a.children[low : len(a.children) - high], b.children[low : len(b.children) - high])

    @staticmethod
    def _ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
        """How many first and last children have equal shapes; some largest matching pairs them all."""
        most = min(len(x), len(y))
        low = next((k for k in range(most) if x[k].shape != y[k].shape), most)
        high = next((k for k in range(most - low) if x[-1 - k].shape != y[-1 - k].shape), most - low)
        return low, high

    def _gains(self, c: Node, y: list[Node]) -> np.ndarray:
        own: dict[int, int] = {}
        return np.array([own[d.shape] if d.shape in own else own.setdefault(d.shape, self.score(c, d)) for d in y], dtype=np.int64)

    def _rows(self, x: list[Node], y: list[Node], table: list | None = None) -> np.ndarray:
        """best[j]: the largest matching of all of x with the first j of y; ``table`` gets every row."""
        best, gains = np.zeros(len(y) + 1, dtype=np.int64), {}
        if table is not None:
            table.append(best)
        for c in x:
            if c.shape not in gains:
                gains[c.shape] = self._gains(c, y)
            best = np.concatenate([best[:1], np.maximum.accumulate(np.maximum(best[1:], best[:-1] + gains[c.shape]))])
            if table is not None:
                table.append(best)
        return best

    def _chosen(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        if not x or not y:
            return []
        if len(x) * len(y) > self.CELLS and len(x) > 1:  # the best place to halve both lists
            half = len(x) // 2
            ahead, behind = self._rows(x[:half], y), self._rows(x[half:][::-1], y[::-1])[::-1]
            at = int(np.argmax(ahead + behind))
            return self._chosen(x[:half], y[:at]) + self._chosen(x[half:], y[at:])
        table: list[np.ndarray] = []
        self._rows(x, y, table)
        out, i, j = [], len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                out.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
        return out


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Simple tree matching: the number of matched nodes; the pairs of one such matching."""
    m = Match()
    m.pairs(a, b, pairs)
    return m.score(a, b)


def masses(root: Node, by_name: bool) -> dict[int, int]:
    """Characters outside links below every node of a tree; outside named parts too, if asked."""
    out: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        own = max(0, len(node.text) - node.linked) + sum(out[c.index] for c in node.children)
        out[node.index] = 0 if by_name and node.named else own
    return out


def align(page: Node, references: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
    """The reference that fits best and its matched pairs (reference node, page node)."""
    m = Match()
    _, k = min((-2 * m.score(r, page) / (r.size + page.size), k) for k, r in enumerate(references))
    pairs: list[tuple[Node, Node]] = []
    m.pairs(references[k], page, pairs)
    return k, pairs


class Wrapper:
    """Content slot and template nodes of a reference, from the counts (pages, equal, mass) of its
    nodes. ``by_name``: named parts are not entered."""

    def __init__(self, root: Node, counts: dict[int, tuple[int, int, int]], p: Params, by_name: bool = False) -> None:
        pages = counts.get(0, (0, 0, 0))[0]
        self.enough = pages >= p.constant_pages
        self.template = {i for i, (_, equal, _) in counts.items() if self.enough and equal >= p.constant * pages}
        mass = lambda n: counts.get(n.index, (0, 0, 0))[2]
        slot = root
        while True:
            inner = [c for c in slot.children if c.tag in CONTAINERS and not (by_name and c.named)]
            best = max(inner, key=mass, default=None)
            if best is None or mass(best) < p.slot * mass(slot) or mass(best) == 0:
                break
            if best.tag == "div" and slot.tag in ("article", "main") and mass(best) < 0.9 * mass(slot):
                break
            slot = best
            if slot.tag == "article":
                break
        self.slot = slot.index


def read(slot: Node, left_out: Callable[[Node], bool], template: set[int]) -> list[str]:
    """Blocks of a page's subtree in order, without template (page node numbers) and parts left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        block = " ".join("".join(run).split())
        if block:
            out.append(block)
        run.clear()

    todo: list = [(slot, iter(slot.items))]
    while todo:
        node, items = todo[-1]
        for x in items:
            if isinstance(x, str):
                if node.index not in template:
                    run.append(x)
            else:
                close()
                if not left_out(x):
                    todo.append((x, iter(x.items)))
                    break
        else:
            close()
            todo.pop()
    return out


def extract(page: Node, references: list[Node], wrappers: list[Wrapper], p: Params) -> str:
    """The text at the slot of the page's best reference; by names where there is none."""
    if references:
        k, pairs = align(page, references)
        w = wrappers[k]
        slot = next((node for r, node in pairs if r.index == w.slot), None) if w.enough else None
        if slot is not None and masses(page, False)[slot.index]:
            met = {node.index for _, node in pairs}
            template = {node.index for r, node in pairs if r.index in w.template and node.text == r.text}
            return " ".join(read(slot, lambda n: n.named and n.index not in met, template))
    counts = {i: (1, 0, m) for i, m in masses(page, True).items()}
    at, todo = Wrapper(page, counts, p, by_name=True).slot, [page]
    while todo:
        slot = todo.pop()
        if slot.index == at:
            break
        todo += slot.children
    return "" if slot.named else " ".join(read(slot, lambda n: n.named, set()))


def host(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _least(k: int) -> F.Column:
    least = F.min(F.struct(F.xxhash64("page_id", F.lit(k)).alias("h"), "page_id", "html"))
    return F.struct(least["page_id"].alias("page_id"), least["html"].alias("html"))


def with_layout(pages: DataFrame, columns: list[str], p: Params) -> DataFrame:
    """``columns`` of ``pages`` with the layout of each."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in columns}

    def rows(got: dict[str, list]) -> dict[str, list]:
        return got | {"layout": [layout(h, p.levels) for h in got["html"]]}

    return map_rows(pages, list(dict.fromkeys([*columns, "html"])), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", layout bigint", rows)


def contents(pages: DataFrame, p: Params) -> DataFrame:
    """(host, layout, page_id, html): every distinct content of a host once, with its least page_id.
    Only ids and digests are grouped; the pages of the least ids are joined back."""
    filled = pages.filter(F.octet_length("html") > 0).select("page_id", "html", "host", F.sha2("html", 256).alias("digest"))
    counted = with_layout(filled, ["page_id", "host", "digest"], p).groupBy("host", "layout", "digest", "page_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "n"))
    firsts = gathered(counted.groupBy("host", "layout", "digest").agg(least.alias("x")).select("layout", F.col("digest").alias("_digest"), F.col("host").alias("_host"), F.col("x.page_id").alias("_page"), F.col("x.n").alias("_n")), 400)
    same = (filled["digest"] == firsts["_digest"]) & (filled["host"] == firsts["_host"]) & filled["page_id"].eqNullSafe(firsts["_page"])
    found = filled.join(firsts, same).select("host", "layout", "page_id", "digest", "html", "_n")
    if firsts.filter("_n > 1").isEmpty():
        return found.select("host", "layout", "page_id", "html")
    once = found.filter("_n > 1").dropDuplicates(["host", "page_id", "digest"])  # repeated rows
    return found.filter("_n = 1").union(once).select("host", "layout", "page_id", "html")


def references(pages: DataFrame, p: Params) -> DataFrame:
    """(host, layout, refs): an array of up to ``references`` pages for every layout of every host."""
    least = pages.filter(F.col("page_id").isNotNull()).groupBy("host", "layout").agg(*[_least(k).alias(f"r{k}") for k in range(p.references)])
    array = F.array_distinct(F.array(*[f"r{k}" for k in range(p.references)]))
    return least.select("host", "layout", F.array_sort(array).alias("refs"))


def _bytes(known: DataFrame) -> int:
    """Bytes of all references, their keys and their counts in a worker."""
    own = F.aggregate("refs", F.lit(0).cast("long"), lambda a, r: a + F.octet_length(r["html"]) + 64) + F.octet_length("host") + 64
    return known.agg(F.sum(own + (40 * F.size("counts") if "counts" in known.columns else 0))).first()[0] or 0


class Known:
    """References of layouts, and wrappers where there are counts, made when first asked for."""

    def __init__(self, p: Params, rows: dict | None = None) -> None:
        self.p, self.rows, self.made = p, rows, {}

    def of(self, key: tuple[str, int], refs: list | None = None, counts: list | None = None) -> tuple[list[Node], list[Wrapper]]:
        if key not in self.made:
            if len(self.made) > 500:
                self.made.clear()
            if self.rows is not None:
                refs, counts = self.rows.get(key, (None, None))
            trees, by = [parse(x["html"]) for x in refs or []], defaultdict(dict)
            for c in counts or []:
                by[c["ref"]][c["node"]] = c["pages"], c["equal"], c["mass"]
            self.made[key] = trees, [Wrapper(t, by[k], self.p) for k, t in enumerate(trees)]
        return self.made[key]


def _shared(known: DataFrame, p: Params) -> Broadcast | None:
    """The rows of ``known`` by layout for all workers, if they are within the bound."""
    if _bytes(known) > p.broadcast_bytes:
        return None
    rows = known.toArrow().to_pylist()  # at most broadcast_bytes
    return known.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): (r["refs"], r.get("counts")) for r in rows})


def count(pages: DataFrame, refs: DataFrame, p: Params) -> DataFrame:
    """(host, layout, ref, node, pages, equal, mass) summed over all contents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(pages.sparkSession)
    shared = _shared(refs, p)
    schema = "host string, layout bigint, ref int, node int, pages bigint, equal bigint, mass bigint"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(p, shared.value if shared else None)
        sums: dict[tuple[str, int, int, int], list[int]] = defaultdict(lambda: [0, 0, 0])

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            for name, kind, page, *refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trees, _ = known.of((name, kind), *refs)
                if not trees:
                    continue
                tree = parse(page)
                own = masses(tree, False)
                k, pairs = align(tree, trees)
                for r, node in pairs:
                    s = sums[name, kind, k, r.index]
                    s[0] += 1
                    s[1] += bool(node.text) and node.text == r.text
                    s[2] += own[node.index]
            if len(sums) > 100_000:
                yield flush()
        if sums:
            yield flush()

    joined = pages.select("host", "layout", "html")
    if not shared:
        joined = joined.join(refs, ["host", "layout"]).select("host", "layout", "html", "refs")
    counted = joined.mapInArrow(run, schema)
    return counted.groupBy("host", "layout", "ref", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "equal", "mass")])


def main_text(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    distinct = contents(pages, p)
    refs = cut(references(distinct, p))
    counts = count(distinct, refs, p).groupBy("host", "layout").agg(F.collect_list(F.struct("ref", "node", "pages", "equal", "mass")).alias("counts"))  # a row a reference node
    known = cut(refs.join(counts, ["host", "layout"], "left"))
    drop_cut(refs)
    shared = _shared(known, p)
    state: list[Known] = []

    def rows(got: dict[str, list]) -> dict[str, list]:
        if not state:
            state.append(Known(p, shared.value if shared else None))
        texts = []
        for k, page in enumerate(got["html"]):
            tree = parse(page)
            more = (got["refs"][k], got["counts"][k]) if "refs" in got else ()
            kind = got["layout"][k] if "layout" in got else layout(page, p.levels)
            texts.append(extract(tree, *state[0].of((got["host"][k], kind), *more), p) if page else "")
        return {"page_id": got["page_id"], "url": got["url"], "text": texts}

    columns = ["page_id", "url", "host", "html"]
    if not shared:
        pages, columns = with_layout(pages, columns, p).join(known, ["host", "layout"], "left"), [*columns, "layout", "refs", "counts"]
    return map_rows(pages, columns, "page_id bigint, url string, text string", rows)


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
