"""HTML extraction by wrapper induction.

For each host, up to SAMPLES pages (those with the smallest hashes under as many
seeds: a bounded sample that Spark's aggregation picks without moving pages) are
parsed to DOM trees and aligned with one of them by simple tree matching. Nodes
whose own text is the same wherever they match, on pages that aren't copies of
one article, are constant: the host's template. The others are varying slots, and
the lowest node that holds most of their text, or the article around it, is the
content region. Every page of the host is then aligned with the reference tree,
and the blocks of its content region are taken, without the template's nodes and
without elements that are no article by their own markup (menus, footers, forms,
adverts, comments). A page that nothing aligns with is its own reference.

Matching is iterative. Children that agree in structure at either end of both
lists are paired at once, which costs no weight; if what is left between them
makes more than CELLS pairs, it is paired greedily in order instead of by
dynamic programming.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import batches_of, chunks, store

SAMPLES = 8
#: Wrappers are broadcast up to this many bytes, and joined by host beyond.
WRAPPER_BYTES = 48 << 20
#: Share of the varying text that the content region holds at least.
MASS = 0.7
#: Pairs of children that one table of the matching holds at most.
CELLS = 40_000
#: Pages that share this much of the reference's text are copies of its article.
COPY = 0.6

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("nav footer aside form script style noscript template iframe svg math button select option textarea input head title dialog menu object canvas".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Customary names (class, id, role) of elements that are no article.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs header "
    "footer masthead comment comments disqus share sharing social related recommended recommendations newsletter subscribe subscription widget pager pagination complementary contentinfo search".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    names: str = ""  # class, id and role
    parts: list = field(default_factory=list)  # texts and nodes, in order
    size: int = 1  # nodes of the subtree
    at: int = 0  # number in document order
    shape: int = 0  # number of the subtree's structure
    chars: int = 0  # of the subtree's texts
    holds: bool = False  # whether an article is in it
    children: list = field(default_factory=list)

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def parse(page: str | None) -> Node:
    """A tolerant DOM: unclosed elements end with their parents, a page may stop anywhere."""
    root = Node("#root")
    stack, pos, page = [root], 0, page or ""
    raw_end: re.Pattern | None = None
    while pos < len(page):
        if raw_end is not None:  # inside a script and the like: nothing is markup until its end tag
            m = raw_end.search(page, pos)
            pos = m.end() if m else len(page)
            stack.pop()
            raw_end = None
            continue
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start() if m else len(page)]
        if text:
            stack[-1].parts.append(html.unescape(text))
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None or not m[4]:
            continue  # a comment, a declaration or a tag that was cut off
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSED_BY else ():
            if stack[i].tag in HOLDS[tag]:
                break
            if stack[i].tag in CLOSED_BY[tag]:
                del stack[i:]
                break
        names = " ".join(a[1] or a[2] or a[3] or a[0] for a in _ATTRIBUTE.findall(m[3])) if m[3] and "=" in m[3] or "hidden" in m[3] else ""
        node = Node(tag, names)
        stack[-1].parts.append(node)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            if tag in RAW:
                raw_end = re.compile(rf"</{tag}\s*>|</{tag}\s*\Z", re.I)
    _number(root)
    return root


def _number(root: Node) -> None:
    for i, node in enumerate(order := nodes(root)):
        node.at = i
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.tag, node.names, *(c.shape for c in node.children)))
        node.holds = node.tag in ("article", "main", "h1") or any(c.holds for c in node.children)
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in node.children if c.tag not in RAW)


def nodes(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def _ends(cx: list[Node], cy: list[Node]) -> tuple[int, int]:
    """How many children at the start and at the end of both lists agree in structure."""
    n, front, back = min(len(cx), len(cy)), 0, 0
    while front < n and cx[front].shape == cy[front].shape:
        front += 1
    while back < n - front and cx[-1 - back].shape == cy[-1 - back].shape:
        back += 1
    return front, back


def _greedy(cx: list[Node], cy: list[Node]) -> list[tuple[Node, Node]]:
    """Children of the same tag and names paired in order, each with the next that is there."""
    places: dict[tuple[str, str], list[int]] = {}
    for j in range(len(cy) - 1, -1, -1):
        places.setdefault((cy[j].tag, cy[j].names), []).append(j)
    out, upto = [], 0
    for x in cx:
        own = places.get((x.tag, x.names), [])
        while own and own[-1] < upto:
            own.pop()
        if own and own[-1] - upto <= len(cy) // 8 + 1:  # a far one would skip too much
            upto = own.pop() + 1
            out.append((x, cy[upto - 1]))
    return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of nodes of the largest order-keeping alignment whose roots match."""
    memo: dict[tuple[int, int], tuple[int, object]] = {}  # weight, and how the children were paired
    if a.tag != b.tag or a.names != b.names:
        return []
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (x.at, y.at)
        if key in memo:
            todo.pop()
            continue
        if x.shape == y.shape:
            memo[key] = (x.size, None)
            continue
        front, back = _ends(x.children, y.children)
        cx, cy = x.children[front : len(x.children) - back], y.children[front : len(y.children) - back]
        wide = len(cx) * len(cy) > CELLS
        pairs = _greedy(cx, cy) if wide else [(u, v) for u in cx for v in cy if u.tag == v.tag and u.names == v.names]
        missing = [(u, v) for u, v in pairs if (u.at, v.at) not in memo]
        if missing:
            todo.extend(missing)
            continue
        weight = 1 + sum(c.size for c in x.children[:front]) + sum(c.size for c in x.children[len(x.children) - back :])
        if wide:
            memo[key] = (weight + sum(memo[u.at, v.at][0] for u, v in pairs), pairs)
            continue
        of = {(u.at, v.at): memo[u.at, v.at][0] for u, v in pairs}
        table = [[0] * (len(cy) + 1)]
        for u in cx:
            above, row = table[-1], [0]
            for j, v in enumerate(cy):
                w = of.get((u.at, v.at), 0)
                row.append(max(above[j + 1], row[j], above[j] + w))
            table.append(row)
        chosen, i, j = [], len(cx), len(cy)
        while i and j:
            w = of.get((cx[i - 1].at, cy[j - 1].at), 0)
            if w and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                chosen.append((cx[i], cy[j]))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        memo[key] = (weight + table[-1][-1], chosen)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.shape == y.shape:
            todo.extend(zip(x.children, y.children, strict=True))
            continue
        front, back = _ends(x.children, y.children)
        todo.extend(zip(x.children[:front], y.children[:front], strict=True))
        todo.extend(zip(x.children[len(x.children) - back :], y.children[len(y.children) - back :], strict=True))
        todo.extend(memo[x.at, y.at][1])
    return out


def excluded(node: Node, inside: bool, root: Node) -> bool:
    """Whether an element is no article by its own markup; ``inside``: of an article, whose headers belong to it.

    Names are whole words of class, id and role; outside of an article their parts
    between hyphens count too. An element with an article in it, or, on a page
    without one, with most of the text isn't excluded by its names.
    """
    if node.tag in SKIP:
        return True
    names = node.names.lower().split()
    if inside:
        return any(x in NOT_CONTENT and x != "header" for x in names) and not node.holds
    if node.holds or (not root.holds and 2 * node.chars > root.chars):
        return False
    return node.tag == "header" or any(part in NOT_CONTENT for x in names for part in (x, *x.replace("_", "-").split("-")))


def region(root: Node, mass: dict[int, int]) -> int:
    """Number of the lowest node that has MASS of the varying text (by node number); the article around it if there is one."""
    total = dict.fromkeys(range(root.size), 0)
    parent: dict[int, Node] = {}
    for node in reversed(nodes(root)):
        total[node.at] = mass.get(node.at, 0) + sum(total[c.at] for c in node.children)
        for c in node.children:
            parent[c.at] = node
    best, down = root, True
    while down and total[root.at]:
        down = False
        for c in best.children:
            if total[c.at] >= MASS * total[root.at]:
                best, down = c, True
                break
    up: Node | None = best
    while up is not None:
        if up.tag in ("article", "main"):
            return up.at
        up = parent.get(up.at)
    while best.tag in INLINE or best.tag in ("p", "h1", "h2", "h3", "li", "td"):
        best = parent[best.at]
    return best.at


def _slots(root: Node, constant: frozenset[int] | set[int] = frozenset()) -> dict[int, int]:
    """Length of the varying text of each node that markup doesn't exclude."""
    out, todo = {}, [(root, False)]
    while todo:
        node, inside = todo.pop()
        if excluded(node, inside, root):
            continue
        if node.at not in constant:
            out[node.at] = len(node.own_text())
        inside |= node.tag in ("article", "main")
        todo.extend((c, inside) for c in node.children)
    return out


def induce(samples: list[str]) -> tuple[str, list[int], int]:
    """Reference page, numbers of its constant nodes, number of its content region."""
    trees = [parse(s) for s in samples]
    best = sorted(range(len(trees)), key=lambda i: (-trees[i].size, samples[i]))[len(trees) // 2]  # of middling size
    reference = trees[best]
    same: dict[int, int] = {}
    seen: dict[int, int] = {}
    of = {n.at: n.own_text() for n in nodes(reference)}
    content = _slots(reference)
    total = sum(content.values())
    for i, tree in enumerate(trees):
        if i == best:
            continue
        equal = [(x.at, of[x.at] == y.own_text()) for x, y in match(reference, tree)]
        if total and sum(content.get(at, 0) for at, e in equal if e) >= COPY * total:
            continue  # a copy of the article: what it shares is no template
        for at, e in equal:
            if of[at]:
                seen[at] = seen.get(at, 0) + 1
                same[at] = same.get(at, 0) + e
    inline = {n.at for n in nodes(reference) if n.tag in INLINE}  # parts of their blocks
    constant = {k for k, n in seen.items() if n >= 2 and same[k] == n and k not in inline}
    slots = _slots(reference, constant)
    if not any(slots.values()):  # copies of one page: no slot varies
        constant, slots = set(), _slots(reference)
    return samples[best], sorted(constant), region(reference, slots)


def blocks(root: Node, drop: set[int]) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out, held = [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    todo: list = [root]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif part is root or not (part.at in drop or excluded(part, True, root)):
            if part.tag in INLINE:
                if part.tag == "br":
                    held.append(" ")
                todo.extend(reversed(part.parts))
            else:
                flush()
                todo.append(None)
                todo.extend(reversed(part.parts))
    flush()
    return out


class Wrapper:
    """A host's reference tree, its constant nodes and its content region."""

    def __init__(self, reference: str, constant: list[int], content: int):
        self.tree, self.constant, self.content = parse(reference), set(constant), content

    def extract(self, page: str | None) -> str:
        tree = parse(page)
        pairs = match(self.tree, tree)
        target = next((y for x, y in pairs if x.at == self.content and x is not self.tree), None)
        drop = set()
        if target is not None:
            drop = {y.at for x, y in pairs if x.at in self.constant and x.own_text() == y.own_text()}
            found = blocks(target, drop)
            if found:
                return "\n".join(found)
        own = _slots(tree, drop)
        if not any(own.values()):
            own, drop = _slots(tree), set()
        if not any(own.values()):
            return ""
        at = region(tree, own)
        return "\n".join(blocks(next(n for n in nodes(tree) if n.at == at), drop))


def host(url: str = "url") -> Column:
    """Host of a URL in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, constant, content) of every host with two pages or more in its sample."""
    rows = pages.select(host().alias("host"), "html", "page_id", "url").filter("host IS NOT NULL AND html IS NOT NULL")
    picks = [F.min_by("html", F.xxhash64(F.lit(seed), "page_id", "url", "html")).alias(f"s{seed}") for seed in range(SAMPLES)]
    sampled = rows.groupBy("host").agg(*picks)
    schema = pa.schema([("host", pa.string()), ("reference", pa.string()), ("constant", pa.list_(pa.int32())), ("content", pa.int32())])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                samples = sorted({r[f"s{i}"] for i in range(SAMPLES)})
                if len(samples) > 1:
                    out.append((r["host"], *induce(samples)))
            if out:
                yield from batches_of(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    return sampled.mapInArrow(run, "host string, reference string, constant array<int>, content int")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null html is empty; a null or odd url has no host, so the page is its own
    reference; copies and repeated rows each give a row; an empty table gives
    none; extra columns are ignored.
    """
    learned = store(wrappers(pages))
    size = learned.agg(F.sum(F.octet_length("reference") + 4 * F.size("constant") + 64)).first()[0] or 0
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    out = "page_id long, url string, text string, n_chars long"
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    empty = Wrapper("", [], 0)

    def texts(part, known):
        text = [(known(i) or empty).extract(x) for i, x in enumerate(part["html"])]
        return batches_of(schema, page_id=part["page_id"], url=part["url"], text=text, n_chars=list(map(len, text)))

    if size <= WRAPPER_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: (r.reference, r.constant, r.content) for r in learned.collect()})

        def near(batches):
            ready: dict = {}

            def of(name):
                if name not in ready and name in sent.value:
                    if len(ready) > 500:
                        ready.clear()
                    ready[name] = Wrapper(*sent.value[name])
                return ready.get(name)

            for part in chunks(batches, "html"):
                yield from texts(part, lambda i, part=part: of(part["host"][i]))

        return rows.mapInArrow(near, out)

    def joined(batches):
        last: tuple = (None, None)
        for part in chunks(batches, "html"):

            def of(i, part=part):
                nonlocal last
                if part["reference"][i] is None:
                    return None
                if last[0] != part["host"][i]:
                    last = (part["host"][i], Wrapper(part["reference"][i], part["constant"][i], part["content"][i]))
                return last[1]

            yield from texts(part, of)

    return rows.join(learned, "host", "left").mapInArrow(joined, out)
