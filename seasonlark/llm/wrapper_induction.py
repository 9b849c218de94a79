"""Main text of web pages by wrapper induction.

Pages of a host are aligned with one page of that host by simple tree matching over their
block elements.  Each aligned node of the host's page is a slot; over all pages of the host,
slots whose text stays constant are template, slots that vary are content.  Parts that
HTML or common class names declare to be navigation, page furniture, adverts, forms or
comments never count as content.

The host's page and later its template meet the pages in equi-joins on the host, which
Spark splits where a host is large; per host only counts per slot are summed, before the
shuffle as far as they can be.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.scratch import materialise

#: A slot is template if at least MIN_PAGES pages have it and in this share of them the text is the same.
MIN_PAGES, CONSTANT_SHARE = 5, 0.9
#: Pages of a host that one task aligns at most, or about so.
HOST_PAGES = 5000
#: It must also be met on this share of the host's pages.
PRESENT_SHARE = 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
FURNITURE_TAGS = frozenset("nav footer aside form button head menu dialog".split())
#: Words of class, id or role names that mark what is no article text.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion reader related reply replies search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets complementary contentinfo alert masthead".split()
)
#: Words that names of furniture are made up with.
NEUTRAL_WORDS = frozenset("area bar block bottom box button container content form group header inner item left link links list outer page panel posts right section site thread top user users wrap wrapper".split())
#: Elements that hold the page or its article, whatever they are called.
NEVER_NAMED = frozenset("html body main article h1".split())
_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    """A block element: label for matching, whether it is page furniture, text runs and children in order."""

    __slots__ = ("label", "tag", "furniture", "parts")

    def __init__(self, label: str, tag: str, furniture: bool):
        self.label, self.tag, self.furniture, self.parts = label, tag, furniture, []

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)} if raw and ("=" in raw or "hidden" in raw) else {}


def _named(names: str) -> bool:
    """Whether a class, id or role is a furniture word, or made up of such words and neutral ones."""
    for token in names.split():
        words = [w.lower() for w in _NAME.findall(token)]
        if any(w in FURNITURE_WORDS for w in words) and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


def _is_furniture(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in FURNITURE_TAGS or "hidden" in attrs or (tag == "header" and not inside_article):
        return True
    return tag not in NEVER_NAMED and _named(" ".join(attrs.get(k, "") for k in ("class", "id", "role")))


def _tags(page: str):
    """(start, end, slash, name, attributes) of each tag, comment or declaration, whose name is empty.

    A quoted value may hold any character; a quote that is never closed is an ordinary one.  What
    is not found once is not looked for again, so every page takes linear time.
    """
    at, last = 0, {"-->": 0, '"': 0, "'": 0, ">": 0}

    def find(what: str, start: int) -> int:
        if last[what] < 0:
            return -1
        i = page.find(what, start)
        if i < 0:
            last[what] = -1
        return i

    while m := _OPEN.search(page, at):
        start, at = m.start(), m.end()
        if m[0] == "<!--":
            i = find("-->", at)
            at = i + 3 if i >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        close = find(">", at)
        if close < 0:
            return
        if not m[2]:
            at = close + 1
            yield start, at, "", "", ""
            continue
        i = at
        while v := _VALUE.search(page, i):
            if v[1] is None:
                close = v.start()
                break
            i = find(v[1], v.end()) + 1
            if not i:
                break
        # without an end outside quotes the tag ends at its first one
        yield start, close + 1, m[1], m[2].lower(), page[at:close]
        at = close + 1


def parse(page: str | None) -> Node:
    """The tree of block elements of a page; end tags that HTML lets authors leave out are supplied."""
    page = page or ""
    root = Node("#root", "#root", False)
    stack: list[tuple[str, Node]] = [("#root", root)]
    articles = 0
    at, end, unclosed = 0, len(page), set()

    def text(raw: str) -> None:
        if raw:
            stack[-1][1].parts.append(entities.unescape(raw))

    def leave(index: int) -> None:
        nonlocal articles
        for tag, node in stack[index:]:
            articles -= tag in ("article", "main")
        broke = any(t in BLOCK for t, _ in stack[index:])
        del stack[index:]
        if broke:
            stack[-1][1].parts.append(None)

    def close_open(tags: frozenset | set, stop: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return leave(i)
            if stack[i][0] in stop:
                return None

    for start, stop, slash, tag, raw_attrs in _tags(page):
        if start < at:
            # inside a script or the like
            continue
        text(page[at:start])
        at = stop
        if not tag:
            continue
        if slash:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if i:
                leave(i)
            elif tag == "p":
                stack[-1][1].parts.append(None)
            continue
        if tag in RAW:
            if not raw_attrs.rstrip().endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close is None:
                    unclosed.add(tag)
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag in ("br", "wbr") or tag not in BLOCK:
                if tag == "br":
                    text(" ")
            else:
                close_open({"p"}, BLOCK - {"p"})
                stack[-1][1].parts.append(None)
            continue
        if tag in CLOSES_P:
            close_open({"p"}, {"td", "th", "button", "table"})
        if tag == "li":
            close_open({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            close_open({"dd", "dt"}, {"dl"})
        elif tag in ("td", "th"):
            close_open({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            close_open({"tr"}, {"table", "tbody", "thead", "tfoot"})
        attrs = _attributes(raw_attrs)
        furniture = _is_furniture(tag, attrs, articles > 0)
        if tag in BLOCK or furniture:
            node = Node(f"{tag}.{attrs.get('class', '')}", tag, furniture)
            stack[-1][1].parts.append(node)
            stack.append((tag, node))
            articles += tag in ("article", "main")
        else:
            stack.append((tag, stack[-1][1]))
    text(page[at:])
    _keep_articles(root)
    return root


def _keep_articles(root: Node) -> None:
    """An element that is furniture by its name alone is none if it holds an article, a main element or a first heading."""
    todo, order = [(root, None)], []
    while todo:
        n, up = todo.pop()
        order.append((n, up))
        todo += [(c, n) for c in n.children()]
    holds = {id(n) for n, _ in order if n.tag in NEVER_NAMED and not n.furniture}
    for n, up in reversed(order):
        if id(n) in holds:
            if n.furniture and n.tag not in FURNITURE_TAGS and n.tag != "header":
                n.furniture = False
            if up is not None and not n.furniture:
                holds.add(id(up))


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(owner, text) of each run of text between block boundaries, in page order; furniture is left out."""
    out, run, stack = [], [], []

    def flush(owner: Node) -> None:
        if run:
            words = "".join(run).split()
            run.clear()
            if words:
                out.append((owner, " ".join(words)))

    stack.append((node, iter(node.parts)))
    while stack:
        owner, parts = stack[-1]
        for p in parts:
            if isinstance(p, str):
                run.append(p)
            else:
                flush(owner)
                if p is not None and not p.furniture:
                    stack.append((p, iter(p.parts)))
                    break
        else:
            flush(owner)
            stack.pop()
    return out


def _main(root: Node) -> list[Node]:
    """The article or main elements, outermost first met; the whole page where there is none with text."""
    found, queue = {"article": [], "main": []}, deque([root])
    while queue:
        n = queue.popleft()
        if n.furniture:
            continue
        if n.tag in found:
            found[n.tag].append(n)
            if n.tag == "article":
                continue
        queue += n.children()
    for tag in ("article", "main"):
        if any(blocks(n) for n in found[tag]):
            return found[tag]
    return [root]


class _Shapes:
    """Shapes of trees as numbers: equal labels over equal children have one number."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> dict[int, int]:
        """The shape of every node, keyed by ``id``."""
        out: dict[int, int] = {}
        todo = [(root, False)]
        while todo:
            n, done = todo.pop()
            if not done:
                todo.append((n, True))
                todo += [(c, False) for c in n.children()]
                continue
            below = tuple(out[id(c)] for c in n.children())
            key = (n.label, below)
            if key not in self.number:
                self.number[key] = len(self.label)
                self.label.append(n.label)
                self.below.append(below)
                self.size.append(1 + sum(self.size[b] for b in below))
            out[id(n)] = self.number[key]
        return out

    def trimmed(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int]:
        """Equal shapes at both ends, which a best alignment may pair at once."""
        least, head, tail = min(len(xs), len(ys)), 0, 0
        while head < least and xs[head] == ys[head]:
            head += 1
        while tail < least - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        return head, tail

    def known(self, x: int, y: int) -> int | None:
        if x == y:
            return self.size[x]
        return self.weights.get((x, y)) if self.label[x] == self.label[y] else 0

    def middle(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        head, tail = self.trimmed(xs, ys)
        return xs[head : len(xs) - tail], ys[head : len(ys) - tail]

    def ensure(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> None:
        """Weights of all pairs of two lists, by an explicit stack: pages can be thousands of elements deep."""
        todo = [(a, b) for a in set(xs) for b in set(ys)]
        while todo:
            x, y = todo[-1]
            if self.known(x, y) is not None:
                todo.pop()
                continue
            mx, my = self.middle(self.below[x], self.below[y])
            need = [(a, b) for a in set(mx) for b in set(my) if self.known(a, b) is None]
            if need:
                todo += need
                continue
            head, tail = self.trimmed(self.below[x], self.below[y])
            ends = self.below[x][:head] + self.below[x][len(self.below[x]) - tail :]
            self.weights[x, y] = 1 + sum(self.size[a] for a in ends) + int(self.last_row(mx, my)[-1])
            todo.pop()

    def last_row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        """Best sums of aligning xs with each beginning of ys; the weights are known."""
        kinds, place = np.unique(np.array(ys, np.int64), return_inverse=True)
        row, rows = np.zeros(len(ys) + 1, np.int64), {}
        for x in xs:
            if x not in rows:
                rows[x] = np.array([self.known(x, int(y)) for y in kinds], np.int64)[place] if len(ys) else np.empty(0, np.int64)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[x]))
        return row

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of a best alignment, halving xs again and again so that no whole table is held."""
        self.ensure(*self.middle(xs, ys))
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            head, tail = self.trimmed(xs[a:b], ys[c:d])
            out += [(a + i, c + i) for i in range(head)] + [(b - 1 - i, d - 1 - i) for i in range(tail)]
            a, b, c, d = a + head, b - tail, c + head, d - tail
            if a == b or c == d:
                continue
            if b - a == 1:
                w = [self.known(xs[a], y) for y in ys[c:d]]
                if max(w):
                    out.append((a, c + w.index(max(w))))
                continue
            half = (a + b) // 2
            first = self.last_row(xs[a:half], ys[c:d])
            second = self.last_row(xs[half:b][::-1], ys[c:d][::-1])[::-1]
            cut = c + int(np.argmax(first + second))
            todo += [(a, half, c, cut), (half, b, cut, d)]
        return out


def match_trees(a: Node, b: Node, shapes: _Shapes | None = None, of_b: dict[int, int] | None = None) -> dict[int, Node]:
    """Simple tree matching: an order-preserving map of nodes of the greatest size, keyed by ``id`` of a node of ``a``.

    Weights are kept by shape, so rows alike cost once, and equal shapes at both ends of two lists are
    paired at once.  Time grows with the product of two sibling lists' unlike middles, memory with their sum.
    Trees that meet the same ``b`` can share ``shapes`` and what it says of ``b``.
    """
    shapes = shapes or _Shapes()
    of = shapes.of(a) | (of_b or shapes.of(b))
    out: dict[int, Node] = {}
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        out[id(x)] = y
        xs, ys = x.children(), y.children()
        for i, j in shapes.pairs(tuple(of[id(n)] for n in xs), tuple(of[id(n)] for n in ys)):
            todo.append((xs[i], ys[j]))
    return out


def slots(root: Node) -> dict[int, int]:
    """Preorder number of each node, keyed by ``id``."""
    out, stack = {}, [root]
    while stack:
        n = stack.pop()
        out[id(n)] = len(out)
        stack += n.children()[::-1]
    return out


def aligned_blocks(root: Node, reference: Node, match: dict[int, Node] | None = None, number: dict[int, int] | None = None) -> list[tuple[int, str]]:
    """(slot of the reference page or -1, text) of each content block of a page."""
    match = match_trees(root, reference) if match is None else match
    number = number or slots(reference)
    return [(number[id(match[id(owner)])] if id(owner) in match else -1, text) for part in _main(root) for owner, text in blocks(part)]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class _Reference:
    """Reference pages of the last hosts, parsed and numbered once; weights of shapes are kept from page to page."""

    #: Shapes after which the weights are begun anew, hosts held, and characters of their pages.
    SHAPES, HOSTS, CHARS = 20_000, 64, 4_000_000

    def __init__(self):
        self.held: dict[str, list] = {}

    def blocks(self, root: Node, raw: str) -> list[tuple[int, str]]:
        """``aligned_blocks`` of a page and the reference page ``raw``."""
        own = self.held.pop(raw, None)
        if own is None:
            tree = parse(raw)
            own = [tree, slots(tree), None, None]
        # the latest is last
        self.held[raw] = own
        while len(self.held) > 1 and (len(self.held) > self.HOSTS or sum(map(len, self.held)) > self.CHARS):
            del self.held[next(iter(self.held))]
        tree, number, shapes, known = own
        if shapes is None or len(shapes.label) > self.SHAPES or len(shapes.weights) > self.SHAPES:
            shapes = _Shapes()
            own[2:] = shapes, known = shapes, shapes.of(tree)
        return aligned_blocks(root, tree, match_trees(root, tree, shapes, known), number)


def host_of(url):
    """Lower-case host of a URL column; the empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, references: DataFrame) -> DataFrame:
    """``(host, constant)``: hashes of (slot, text) pairs that are template on each host.

    A text that stays the same is template only where the rest of its pages varies: pages whose whole
    content is the same are copies, whatever their markup, and say nothing about any slot.
    """

    def count(frames):
        ref = _Reference()
        for f in frames:
            rows: dict[tuple, list[int]] = {}
            for host, page, raw in zip(f["host"], f["html"], f["ref_html"], strict=True):
                found = ref.blocks(parse(page), raw)
                seen, whole = set(found), _hash("\n".join(t for _, t in found))
                for key in [(host, -1, 0), *((host, s, _hash(t)) for s, t in seen if s >= 0), *((host, s, None) for s in {s for s, _ in seen if s >= 0})]:
                    row = rows.setdefault(key, [0, whole, whole])
                    row[:] = row[0] + 1, min(row[1], whole), max(row[2], whole)
            n, low, high = zip(*rows.values(), strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"host": [k[0] for k in rows], "slot": [k[1] for k in rows], "h": pd.array([k[2] for k in rows], "Int64"), "n": n, "low": low, "high": high})

    aligned = pages.join(references, ["host", "part"]).select("host", "html", "ref_html").mapInPandas(count, "host string, slot int, h bigint, n bigint, low bigint, high bigint")
    counts = aligned.groupBy("host", "slot", "h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    counts = materialise(counts.where((F.col("n") >= MIN_PAGES) | (F.col("slot") < 0)), "slots")
    total = counts.where("slot < 0").select("host", F.col("n").alias("pages"))
    met = counts.where("slot >= 0 and h is null").select("host", "slot", F.col("n").alias("met"))
    same = counts.where("slot >= 0 and h is not null and low < high").join(met, ["host", "slot"]).join(total, "host")
    fixed = same.where((F.col("n") >= CONSTANT_SHARE * F.col("met")) & (F.col("met") >= PRESENT_SHARE * F.col("pages")))
    return fixed.groupBy("host").agg(F.collect_list(F.struct("slot", "h")).alias("constant"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page, its blocks in page order, one to a line.

    Null pages are empty.  Pages without a host are a host of their own.  Repeated rows stay; an
    empty table gives no rows; other columns are ignored.  A host with fewer than MIN_PAGES
    pages has no template, and only what HTML and names declare is left out.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # the reference is a page with content, and copies of a page count once
    full = base.where(F.length(F.trim("html")) > 0)
    references = full.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("ref_html"), F.count("*").alias("pages"))
    references = materialise(references, "references")
    copies = full.select("host", F.xxhash64("html").alias("h"), "page_id").groupBy("host", "h").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where("n > 1")
    spare = materialise(copies.select("host", "h", F.col("page_id").alias("first")), "copies")
    seen = full.withColumn("h", F.xxhash64("html")).join(spare, ["host", "h"], "left").where("first is null or first = page_id or page_id is null")
    # hosts of many pages, at most one for each HOST_PAGES rows, are dealt in parts
    big = references.where(F.col("pages") > HOST_PAGES).select("host", F.ceil(F.col("pages") / HOST_PAGES).cast("int").alias("parts"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(big), "host", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("page_id", "html"), "parts").cast("int")).otherwise(0)).drop("parts")

    def replicated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / HOST_PAGES).cast("int") - 1))).drop("pages")

    constant = materialise(templates(dealt(seen.select("host", "html", "page_id")), replicated(references)), "templates")

    def texts(frames):
        ref = _Reference()
        for f in frames:
            out = []
            for page, raw, fixed in zip(f["html"], f["ref_html"], f["constant"], strict=True):
                root = parse(page)
                if fixed is None or not len(fixed):
                    lines = [t for part in _main(root) for _, t in blocks(part)]
                else:
                    gone = {(r["slot"], r["h"]) for r in fixed}
                    lines = [t for s, t in ref.blocks(root, raw) if s < 0 or (s, _hash(t)) not in gone]
                out.append("\n".join(lines))
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": out, "n_chars": [len(t) for t in out]})

    kind = dict(base.dtypes)["page_id"]
    # the reference page is needed only where a host has a template
    needed = replicated(constant.join(references, "host"))
    return dealt(base).join(needed, ["host", "part"], "left").select("page_id", "url", "html", "ref_html", "constant").mapInPandas(texts, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
