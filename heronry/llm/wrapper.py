"""Main text of web pages by wrapper induction over the pages of a host.

A page's DOM is reduced to a skeleton: its block elements, runs of siblings of one shape folded into one node. The
skeletons of a host are aligned by simple tree matching and merged into a template, whose slots remember whether
the text seen there was the same on every page. A slot whose text never changed over pages that are no near copies
of each other is template and is dropped; varying slots are content, unless their role is not (menus, headers,
footers, sidebars, notices, adverts, forms, comments). Near copies are told by three min-hashes of a page's
shingles of eight words: a slot is constant only where each of the three took two values or more.

Where pages declare an article or main element, it bounds the content; the template still decides what of it stays.
On other pages the template's content region does: the descent from the root goes into the node that holds most of
the varying text as long as no sibling holds prose (varying text in paragraphs, headings, tables and the like,
or a tenth of all varying text outside links).

Slots of equal skeletons are merged by operations whose order doesn't matter, and different skeletons of a host in
the order of their hashes: templates do not depend on how pages are dealt over tasks. A host may hold any share of
the pages: merging goes by (host, skeleton, salt), (host, skeleton), (host, one of 64 buckets) and host. Pages meet
templates by a join on host.

Blocks are block-level elements; character references are decoded, white space is one space, blocks are joined by
line ends in page order. Broken markup is read as browsers do: unclosed elements end with their parent, a block
ends a paragraph, a cut-off tag is dropped.

Defined cases: null and empty html give an empty text; pages without markup are their text; a null or strange url is
a host of its own text; hosts whose pages are all copies or near copies have no constants; repeated rows give equal
rows; a host of one page gives that page's region;
pages of any length and any number of siblings are read whole, elements nested over 60 deep belong to their
60th ancestor; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, tidy
from .decontaminate import grams
from .words import mix, word_hashes

#: Element names (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input map menu nav noscript noembed noframes object script select style template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Whole words of class and id that tell what is not main text; parts of other words ("share-price") don't count.
NAMES = re.compile(
    r"(?:(?:site|page|global|top|main|left|right|bottom|post|article|user|reader|google)[-_]?)?"
    r"(?:ads?|adverts?|advertisements?|adsense|advertising|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|overlay|pager|pagination|paywall|popup|promo|promoted|replies|sharing|share|sidebar|side-bar|signup|skip-link|social|sponsors?|sponsored|subscribe|subscription|toolbar|topbar|"
    r"site-?header|page-?header|related-?(?:posts|articles|links|stories)|recommended-?(?:posts|articles|links|stories))"
    r"(?:[-_]?(?:area|banner|bar|block|box|buttons?|container|form|inner|items?|left|links?|list|menu|notice|outer|right|section|slot|thread|top|unit|widget|wrap|wrapper|\d+))*",
    re.I,
)
REGIONS = frozenset(("article", "main"))
#: Elements whose text is prose.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: An open element that a new one ends, up to an element that keeps it open.
ENDS = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",)),
}
#: A quote that never closes stands for itself, so its tag ends at the next bracket.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|\"(?![^\"]*\")|'(?![^']*'))*)(>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


#: Levels of a skeleton.
DEEPEST = 60
#: Parts that a host's skeletons are merged in.
SALTS = 64


class Node:
    __slots__ = ("tag", "name", "kids", "skip")

    def __init__(self, tag: str, name: str = "", skip: bool = False):
        self.tag, self.name, self.kids, self.skip = tag, name, [], skip


def _element(tag: str, attrs: str) -> Node:
    if not attrs or attrs.isspace():
        return Node(tag, "", tag in BOILERPLATE)
    found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
    words = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    skip = tag in BOILERPLATE or role in ROLES or hidden or (tag not in ("html", "body", "article", "main") and any(map(NAMES.fullmatch, words)))
    # names made by machines differ on every page
    return Node("main" if role == "main" else tag, " ".join(sorted({w for w in words if not re.search(r"\d", w)})), skip)


def parse(text: str) -> Node:
    """The DOM of a page."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (stack[k].tag == "main" and tag == "div"):
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not end blocks
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and stack[k].tag != "p":
                    break
        if tag in ENDS:
            ended, keep = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in keep:
                    break
                if stack[k].tag in ended.split():
                    del stack[k:]
        node = _element(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            node.kids.append(text[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


class Skeleton:
    """A block element with its blocks of text, and how many of their characters are in links."""

    __slots__ = ("key", "kids", "blocks", "linked", "skip", "slot")

    def __init__(self, key: str, skip: bool):
        self.key, self.skip, self.kids, self.blocks, self.linked, self.slot = key, skip, [], [], 0, 0


def skeleton(node: Node, order: list) -> Skeleton:
    """Skeleton of a DOM; ``order`` gets (skeleton node, text) for every block in page order."""
    top = Skeleton("#root", False)
    run: list[str] = []
    linked = 0

    def flush(s):
        nonlocal linked
        t = squeeze("".join(run))
        run.clear()
        if t:
            s.blocks.append(t)
            s.linked += min(linked, len(t))
            order.append((s, t))
        linked = 0

    stack = [(top, iter(node.kids), None, False, False)]
    while stack:
        s, kids, inline, inside, link = stack[-1]
        # an inline element's text belongs to the block around it
        for k in kids:
            if isinstance(k, str):
                run.append(k)
                linked += len(k) if link else 0
                continue
            skip = k.skip or (k.tag == "header" and not inside)  # an article's own header holds its title
            if skip and (k.tag not in BLOCK or len(stack) > DEEPEST):
                continue
            elif k.tag in BLOCK:
                flush(s)
                child = s
                if len(stack) <= DEEPEST:
                    child = Skeleton(f"{k.tag} {k.name}".strip(), skip)
                    s.kids.append(child)
                stack.append((child, iter(k.kids), None, inside or k.tag in REGIONS, link))
                break
            elif k.tag in ("br", "wbr"):
                run.append(" " if k.tag == "br" else "")
            else:
                stack.append((s, iter(k.kids), k, inside, link or k.tag == "a"))
                break
        else:
            stack.pop()
            if inline is None:
                flush(s)
    return top


class Shapes:
    """Numbers for tree shapes (key, skip, numbers of the kids' shapes), and their common nodes by tree matching."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.shape: list[tuple] = []
        self.common: dict[tuple[int, int], int] = {}

    def of(self, key: str, skip: bool, kids: tuple) -> int:
        x = (key, skip, kids)
        if x not in self.number:
            self.number[x] = len(self.shape)
            self.shape.append(x)
        return self.number[x]

    def weight(self, a: int, b: int) -> int:
        """Nodes that two trees have in common by simple tree matching; 0 where their roots differ."""
        if (a, b) not in self.common:
            (ka, _, xa), (kb, _, xb) = self.shape[a], self.shape[b]
            self.common[a, b] = 0 if ka != kb else 1 + (int(self.rows(xa, xb)[-1]) if xa and xb else 0)
        return self.common[a, b]

    def rows(self, a, b) -> np.ndarray:
        """The last row of the matching of two lists of trees: nodes in common of all of a and the first j of b."""
        ub, at = np.unique(np.array(b, np.int64), return_inverse=True)
        row = np.zeros(len(b) + 1, np.int64)
        gain: dict[int, np.ndarray] = {}
        for x in a:
            if x not in gain:
                gain[x] = np.array([self.weight(x, y) for y in ub.tolist()], np.int64)[at]
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain[x]))
        return row

    def match(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Simple tree matching of two lists of trees: pairs of places, in order, of the largest matching.

        Divide and conquer: memory grows with one list only."""
        out, todo = [], [(0, len(a), 0, len(b))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
                out.append((i0, j0))
                i0, j0 = i0 + 1, j0 + 1
            while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
                i1, j1 = i1 - 1, j1 - 1
                out.append((i1, j1))
            if i0 == i1 or j0 == j1:
                continue
            if i1 - i0 == 1:
                gain = [self.weight(a[i0], y) for y in b[j0:j1]]
                best = max(gain)
                if best:
                    out.append((i0, j0 + gain.index(best)))
                continue
            mid = (i0 + i1) // 2
            head, tail = self.rows(a[i0:mid], b[j0:j1]), self.rows(a[mid:i1][::-1], b[j0:j1][::-1])[::-1]
            cut = j0 + int((head + tail).argmax())
            todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
        return sorted(out)


class Slot:
    """A node of a template: the text seen there, and the least and largest of each min-hash of the pages that have it."""

    __slots__ = ("key", "skip", "kids", "chars", "linked", "first", "varies", "low", "high")

    def __init__(self, key, skip, chars=0, linked=0, first=0, varies=False, low=(), high=(), kids=()):
        self.key, self.skip, self.chars, self.linked, self.first, self.varies, self.low, self.high, self.kids = key, bool(skip), chars, linked, first, bool(varies), list(low), list(high), list(kids)

    def dump(self):
        return [self.key, int(self.skip), self.chars, self.linked, self.first, int(self.varies), self.low, self.high, [k.dump() for k in self.kids]]

    @staticmethod
    def load(x):
        return Slot(*x[:8], [Slot.load(k) for k in x[8]])

    @property
    def proved(self) -> bool:
        """Seen on pages that are no near copies of each other."""
        return bool(self.low) and all(a != b for a, b in zip(self.low[:-1], self.high[:-1]))

    @property
    def several(self) -> bool:
        """Seen on two different pages at least."""
        return bool(self.low) and self.low[-1] != self.high[-1]

    def shape(self, shapes: Shapes) -> int:
        return shapes.of(self.key, self.skip, tuple(k.shape(shapes) for k in self.kids))

    def name(self) -> str:
        """A hash of the shape."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            s = stack.pop()
            if s is None:
                out.append(")")
                continue
            out.append(f"({int(s.skip)}{s.key}")
            stack += [None, *s.kids[::-1]]
        return xxhash.xxh3_128_hexdigest("".join(out).encode("utf-8", "replace"))

    def see(self, s: "Slot") -> None:
        self.varies |= s.varies or self.first != s.first
        self.first = min(self.first, s.first)
        self.chars, self.linked = self.chars + s.chars, self.linked + s.linked
        self.low, self.high = [*map(min, self.low, s.low)], [*map(max, self.high, s.high)]


def signature(texts: list[str], n: int = 3, width: int = 8) -> list[int]:
    """Min-hashes of the shingles of a page's longer blocks, or of all its text where it has none, and a hash of all."""
    of, h = word_hashes([t.encode("utf-8", "replace") for t in texts if len(t) > 2 * width])
    g = grams(h, of, width)[1]
    whole = xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "replace"))
    if not len(g):
        g = np.array([whole], np.uint64)
    return [*(int((mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) >> np.uint64(33)).min()) for k in range(n)), whole >> 33]


def fold(s: Skeleton, low: list[int] | None, shapes: Shapes) -> tuple[Slot, int]:
    """(template of one page, its shape); runs of siblings of one shape are one slot. ``slot`` of the skeleton's
    nodes is set to the preorder place of their slot. Without min-hashes the template is a shape only."""

    def build(nodes: list[Skeleton]) -> tuple[Slot, int, list]:
        out, number, places = None, None, []
        for s in nodes:
            slot = Slot(s.key, s.skip)
            if low is not None:
                text = "\n".join(s.blocks)
                slot = Slot(s.key, s.skip, len(text), s.linked, xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1 if text else 0, False, low, low)
            kids = [build([k]) for k in s.kids]
            merged: list[list] = []
            for made in kids:
                if merged and merged[-1][1] == made[1]:
                    if low is not None:
                        overlay(merged[-1][0], made[0])
                    merged[-1][2].append(made[2])
                else:
                    merged.append([made[0], made[1], [made[2]]])
            slot.kids = [m[0] for m in merged]
            number = shapes.of(s.key, s.skip, tuple(m[1] for m in merged))
            out, places = slot, [s, [m[2] for m in merged]]
        return out, number, places

    def number_slots(places: list) -> None:
        at, stack = 0, [[places]]
        while stack:
            group = stack.pop()  # skeleton nodes of one slot
            for node, _ in group:
                node.slot = at
            at += 1
            width = len(group[0][1])
            stack += [[x for _, kids in group for x in kids[i]] for i in range(width)][::-1]

    slot, number, places = build([s])
    number_slots(places)
    return slot, number


def overlay(t: Slot, s: Slot) -> None:
    """Merge a template of the same shape into t; the order of such merges doesn't matter."""
    stack = [(t, s)]
    while stack:
        a, b = stack.pop()
        a.see(b)
        stack += zip(a.kids, b.kids)


def absorb(t: Slot, s: Slot, shapes: Shapes) -> None:
    """Merge template s into t, their kids aligned by simple tree matching."""
    t.see(s)
    kids, i0, j0 = [], 0, 0
    for i, j in shapes.match([k.shape(shapes) for k in t.kids], [k.shape(shapes) for k in s.kids]):
        kids += t.kids[i0:i] + s.kids[j0:j]
        absorb(t.kids[i], s.kids[j], shapes)
        kids.append(t.kids[i])
        i0, j0 = i + 1, j + 1
    t.kids = kids + t.kids[i0:] + s.kids[j0:]


def merge(templates: list[tuple[str, Slot]]) -> Slot:
    """One template of (name of its shape, template): equal shapes first, then the different ones in order of name."""
    by: dict[str, Slot] = {}
    for name, t in templates:
        if name in by:
            overlay(by[name], t)
        else:
            by[name] = t
    shapes = Shapes()
    out = None
    for name in sorted(by):
        if out is None:
            out = by[name]
        else:
            absorb(out, by[name], shapes)
    return out


def page(html: str, shapes: Shapes, learn: bool = True) -> tuple[Skeleton, list, Slot, int]:
    """(skeleton, blocks in order, template of the page, number of its shape)."""
    order: list = []
    s = skeleton(parse(html), order)
    slot, number = fold(s, signature([t for _, t in order]) if learn else None, shapes)
    return s, order, slot, number


def region(t: Slot) -> Slot:
    """The smallest node that holds the varying prose outside boilerplate; all text counts as varying on a single page."""
    whole = {}
    alone = not t.several

    def chars(s: Slot) -> int:
        """Varying characters outside links and boilerplate."""
        if id(s) not in whole:
            own = s.chars - s.linked if s.varies or alone else 0
            whole[id(s)] = 0 if s.skip else own + sum(map(chars, s.kids))
        return whole[id(s)]

    def prose(s: Slot) -> bool:
        return not s.skip and (((s.varies or alone) and s.chars and s.key.split(" ")[0] in PROSE and 2 * s.linked < s.chars) or any(map(prose, s.kids)))

    total, best = chars(t), t
    while total:
        inner = max(best.kids, key=chars, default=None)
        if inner is None or not inner.kids or 2 * chars(inner) < total:
            break
        # what varies beside it is content too, but for a little text in an element without prose and without a name
        if any(prose(k) or 10 * chars(k) >= total or (chars(k) and " " in k.key.strip()) for k in best.kids if k is not inner) or ((best.varies or alone) and 10 * (best.chars - best.linked) >= total):
            break
        best = inner
    return best


def verdicts(slot: Slot, template: Slot, shapes: Shapes) -> list[tuple[bool, bool]]:
    """(constant, inside the region) for each slot of a page's template, in preorder."""
    best = region(template)
    out: list[tuple[bool, bool]] = []

    def walk(s: Slot, t: Slot | None, inside: bool):
        inside = inside or t is best
        out.append((t is not None and not t.varies and t.proved, inside))
        pairs = dict(shapes.match([k.shape(shapes) for k in s.kids], [k.shape(shapes) for k in t.kids])) if t is not None else {}
        for i, k in enumerate(s.kids):
            walk(k, t.kids[pairs[i]] if i in pairs else None, inside)

    walk(slot, template, False)
    return out


def declared(s: Skeleton, order: list, skipped: set[int]) -> set[int]:
    """Nodes inside the articles and main elements of a page, if any of them holds text."""
    held: set[int] = set()
    stack = [(s, False)]
    while stack:
        k, within = stack.pop()
        within = within or k.key.split(" ")[0] in REGIONS and id(k) not in skipped
        if within:
            held.add(id(k))
        stack += [(x, within) for x in k.kids]
    return held if any(id(k) in held and id(k) not in skipped for k, _ in order) else set()


def blocks_at(s: Skeleton, order: list) -> list[tuple[int, int]]:
    """(place, text) of each block in order, as hashes; the place is the names of the elements that hold it."""
    path, stack = {}, [(s, 0)]
    while stack:
        k, above = stack.pop()
        path[id(k)] = own = xxhash.xxh3_64_intdigest(f"{above} {k.key}".encode("utf-8", "replace")) >> 1
        stack += [(x, own) for x in k.kids]
    return [(path[id(k)], xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) >> 1) for k, x in order]


class Extractor:
    """Main text of pages of one host; what the template says of a shape is kept for the next page of that shape."""

    def __init__(self, template: Slot | None = None, constant: frozenset = frozenset()):
        self.template, self.shapes, self.known, self.constant = template, Shapes(), {}, constant

    def __call__(self, html: str) -> str:
        s, order, slot, number = page(html, self.shapes, learn=False)
        skipped: set[int] = set()
        stack = [(s, False)]
        while stack:
            k, skip = stack.pop()
            if skip or k.skip:
                skipped.add(id(k))
            stack += [(x, skip or k.skip) for x in k.kids]
        if number not in self.known:
            if len(self.known) > 256:
                self.shapes, self.known = Shapes(), {}
                number = slot.shape(self.shapes)
            self.known[number] = verdicts(slot, self.template, self.shapes) if self.template is not None else None
        known = self.known[number]
        inside = declared(s, order, skipped)
        kept = []
        fixed = [p in self.constant for p in blocks_at(s, order)] if self.constant else [False] * len(order)
        for (k, x), again in zip(order, fixed):
            if again or id(k) in skipped or (inside and id(k) not in inside):
                continue
            if known is not None and (known[k.slot][0] or not (inside or known[k.slot][1])):
                continue
            kept.append(x)
        return "\n".join(kept)


def extract(html: str, template: Slot | None = None, constant: frozenset = frozenset()) -> str:
    """The main text of a page, with its host's template and constant blocks."""
    return Extractor(template, constant)(html)


def host(url) -> object:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


#: A row holds a template, or a block: its place and text, the pages that have it, and the least and largest of each
#: min-hash of these. Text 0 stands for any text at that place.
MARKS = [f"{end}{k}" for end in ("low", "high") for k in range(4)]
PARTS = pa.schema([("host", pa.string()), ("name", pa.string()), ("salt", pa.int32()), ("template", pa.string()), ("place", pa.int64()), ("text", pa.int64()), ("pages", pa.int64()), *((m, pa.int64()) for m in MARKS)])
#: Slots and blocks that a task holds of templates not yet handed on.
HELD = 200_000
#: A block is constant if this share of the host's pages with its place have it, so many at least.
SHARE, LEAST = 0.9, 3


def _induce(batches):
    held: dict[tuple[str, str], Slot] = {}
    blocks: dict[tuple, list] = {}
    shapes, names, slots = Shapes(), {}, 0
    salt = int(TaskContext.get().partitionId()) % SALTS

    def flush():
        rows = [{"host": h, "name": n, "salt": salt, "template": json.dumps(t.dump())} for (h, n), t in held.items()]
        rows += [{"host": h, "place": p, "text": x, "pages": v[0], **dict(zip(MARKS, v[1] + v[2]))} for (h, p, x), v in blocks.items()]
        return pa.RecordBatch.from_pylist(rows, schema=PARTS)

    for b in batches:
        for h, x in zip(b.column(0).to_pylist(), b.column(1)):
            s, order, t, number = page(x.as_py() or "", shapes)
            if number not in names:
                names[number] = t.name()
            at = (h, names[number])
            if at in held:
                overlay(held[at], t)
            else:
                held[at] = t
                slots += 1 + len(shapes.shape[number][2]) * 4
            found = set(blocks_at(s, order))
            for at in found | {(p, 0) for p, _ in found}:
                v = blocks.setdefault((h, *at), [0, t.low, t.low])
                v[0] += 1
                v[1], v[2] = [*map(min, v[1], t.low)], [*map(max, v[2], t.low)]
            if slots + len(blocks) > HELD or len(shapes.shape) > HELD:
                yield flush()
                held, blocks, shapes, names, slots = {}, {}, Shapes(), {}, 0
    if held:
        yield flush()


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = merge([(n, Slot.load(json.loads(x))) for n, x in zip(pdf.name, pdf.template)])
    out = pdf.iloc[:1].copy()
    out["template"] = json.dumps(whole.dump())
    return out


def induced(pages: DataFrame) -> DataFrame:
    """Templates and blocks of all pages, a few rows a task and host, as a table: the pages are parsed once for both."""
    schema = "host string, name string, salt int, template string, place long, text long, pages long, " + ", ".join(f"{m} long" for m in MARKS)
    return materialize(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(tidy(_induce), schema), "induced")


def templates(parts: DataFrame) -> DataFrame:
    """(host, template): one row a host."""
    seen = parts.where("template is not null").select("host", "name", "salt", "template")
    bucket = F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")
    for keys, salt in ((["host", "name", "salt"], None), (["host", "name"], bucket), (["host", "salt"], None), (["host"], None)):
        seen = seen.groupBy(*keys).applyInPandas(_merge, "host string, name string, salt int, template string")
        if salt is not None:
            seen = seen.withColumn("salt", salt)
    return seen.select("host", "template")


def constant_blocks(parts: DataFrame) -> DataFrame:
    """(host, constant): blocks with one text at one place on nearly all pages of a host that have the place, where these are
    no near copies of each other. So a repeated notice is found in a run of paragraphs that is one slot of the template."""
    marks = [(F.min if m.startswith("low") else F.max)(m).alias(m) for m in MARKS]
    seen = parts.where("place is not null").groupBy("host", "place", "text").agg(F.sum("pages").alias("pages"), *marks)
    often = seen.where((F.col("pages") >= LEAST) & (F.col("text") != 0))
    for k in range(3):  # as Slot.proved
        often = often.where(F.col(f"low{k}") != F.col(f"high{k}"))
    every = seen.where("text = 0").select("host", "place", F.col("pages").alias("all"))
    kept = often.join(every, ["host", "place"]).where(F.col("pages") >= SHARE * F.col("all"))
    # no more of them than a page has blocks, over SHARE
    return kept.groupBy("host").agg(F.collect_list(F.struct("place", "text")).alias("constant"))


def _extract(batches):
    cache: dict[str, Extractor] = {}
    for b in pieces(batches):
        out = []
        for h, t, c, x in zip(b.column("host").to_pylist(), b.column("template"), b.column("constant"), b.column("html")):
            if h not in cache:
                if len(cache) > 200:
                    cache.clear()
                constant = frozenset((r["place"], r["text"]) for r in c.as_py() or ())
                cache[h] = Extractor(Slot.load(json.loads(t.as_py())) if t.is_valid else None, constant)
            out.append(cache[h](x.as_py() or ""))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    parts = induced(pages)
    made = materialize(templates(parts).join(constant_blocks(parts), "host", "left"), "templates")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    return rows.join(made, "host", "left").select("page_id", "url", "html", "host", "template", "constant").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
