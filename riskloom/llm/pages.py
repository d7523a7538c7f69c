"""Main text of web pages by wrapper induction (operator 7).

Pages of one host share a template.  DOM trees of pages of a host, its
references, are aligned by simple tree matching (Yang, 1991): a text that stands
at the same node in enough of them is template, the other slots are content.
A page is aligned with the layouts of its host in turn, and what its nodes hold
of their template goes.  Of the rest, elements that by their name, role or class
hold menus, headers, footers, side bars, notices, adverts, forms or comments are
not main text.  Where a page marks its article, that is the slot taken; within
it only what all articles of the host share, of those that differ, is template.

References are compact (tags and text hashes) and differ from each other: a few
of each layout, layouts of many pages first.  A host's template is a few numbers
for each layout.  While those of all hosts fit a stated bound they go to the
pages, which stay where they lie; beyond it both meet in a join on the host whose
large keys adaptive execution can split.  No task ever holds the pages of a host,
and results are the same.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Kept

#: References of a layout, and of a host.
REFERENCES = 12
MOST = 48
#: Bytes of all hosts' templates, or of the list of references, up to which they are broadcast.
SENT_BYTES = 32 << 20
#: Pages that must agree before text counts as template, and their share.
AGREE = 4
SHARE = 0.5
#: Share of both trees' nodes that match where two pages are laid out alike.
ALIKE = 0.7
#: Share of its texts with which an article counts as a copy of another.
COPY = 0.5
#: Layouts that a worker remembers the template of.
KNOWN = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x85]+")
_WORDS = re.compile(r"[a-z]+")

# Fixed values of HTML: elements by how they are written and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr dd dt li".split())
#: An element of the first kind ends open ones of the second, up to an element of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that never hold main text, and roles and words in class or id that say the same.
ASIDE = frozenset("nav header footer aside form script style noscript template button select input textarea option iframe object embed svg canvas audio video dialog menu head title".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended comment comments disqus respond reply replies toolbar widget pagination pager skip".split()
)
MAIN_WORDS = frozenset("articlebody".split())


class Node:
    __slots__ = ("tag", "children", "aside", "main", "texts", "beside", "marked")

    def __init__(self, tag: str, aside: bool = False, main: bool = False):
        self.tag, self.aside, self.main = tag, aside, main
        #: Beside the main text, and within a marked article, by all elements around it.
        self.beside = self.marked = False
        self.children: list = []  # nodes and strings


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is beside the main text, and whether it marks it."""
    aside, main = tag in ASIDE, tag in ("article", "main")
    if attributes.strip(" /"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                # Only a name of one or two words says what an element is for.
                for part in value.split():
                    words = _WORDS.findall(part)
                    aside |= len(words) <= 3 and any(w in ASIDE_WORDS for w in words)
            elif name == "role":
                aside |= value in ASIDE_ROLES
                main |= value in ("main", "article")
            elif name == "itemprop":
                main |= value in MAIN_WORDS
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                aside = True
    return aside, main


class _Open:
    """The elements that are open, and where the open ones of each tag are, so
    that no end tag has to be looked for among all of them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, []

    def add(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        while len(self.stack) > k:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """Where the innermost open element of these tags is; 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first(self, tags, behind: int) -> int:
        """Where the outermost one behind a place is; 0 without one."""
        found = []
        for t in tags:
            places = self.at.get(t, ())
            k = bisect.bisect_right(places, behind)
            if k < len(places):
                found.append(places[k])
        return min(found, default=0)


def parse(source: str) -> Node:
    """The tree of a page.  Forgiving: every end that is missing is supplied,
    every one too many is passed over.  Its time grows with the page's length."""
    root = Node("#root")
    open_, at, n = _Open(root), 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            open_.stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            open_.stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        block = open_.blocks[-1] if open_.blocks else 0
        if m[1] or m[4]:  # an end; inline ones don't end blocks
            k = open_.last((tag,))
            if k and (tag in BLOCK or k > block):
                open_.cut(k)
            continue
        if tag in CLOSES_P and block and open_.stack[block].tag == "p":
            open_.cut(block)
        if tag in ENDS:
            ended, limit = ENDS[tag]
            border = open_.last(limit)
            k = open_.first(ended, border) if tag in ("tr", "tbody") else open_.last(ended)
            if k > border:
                open_.cut(k)
        attributes = m[3] if m[3] is not None else m[6] or ""
        node = Node(tag, *_marks(tag, attributes))
        open_.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            close = end.start() if end else n
            if tag in ("title", "textarea"):
                node.children.append(source[at:close])
            at = close
            if end:
                at = source.find(">", end.start()) + 1 or n
        elif tag not in VOID and not attributes.endswith("/") or tag in BLOCK and tag not in VOID:
            open_.add(node)
    return root


def blocks(root: Node) -> list[tuple[Node, str]]:
    """(element, text) of every block of text in page order: what stands between
    two block borders, references decoded, white space as one space, trimmed.
    Sets each element's texts (hashes) along the way."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []

    def flush(node: Node):
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip(" ")
        run.clear()
        if text:
            node.texts.append(_hash(text))
            out.append((node, text))

    # Walk without recursion: pages may nest without end.
    root.texts = []
    stack = [(root, root, 0)]
    while stack:
        node, block, i = stack.pop()
        if i == len(node.children):
            if node.tag in BLOCK:
                flush(node)
            continue
        stack.append((node, block, i + 1))
        child = node.children[i]
        if isinstance(child, str):
            run.append(child)
            continue
        child.texts = []
        if child is _BORDER:
            flush(block)
        elif child.tag == "br":
            run.append(" ")
        elif child.tag in VOID and child.tag != "hr" or child.tag in ("script", "style", "template"):
            pass  # shown as nothing, so a run of text goes on behind it
        else:
            if child.tag in BLOCK or child.tag in RAW or child.aside:
                flush(block)
                stack.append((child, child, 0))
                if child.tag not in BLOCK:  # closes like a block, too
                    child.children.append(_BORDER)
            else:
                stack.append((child, block, 0))
    flush(root)
    return out


class _Border(Node):
    """Ends the text run of an element that isn't a block by its name."""


_BORDER = _Border("hr")
_BORDER.texts = []


def skeleton(root: Node) -> list:
    """The whole tree below *root* as [tag, parent's place, text hashes] in page
    order, where neighbouring children with the same tags below are one, with
    the texts of all.  A tag within a marked article has a star.  Without
    recursion: pages may nest without end."""
    shapes: dict = {}
    done: dict[int, list] = {}  # element: [tag, texts, children, shape]
    stack = [(root, False)]
    while stack:
        node, left = stack.pop()
        below = [c for c in node.children if not (isinstance(c, (str, _Border)) or c.tag in VOID)]
        if not left:
            stack.append((node, True))
            stack.extend((c, False) for c in below)
            continue
        children: list = []
        for child in below:
            sub = done.pop(id(child))
            if not sub[1] and not sub[2] and child.tag not in BLOCK:
                continue
            if children and children[-1][3] == sub[3]:
                _absorb(children[-1], sub)
            else:
                children.append(sub)
        tag = node.tag + "*" if node.marked and not node.beside else node.tag
        shape = shapes.setdefault((tag, *(c[3] for c in children)), len(shapes))
        done[id(node)] = [tag, list(getattr(node, "texts", ())), children, shape]
    out: list = []
    flat = [(done[id(root)], -1)]
    while flat:
        (tag, texts, children, _), parent = flat.pop()
        flat.extend((c, len(out)) for c in reversed(children))
        out.append([tag, parent, texts])
    return out


def _absorb(into: list, sub: list) -> None:
    pairs = [(into, sub)]
    while pairs:
        a, b = pairs.pop()
        a[1].extend(b[1])
        pairs.extend(zip(a[2], b[2]))


class Tree:
    """A skeleton with its children, subtree sizes and shapes by node.  Trees to
    be compared number their shapes in one dictionary."""

    def __init__(self, rows: list, shapes: dict):
        self.tags = [r[0] for r in rows]
        self.texts = [r[2] for r in rows]
        self.below: list = [[] for _ in rows]
        for i, r in enumerate(rows[1:], 1):
            self.below[r[1]].append(i)
        self.size, self.shape = [1] * len(rows), [0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            self.size[i] += sum(self.size[c] for c in self.below[i])
            self.shape[i] = shapes.setdefault((self.tags[i], *(self.shape[c] for c in self.below[i])), len(shapes))


class Matching:
    """Simple tree matching: the largest matching of two ordered trees that
    keeps parents and order.  Its size depends on shapes only, so each pair of
    shapes is met once."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.known = a, b, {}
        self.total = self.size(0, 0)

    def size(self, x: int, y: int) -> int:
        a, b, known = self.a, self.b, self.known
        stack = [(x, y)]
        while stack:
            i, j = stack[-1]
            key = (a.shape[i], b.shape[j])
            if key in known:
                stack.pop()
            elif key[0] == key[1] or a.tags[i] != b.tags[j]:
                known[key] = a.size[i] if key[0] == key[1] else 0
            else:
                left, right = self.differing(i, j)[1:]
                firsts, others = {a.shape[c]: c for c in left}, {b.shape[c]: c for c in right}
                missing = [(c, d) for s, c in firsts.items() for t, d in others.items() if (s, t) not in known]
                if missing:
                    stack.extend(missing)
                else:
                    same = sum(a.size[c] for c in a.below[i]) - sum(a.size[c] for c in left)
                    known[key] = 1 + same + int(self.forward(left, right)[-1])
        return known[a.shape[x], b.shape[y]]

    def differing(self, i: int, j: int):
        """The children that both begin and end with, as pairs, and the others
        between.  Equal first children are in some largest matching, as are equal last."""
        left, right = self.a.below[i], self.b.below[j]
        low, n = 0, min(len(left), len(right))
        while low < n and self.a.shape[left[low]] == self.b.shape[right[low]]:
            low += 1
        high = 0
        while high < n - low and self.a.shape[left[-1 - high]] == self.b.shape[right[-1 - high]]:
            high += 1
        pairs = list(zip(left[:low], right[:low])) + list(zip(left[len(left) - high :], right[len(right) - high :]))
        return pairs, left[low : len(left) - high], right[low : len(right) - high]

    def forward(self, left: list, right: list) -> np.ndarray:
        """Sizes of the largest matchings of all of *left* with each beginning of *right*."""
        best, rows = np.zeros(len(right) + 1, np.int64), {}
        for c in left:
            s = self.a.shape[c]
            if s not in rows:
                rows[s] = np.array([self.known[s, self.b.shape[d]] for d in right], np.int64)
            new = best.copy()
            np.maximum(new[1:], best[:-1] + rows[s], out=new[1:])
            best = np.maximum.accumulate(new)
        return best

    def pairs_of(self, left: list, right: list):
        """The pairs of a largest matching of two lists of children, by halves,
        so that memory grows with their length and not its square."""
        stack = [(left, right)]
        while stack:
            left, right = stack.pop()
            if not left or not right:
                continue
            if len(left) == 1:
                sizes = [self.known[self.a.shape[left[0]], self.b.shape[d]] for d in right]
                k = int(np.argmax(sizes))
                if sizes[k]:
                    yield left[0], right[k]
                continue
            half = len(left) // 2
            ahead = self.forward(left[:half], right)
            behind = self.forward(left[:half - 1 : -1], right[::-1])[::-1]
            cut = int(np.argmax(ahead + behind))
            stack += [(left[:half], right[:cut]), (left[half:], right[cut:])]

    def nodes(self):
        """The matched nodes of both trees, as pairs."""
        pairs = [(0, 0)] if self.total else []
        while pairs:
            i, j = pairs.pop()
            yield i, j
            same, left, right = self.differing(i, j)
            if left and right:
                for c in {self.a.shape[c]: c for c in left}.values():
                    for d in {self.b.shape[d]: d for d in right}.values():
                        self.size(c, d)
            pairs += same
            pairs.extend(self.pairs_of(left, right))

    @property
    def likeness(self) -> float:
        """The share of both trees' nodes that match."""
        return 2 * self.total / (len(self.a.tags) + len(self.b.tags))


def mark(root: Node) -> None:
    """Sets for each element whether it is beside the main text, and whether the
    article is marked around it."""
    stack = [root]
    while stack:
        node = stack.pop()
        for child in node.children:
            if not isinstance(child, (str, _Border)):
                # An article's own header is a part of it.
                child.beside = node.beside or child.aside and not (node.marked and child.tag == "header")
                child.marked = node.marked or child.main and not node.beside
                stack.append(child)


def read(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The marked tree of a page and its blocks of text."""
    root = parse(source)
    mark(root)
    return root, blocks(root)


def layout_of(rows: list) -> tuple:
    return tuple((r[0], r[1]) for r in rows)


def induce(references: list[str]) -> list:
    """The template of a host from skeletons of its pages, as JSON: for each of
    their layouts the layout itself and, by node, the hashes of texts that are
    template.  Empty where none is.

    Outside of marked articles, text is template that AGREE pages or more hold
    at one node, and a SHARE of those laid out alike or of all.  Within, it is
    what all pages hold there, AGREE at least, of which no article is a copy of
    another's.  Pages that are equal count once."""
    trees = [json.loads(x) for x in sorted(set(references))]
    if len(trees) < AGREE:
        return []
    layouts: dict[tuple, list[int]] = {}
    for n, rows in enumerate(trees):
        layouts.setdefault(layout_of(rows), []).append(n)
    articles = [{h for r in rows if r[0][-1] == "*" for h in r[2]} for rows in trees]
    differing: list[int] = []
    for n, own in enumerate(articles):
        if own and all(len(own & articles[m]) <= COPY * min(len(own), len(articles[m])) for m in differing):
            differing.append(n)
    shapes: dict = {}
    shaped = {layout: Tree([[*r, ()] for r in layout], shapes) for layout in layouts}
    out = []
    for layout, tree in shaped.items():
        held: dict[tuple[int, int], set[int]] = {}  # pages by node of this layout and text
        alike: set[int] = set()
        for other, members in layouts.items():
            matching = Matching(tree, shaped[other])
            if matching.likeness >= ALIKE:
                alike.update(members)
            for i, j in matching.nodes():
                for n in members:
                    for h in set(trees[n][j][2]):
                        held.setdefault((i, h), set()).add(n)
        texts: dict[int, list[int]] = {}
        for (i, h), pages in held.items():
            if layout[i][0][-1] == "*":
                template = len(differing) >= AGREE and pages.issuperset(differing)
            else:
                template = any(len(pages & group) >= max(AGREE, SHARE * len(group)) for group in (alike, set(range(len(trees)))))
            if template:
                texts.setdefault(i, []).append(h)
        out.append([layout, {i: sorted(t) for i, t in texts.items()}])
    return out if any(texts for _, texts in out) else []


class Template:
    """A host's template, as its pages use it."""

    def __init__(self, induced: str):
        self.shapes: dict = {}
        self.layouts = []
        for rows, texts in json.loads(induced):
            self.layouts.append((tuple(map(tuple, rows)), Tree([[*r, ()] for r in rows], self.shapes), {int(i): frozenset(t) for i, t in texts.items()}))
        #: Whether it says anything of marked articles.
        self.marked = any(layout[i][0][-1] == "*" for layout, _, texts in self.layouts for i in texts)
        self.known: dict[tuple, dict[int, frozenset]] = {}

    def texts(self, layout: tuple) -> dict[int, frozenset]:
        """By node of a page's layout, the hashes that are template: those of
        its own layout, or of all that it is aligned with."""
        got = self.known.get(layout)
        if got is None:
            own = [t for known, _, t in self.layouts if known == layout]
            if own:
                got = own[0]
            else:
                merged: dict[int, set] = {}
                tree = Tree([[*r, ()] for r in layout], self.shapes)
                for _, other, texts in self.layouts:
                    if texts:
                        for i, j in Matching(tree, other).nodes():
                            if j in texts:
                                merged.setdefault(i, set()).update(texts[j])
                got = {i: frozenset(t) for i, t in merged.items()}
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[layout] = got
        return got


def extract(source: str | None, template: Template | None = None) -> str:
    """The main text of a page, given the template of its host."""
    if not source:
        return ""
    root, found = read(source)
    good = [(node.marked, text) for node, text in found if not node.beside]
    marked = any(main for main, _ in good)
    if marked:
        good = [(main, text) for main, text in good if main]
    if not good or template is None or marked and not template.marked:
        return "\n".join(text for _, text in good)
    rows = skeleton(root)
    texts = template.texts(layout_of(rows))
    gone = {h for i, hashes in texts.items() if (rows[i][0][-1] == "*") == marked for h in hashes.intersection(rows[i][2])}
    left = [text for _, text in good if _hash(text) not in gone]
    # An article of nothing but template is the article.
    return "\n".join(left if left or not marked else [text for _, text in good])


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def host_of(url):
    """The host in lower case, without port and user; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_texts(df: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", references: int = REFERENCES, most: int = MOST, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of *df*.

    Null and empty pages, and pages without main text, have the empty text.
    Pages without a host, or of a host with fewer than four pages that differ,
    are extracted without a template.  Repeated rows give repeated results.
    Bytes that are no UTF-8 read as U+FFFD.  An empty table gives an empty
    result; other columns, whatever their names, are neither read nor returned.
    """
    keep = Kept()
    pages = df.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def survey(batches):
        for batch in batches:
            keys = [_keys(_sketched(h)) for h in _strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2))], ["page_id", "host", "layout", "key"])

    def sketch(batches):
        for batch in batches:
            trees = [_sketched(h) for h in _strings(batch.column(2))]
            same = [_keys(t)[1] == k for t, k in zip(trees, batch.column(3).to_pylist())]  # ids may repeat
            out = [json.dumps(t, separators=(",", ":")) if s else None for t, s in zip(trees, same)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], ["host", "skeleton"])

    def induction(batches):
        for batch in batches:
            found = [induce(x) for x in batch.column(1).to_pylist()]
            out = pa.array([json.dumps(x, separators=(",", ":")) if x else None for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["host", "template"])

    # The references of a host: pages that differ, by rank within their layout, the layouts of most pages first.
    usable = pages.filter("host <> '' and html <> '' and page_id is not null").select("page_id", "host", "html")
    differing = usable.mapInArrow(survey, "page_id bigint, host string, layout bigint, key bigint").groupBy("host", "layout", "key").agg(F.min("page_id").alias("page_id"))
    differing = keep(differing, "pages-skeletons")
    held = differing.groupBy("host", "layout").agg(F.count("*").alias("held"))
    # Such a limit by rank is taken in every task first, before a host's rows meet.
    place = F.row_number().over(Window.partitionBy("host", "layout").orderBy("page_id", "key"))
    first = differing.withColumn("place", place).filter(F.col("place") <= references)
    order = Window.partitionBy("host").orderBy(F.desc("held"), "layout", "place")
    first = first.join(held, ["host", "layout"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    chosen = keep(first.select("page_id", "host", "key"), "pages-chosen")
    chosen = _small(chosen, chosen.agg(F.sum(F.octet_length("host") + 32)).first()[0], sent_bytes)
    refs = usable.join(chosen, ["page_id", "host"]).select("page_id", "host", "html", "key").mapInArrow(sketch, "host string, skeleton string").filter("skeleton is not null")
    refs = refs.groupBy("host").agg(F.collect_set("skeleton").alias("refs")).mapInArrow(induction, "host string, template string").filter("template is not null")
    refs = templates = keep(refs.withColumnRenamed("host", "_host"), "pages-templates")
    keep.leave(templates)
    refs = _small(refs, refs.agg(F.sum(F.octet_length("_host") + F.octet_length("template"))).first()[0], sent_bytes)

    def run(batches):
        templates: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for source, induced in zip(_strings(batch.column(2)), batch.column(3).to_pylist()):
                if induced is not None and induced not in templates:
                    if len(templates) >= 256:
                        templates.clear()
                    templates[induced] = Template(induced)
                texts.append(extract(source, templates.get(induced)))
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes)], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(refs, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def _small(df: DataFrame, size: int | None, most: int) -> DataFrame:
    """*df*, to be broadcast if it has *most* bytes at most."""
    return F.broadcast(df) if (size or 0) <= most else df


def _strings(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty, without regard to faulty bytes."""
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _keys(rows: list) -> tuple[int, int]:
    """Hashes of a skeleton's layout and of all of it."""
    return tuple(int.from_bytes(hashlib.blake2b(json.dumps(x).encode(), digest_size=8).digest(), "little", signed=True) for x in ([r[:2] for r in rows], rows))


def _sketched(source: str) -> list:
    return skeleton(read(source)[0])
