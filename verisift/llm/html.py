"""Main text of web pages by tree scoring.

A page is read once, in time linear in its length whatever its markup: a light tree of its containers, and the blocks of
text in them. Parts that are no article by their tag or role (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments of readers), or by a class or id made up of words for such parts, are left out. Such a name is that of
a wrapper, and ignored, where the element holds a main element, the page's only articles or more than half of its
paragraph text; adverts, cookie notices and comments are no wrappers unless they hold a main. A form is such a wrapper too
(whole pages stand in one), whatever else there is. A label is left out but in a paragraph outside forms, and a role does
not make an article or main element a notice.

Every paragraph passes points for its length and commas to its parent, half as many to the next ancestor, and so on. A
container's score are its points, discounted by the share of its text inside links, twice as much for an article or main
element. The best container is kept with all its blocks, or the article or main element around it if that has a fifth
of its score, and its siblings that have a fifth of it or, beside a container of another kind, read like text. Sections
of one article differ in length: siblings of the kept container, or of one around it below the next article, main or body,
that are sections or articles or have a class, and are of its tag and class, are kept if they read like text.

A null or empty page, or one without text, gives an empty text; if nothing has a score, all text that is not left out is
kept. Broken markup is read as browsers do where it matters: paragraphs end where the next block begins, list items and
cells where the next one does, unclosed elements end with their parent, links with their parent at the latest (and an
anchor without href is none), an unclosed script, style, text area or frame holds the rest, a cut-off tag at the end is
dropped. An unclosed quotation mark ends at the next ">".
Of equal scores the outermost, first container counts. Pages that repeat are judged alike, an empty table stays empty, and
only the columns that are asked for are read, so others cannot clash.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# ---- fixed values: HTML's element kinds and usual names of page parts --------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "nav footer aside script style noscript template button select textarea input iframe noframes svg math object embed applet dialog menu "
    "head title canvas audio video map search datalist fieldset label optgroup option legend".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist note status".split())
ARTICLE_ROLES = frozenset("navigation complementary contentinfo dialog alertdialog".split())  # of roles, those that an article may have and be left out
HOLDS_REST = frozenset("script style textarea xmp iframe noframes".split())
IN_HEAD = frozenset("title meta link script style base noscript template head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LIKE_P = HEADINGS | frozenset("p pre blockquote td li dd".split())
# one of these in a class or id names an advert, a notice or comments; a name is cut at anything but letters and digits, and
# where a capital follows a small letter
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adunit sponsor sponsors sponsored promo promos promoted "
    "comment comments commentlist commentform disqus cookie cookies consent gdpr popup newsletter outbrain taboola".split()
)
# parts of a page, where nothing but these and the words below them make up a name
PARTS = frozenset(
    "banner banners promotion promotions nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars sidenav "
    "aside rail footer foot masthead topbar toolbar header respond discussion reply replies notice notices notification notifications alert alerts modal "
    "overlay lightbox subscribe subscription signup signin login register share sharing social related recommended recommendations widget widgets toc "
    "search searchbox form skip skiplink paywall hidden".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global mobile desktop sticky fixed outer inner wrap wrapper container box bar area section block "
    "panel column col row list item items link links button buttons icon icons text title content body group unit slot posts stories articles region the "
    "small large first last to".split()
)
# --------------------------------------------------------------------------------------------------

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# kind of element that a next one of its kind ends, and what such an end does not reach beyond
_ENDS = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_BOUNDS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dir": ("li",), "dl": ("dd",), "table": ("tr", "td"), "tr": ("td",), "select": ("option",)}


class _Node:
    __slots__ = ("tag", "kind", "parent", "block", "at", "near", "inside", "dropped", "named", "article", "points", "chars", "linked", "size", "holds", "under")

    def __init__(self, tag: str, parent: _Node | None, at: int, dropped: bool, named: int, is_block: bool = True, kind: str = ""):
        self.tag, self.kind, self.parent, self.at, self.dropped, self.named = tag, kind, parent, at, dropped, named
        self.block = self if is_block else parent.block  # the block it stands in
        self.near = parent.near if parent else {}  # the places on the stack of open elements that a next one ends
        self.inside: dict[str, int] = {}  # open inline elements of a block
        self.article = tag in ("article", "main") or parent is not None and parent.article  # it is one or is in one
        self.points = 0.0
        self.chars = self.linked = self.size = self.holds = 0
        self.under = parent is not None and (parent.under or parent.named > 0 and parent.tag != "form")


def _named(value: str) -> int:
    """2: an advert, a notice, comments; 1: another part of a page; 0: neither."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if not NEVER.isdisjoint(words):
            return 2
        if not PARTS.isdisjoint(words) and all(w in PARTS or w in NEUTRAL for w in words):
            found = 1
    return found


def _left_out(tag: str, attrs: str) -> tuple[bool, int, str]:
    """Whether an element is left out whatever it holds, `named` of its node, and its class."""
    if tag in DROPPED:
        return True, 0, ""
    named, of = int(tag == "form"), ""
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            of = of or value if name == "class" else of
            # the page's own frame is never left out by its name
            if tag not in ("html", "body", "article", "main") or _named(value) == 2 and tag == "article":
                named = max(named, _named(value))
        elif name == "role":
            role = value.strip().lower()
            if role == "form":
                named = max(named, 1)
            elif role in (ARTICLE_ROLES if tag in ("article", "main") else ROLES) and tag not in ("html", "body"):
                return True, named, of
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value.lower()):
            return True, named, of
    return False, named, of


def _title(tag: str, parent: _Node) -> bool:
    """A heading in the header of an article: of headers it alone is kept."""
    return tag in HEADINGS and parent.tag == "header" and parent.article and parent.named != 2


class _Reader:
    """One pass over a page: `nodes`, parents first, and `blocks`: (node, pieces of text: (node, text, whether linked))."""

    def __init__(self, page: str):
        self.page = page
        root = _Node("#", None, 0, False, 0)
        self.nodes, self.stack, self.open = [root], [root], {}
        self.blocks: list[tuple[_Node, list]] = []
        self.pieces: list[tuple[_Node, str, bool]] = []
        self.link = 0  # how many elements were open when the open link began
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.endless: set[str] = set()  # raw elements that nothing closes from here on

    def flush(self) -> None:
        if self.pieces:
            self.blocks.append((self.stack[-1].block, self.pieces))
            self.pieces = []

    def push(self, tag: str, dropped: bool, named: int, is_block: bool, of: str = "") -> None:
        top, at = self.stack[-1], len(self.stack)
        node = _Node(tag, top, at, dropped, named, is_block, f"{tag} {of}" if of or tag in ("section", "article") else "")
        if tag in _ENDS or tag in _BOUNDS:
            node.near = node.near | {kind: None for kind in _BOUNDS.get(tag, ())}
            if tag in _ENDS:
                node.near[_ENDS[tag]] = at
        if not is_block:
            node.block.inside[tag] = node.block.inside.get(tag, 0) + 1
        self.open[tag] = self.open.get(tag, 0) + 1
        self.nodes.append(node)
        self.stack.append(node)

    def close(self, at: int) -> None:
        """End the open elements from this place on the stack on."""
        if self.stack[at].block is self.stack[at]:
            self.flush()
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
            if node.block is not node:
                node.block.inside[node.tag] -= 1
        del self.stack[at:]
        if self.link > at:
            self.link = 0

    def tag_end(self, at: int) -> int:
        """Behind the ">" that ends a tag; -1 if none does."""
        while at <= self.last[">"]:
            m = _STOP.search(self.page, at)
            if not m:
                return -1
            if not m[1]:
                return m.end()
            if m.end() > self.last[m[1]]:  # the quotation does not end
                return self.page.find(">", m.end()) + 1 or -1
            at = self.page.find(m[1], m.end()) + 1
        return -1

    def read(self) -> None:
        page, at = self.page, 0
        while True:
            m = _OPEN.search(page, at)
            begin = m.start() if m else len(page)
            if begin > at:
                top = self.stack[-1]
                if not top.dropped:
                    self.pieces.append((top, page[at:begin], self.link > 0))
            if not m:
                break
            if m[1]:
                ends = [e + n for e, n in ((page.find("-->", m.end() - 2), 3), (page.find("--!>", m.end() - 2), 4)) if e >= 0] if "--" not in self.endless else []
                if not ends:
                    break
                at = min(ends)
                continue
            end = self.tag_end(m.end())
            if end < 0:
                break
            at = end
            if m[3]:
                at = self.tag(m[3].lower(), bool(m[2]), page[m.end() : end - 1], end)
        self.flush()

    def tag(self, tag: str, is_end: bool, attrs: str, at: int) -> int:
        """Act on a tag; where to read on."""
        is_block = tag in BLOCK
        if is_end:
            if tag == "a":
                self.link = 0
            if is_block:
                if self.open.get(tag):
                    place = next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag)
                    self.close(place)
                else:
                    self.flush()
            elif self.stack[-1].block.inside.get(tag):
                self.close(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))
            return at
        if tag == "br":
            self.pieces.append((self.stack[-1], " ", False))
            return at
        block = self.stack[-1].block
        if block.tag == "head" and tag not in IN_HEAD:
            self.close(block.at)
        if tag in RAW:
            if attrs.endswith("/") and tag in ("svg", "math"):
                return at
            end = None if tag in self.endless else re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(self.page, at)
            if end:
                return end.end()
            self.endless.add(tag)
            return len(self.page) if tag in HOLDS_REST else at
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return at
        if tag in ("html", "body") and self.open.get(tag):
            return at
        hard, named, of = _left_out(tag, attrs)
        if tag == "label" and self.stack[-1].block.tag in LIKE_P and not self.open.get("form") and not re.search(r"(?:^|\s)for\s*=", attrs, re.I):
            hard = False  # words of a sentence
        if is_block:
            self.flush()
            block = self.stack[-1].block
            if block.tag == "p" or block.tag in HEADINGS and tag in HEADINGS:
                self.close(block.at)  # a block ends an open paragraph
            place = self.stack[-1].near.get(_ENDS[tag]) if tag in _ENDS else None
            if place is not None:
                self.close(place)
        top = self.stack[-1]
        if _title(tag, top):
            hard = hard or top.parent.dropped
        elif top.dropped:
            hard = True
        elif tag == "header":
            hard = True
        if is_block or hard or named or top.block is not top:
            self.push(tag, hard, named, is_block, of)
        if tag == "a":
            self.link = len(self.stack) if re.search(r"(?:^|\s)href\s*=", attrs, re.I) else 0
        return at


def _up(nodes: list[_Node], add) -> None:
    """Children to parents, the last first."""
    for n in reversed(nodes):
        if n.parent is not None:
            add(n.parent, n)


def _without_parts(nodes: list[_Node], blocks: list) -> None:
    """Mark the elements as dropped that are left out by their names."""
    if not any(n.named for n in nodes):
        return
    for node, pieces in blocks:
        size = sum(len(text) for _, text, linked in pieces if not linked)
        if size >= 25 and node.tag not in HEADINGS:
            node.size += size

    def add(up: _Node, n: _Node) -> None:
        up.size += n.size
        # 1: holds an article with text, 2: a main
        up.holds |= n.holds | (0 if not n.size else 2 if n.tag == "main" else 1 if n.tag == "article" and n.named != 2 else 0)

    _up(nodes, add)
    everything = nodes[0].size
    outside = any(n.tag in ("article", "main") and n.size and not n.under and not n.named for n in nodes)
    for n in nodes:
        wrapper = n.holds & 2 or n.named == 1 and (n.tag == "form" or not outside) and (n.holds & 1 or 2 * n.size > everything)
        if n.parent is not None and ((n.parent.parent if _title(n.tag, n.parent) else n.parent).dropped or n.named and not wrapper):
            n.dropped = True


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by two line feeds."""
    if not page:
        return ""
    reader = _Reader(page)
    reader.read()
    nodes = reader.nodes
    _without_parts(nodes, reader.blocks)
    blocks = []
    for node, pieces in reader.blocks:
        text = _SPACE.sub(" ", _html.unescape("".join(text for n, text, _ in pieces if not n.dropped))).strip(" ")
        if text:
            linked = min(len(text), sum(len(x.strip()) for n, x, is_linked in pieces if is_linked and not n.dropped))
            blocks.append((node, text))
            node.chars += len(text)
            node.linked += linked
            if len(text) >= 25 or node.tag in HEADINGS:
                commas = sum(map(text.count, ",，、،"))
                (node.parent if node.tag in LIKE_P and node.parent else node).points += (1 + commas + min(len(text) / 100, 3)) * (1 - linked / len(text))
    if not blocks:
        return ""

    def add(up: _Node, n: _Node) -> None:
        up.chars += n.chars
        up.linked += n.linked
        up.points += n.points / 2

    _up(nodes, add)
    score = lambda n: n.points * (1 - n.linked / n.chars) * (2 if n.tag in ("article", "main") else 1) if n.chars and not n.dropped else 0.0
    best = max(nodes, key=score)
    if score(best) <= 0:
        return "\n\n".join(text for _, text in blocks)
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None and 5 * score(around) >= score(best):
        best = around
    kept = {id(best)}
    reads = lambda n: n.linked < 0.25 * n.chars
    floor, plain = max(10.0, 0.2 * score(best)), best.tag not in ("article", "main")
    # what stands around the best container, and the kinds of those sections on the way up that may go on beside
    levels, at = {}, best
    while at.parent is not None and (at is best or at.tag not in ("main", "body")):
        levels[id(at.parent)] = at
        if at.tag in ("main", "body") or at is not best and at.tag == "article":
            break
        at = at.parent
    for n in nodes:
        beside = levels.get(id(n.parent))
        if beside is None or n is beside or not n.chars or n.dropped:
            continue
        if beside is best and (score(n) >= floor or plain and n.tag in ("p", "pre", "blockquote") and reads(n) and n.chars > 80):
            kept.add(id(n))
        elif n.kind and n.kind == beside.kind and n.tag not in ("main", "body") and n.points > 0 and reads(n):
            kept.add(id(n))
    for n in nodes:  # parents come first
        if n.parent is not None and id(n.parent) in kept:
            kept.add(id(n))
    return "\n\n".join(text for node, text in blocks if id(node) in kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, `text` and `n_chars` (its code points)."""
    names = [f"c{i}" for i in range(len(keep))]
    df = pages.select(F.col(f"`{html}`").cast("string").alias("h"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [main_text(h) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "t", "n"])

    kinds = dict(df.dtypes)
    out = df.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "t string, n long"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("t").alias("text"), F.col("n").alias("n_chars"))
