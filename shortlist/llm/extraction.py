"""Main text of web pages by tree scoring.

The page becomes a tree. Parts that are never article text (menus, footers, forms, adverts,
comments, scripts) are left out while it is built, by element, role and words in class and
id. Every paragraph then passes points for its length and commas to its ancestors, less to
farther ones, discounted by the share of its text inside links; a container's points are
discounted by its own link density. The best container is kept with those of its siblings
that score well or read like paragraphs of the same article.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import over_batches, texts_of

#: points of a paragraph: one, one per comma, one per this many characters up to the limit
CHARS_PER_POINT, MOST_LENGTH_POINTS = 100, 3.0
#: a sibling container is kept if it has this share of the best one's points
SIBLING_SHARE = 0.2
#: a sibling paragraph is kept from this length, or shorter if it is a sentence without links
LONG_PARAGRAPH, LINK_DENSITY = 80, 0.25

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen frame".split()
)
#: elements whose content is not markup and not article text
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: elements with markup inside that are left out up to their end tag or that of an element
#: around them; without any later end tag they are empty
SKIPPED = frozenset(
    "noscript template svg math select button object canvas audio video datalist".split()
)
#: block ancestors that a paragraph passes points to
LEVELS = 5
LEFT_OUT = frozenset("nav footer aside form menu dialog search head fieldset".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu "
    "menubar toolbar status tooltip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words in class or id that mark other parts of a page
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor "
    "sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot footnav masthead topbar toolbar cookie cookies consent "
    "gdpr notice notices alert popup popover modal overlay lightbox comment comments commentlist "
    "disqus reply replies respond share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login paywall pagination pager widget widgets "
    "skip hidden noprint".split()
)
#: words that mark an article, whatever else is said
KEEPS = frozenset("article articlebody story storybody maincontent postcontent entrycontent".split())
#: which open elements a start tag closes, and which element ends that search
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: points a container begins with
BEGIN = {
    **dict.fromkeys(["article", "main"], 10.0),
    **dict.fromkeys(["div", "section"], 5.0),
    **dict.fromkeys(["pre", "td", "blockquote"], 3.0),
    **dict.fromkeys(["address", "ol", "ul", "dl", "dd", "dt", "li", "table"], -3.0),
    **dict.fromkeys([*HEADINGS, "th"], -5.0),
}

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
    r"""(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?P<end>>|\Z)"""
    r"""|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?P<end2>>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element: its place in the tree, its text, and what is known of its text."""

    __slots__ = (
        "tag", "parent", "kids", "left_out", "chars", "linked", "score", "leaf", "order",
        "block", "in_link", "in_article", "foreign",
    )

    def __init__(self, tag: str, parent: Node | None, order: int, left_out: bool) -> None:
        self.tag, self.parent, self.order, self.left_out = tag, parent, order, left_out
        # the nearest block, itself included, and what it is inside of
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.foreign = tag in ("svg", "math") or (parent is not None and parent.foreign)
        self.kids: list[Node | str] = []
        self.chars = self.linked = 0
        self.score: float | None = None
        self.leaf = True  # no block inside


def _left_out(tag: str, attributes: str, parent: Node) -> bool:
    if tag in LEFT_OUT or tag in SKIPPED:
        return True
    if tag == "header" and not parent.in_article:
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if _HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if tag in ("article", "main"):
        names = found.get("class", "")
        return not {w.lower() for w in _WORD.findall(names)}.isdisjoint(("comment", "comments"))
    named = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(named)}
    return not words.isdisjoint(MARKS) and words.isdisjoint(KEEPS)


class _Open:
    """The element that is open, and how many of each tag are around it."""

    def __init__(self, root: Node) -> None:
        self.node = root
        self.tags: dict[str, int] = {}

    def enter(self, child: Node) -> None:
        self.node = child
        self.tags[child.tag] = self.tags.get(child.tag, 0) + 1

    def leave(self, upto: Node) -> None:
        """Close elements up to and with ``upto``."""
        while True:
            here = self.node
            self.tags[here.tag] -= 1
            self.node = here.parent
            if here is upto:
                return

    def end_tag(self, tag: str) -> None:
        if not self.tags.get(tag):
            return
        above = self.node
        while above.tag != tag:
            if tag not in BLOCKS and above.tag in BLOCKS:
                return  # an inline end tag does not close the block it is in
            above = above.parent
        self.leave(above)

    def make_room(self, tag: str) -> None:
        """Close what a block's start tag ends: an open paragraph, or the item before it."""
        closes, stops = CLOSES.get(tag, (None, None))
        if closes is None:
            above = self.node.block
            if above.tag == "p" or (above.tag in HEADINGS and tag in HEADINGS):
                if above.parent is not None:
                    self.leave(above)
            return
        if not any(self.tags.get(t) for t in closes):
            return
        found, above = None, self.node
        while above.parent is not None and above.tag not in stops:
            if above.tag in closes:
                found = above
            above = above.parent
        if found is not None:
            self.leave(found)


def parse(html: str) -> list[Node]:
    """The elements of a page in page order; the first is the root. Broken markup is mended."""
    root = Node("html", None, 0, False)
    nodes, now, at = [root], _Open(root), 0
    lowered: str | None = None
    last_end: dict[str, int] = {}
    while True:
        match = _MARKUP.search(html, at)
        text = html[at : match.start() if match else len(html)]
        if text and not now.node.left_out:
            now.node.kids.append(text)
        if match is None:
            return nodes
        at = match.end()
        name = match["name"] or match["name2"]
        if not name or not (match["end"] or match["end2"]):
            continue  # a comment, a declaration, or a tag that the page breaks off in
        tag = name.lower()
        if match["close"] or match["close2"]:
            now.end_tag(tag)
            continue
        if tag in ("html", "body"):
            continue  # everything is inside one root
        rest = match["rest"] or match["rest2"] or ""
        if tag in RAW or tag in SKIPPED:
            if lowered is None:
                lowered = html.lower()
                if len(lowered) != len(html):  # lower case may change lengths
                    lowered = "".join(c.lower() if c < "\x80" else c for c in html)
            if tag in RAW and not now.node.foreign:
                ending = lowered.find(f"</{tag}", at)
                close = html.find(">", ending) if ending >= 0 else -1
                at = close + 1 if close >= 0 else len(html)
                continue
            if tag not in last_end:
                last_end[tag] = lowered.rfind(f"</{tag}")
            if last_end[tag] < at:
                continue  # never closed: nothing is inside
        if tag in BLOCKS:
            now.make_room(tag)
        node = now.node
        child = Node(tag, node, len(nodes), node.left_out or _left_out(tag, rest, node))
        nodes.append(child)
        if not child.left_out:
            node.kids.append(child)
            if tag in BLOCKS:
                outer: Node | None = node
                while outer is not None and outer.leaf:
                    outer.leaf, outer = False, outer.parent
        if tag not in VOID and not (child.foreign and rest.endswith("/")):
            now.enter(child)


def score(nodes: list[Node]) -> None:
    """Give containers the points of the paragraphs inside.

    A paragraph passes its points to the nearest ``LEVELS`` blocks around it: all of them to
    the first, half to the second and 1/3 of 1/level to farther ones.
    """
    own: dict[int, list] = {}  # of a block: its node, text length, commas, linked text
    for node in nodes:
        if node.left_out:
            continue
        texts = [k for k in node.kids if isinstance(k, str)]
        text = " ".join("".join(texts).split()) if texts else ""
        if not text:
            continue
        linked = len(text) if node.in_link else 0
        found = own.setdefault(node.block.order, [node.block, 0, 0, 0])
        found[1] += len(text)
        found[2] += sum(text.count(c) for c in ",，、،")
        found[3] += linked
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes):  # an element comes after the one it is in
        if node.parent is not None and not node.left_out:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for block, chars, commas, linked in own.values():
        points = 1 + commas + min(chars / CHARS_PER_POINT, MOST_LENGTH_POINTS)
        points *= 1 - linked / chars
        container = block
        if block.leaf and block.parent is not None:
            container = block.parent.block
        for level in range(LEVELS):
            if container.tag in BLOCKS:
                if container.score is None:
                    container.score = BEGIN.get(container.tag, 0.0)
                container.score += points / (1, 2, 3 * level)[min(level, 2)]
            if container.parent is None:
                break
            container = container.parent.block


def _points(node: Node) -> float:
    if node.score is None or not node.chars:
        return 0.0
    return node.score * (1 - node.linked / node.chars)


def kept_parts(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    scored = [n for n in nodes if n.score is not None and not n.left_out]
    if not scored:
        return []
    best = max(scored, key=lambda n: (_points(n), -n.order))
    if best.parent is None:
        return [best]
    least = SIBLING_SHARE * _points(best)
    kept = []
    for kid in best.parent.kids:
        if not isinstance(kid, Node) or kid.left_out:
            continue
        density = kid.linked / kid.chars if kid.chars else 1.0
        paragraph = kid.tag == "p" and (
            (kid.chars >= LONG_PARAGRAPH and density < LINK_DENSITY)
            or (density == 0 and _sentence(kid))
        )
        heading = kid.tag in HEADINGS and density == 0
        if kid is best or _points(kid) >= least or paragraph or heading:
            kept.append(kid)
    return kept


def _sentence(node: Node) -> bool:
    blocks = blocks_of([node])
    return bool(blocks) and blocks[-1].endswith((".", "!", "?", "。", "！", "？", "…"))


def blocks_of(parts: list[Node]) -> list[str]:
    """The text of each block, white space made one space, without empty ones."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    todo: list[Node | str | None] = []
    for part in reversed(parts):
        todo += [None, part, None]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag in ("br", "hr"):
            held.append(" ")
        else:
            if item.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(item.kids)
    flush()
    return blocks


def main_text(html: str) -> str:
    """The article of a page, one line per block; empty if there is none."""
    nodes = parse(html)
    score(nodes)
    return "\n".join(blocks_of(kept_parts(nodes)))


def extract(df: DataFrame, html: str, text: str = "text") -> DataFrame:
    """Add column ``text`` with the main text of the pages in column ``html``.

    Null, empty and text-free pages give an empty text. Whole pages are read, however long;
    repeated rows are extracted alike. Other columns but ``html`` stay, and one named like
    ``text`` is replaced. Nothing is shuffled.
    """
    rest = df.select(*[c for c in df.columns if c not in (text, html)], html)
    fields = [f for f in rest.schema.fields if f.name != html]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields],
                        f"`{text}` string"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in texts_of(batch.column(html))]
        columns = [batch.column(f.name) for f in fields]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, type=pa.string())], [*[f.name for f in fields], text]
        )

    return over_batches(rest, schema, work, html)
