"""Main text of web pages by composite text density.

A tolerant parser turns a page into a tree of block elements; inline elements count as tags of the block they are in.
Every node gets its characters for each tag, corrected by the share of link characters (Sun, Song and Liao, 2011). The node
with the largest sum of its children's densities is the content, or the article or main element it is in. Where there is no
such element, all nodes below the body that are at least as dense as the thinnest node on the way from the content to the
body, itself included, count too, with the heaviest subtree in each. Headings are short and so never dense: one of the first
level counts anywhere, another one if a block of the article follows. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are known by their
elements, roles, and class and id words, and are left out before densities are computed. Class and id words also name what a
wrapper has (`has-sidebar`), so a part that only they name stays if it is the page's frame, see `_frames`. Ids are often made
from headings: a heading's own id never counts, nor does one that repeats the heading a section opens with. Inside an article or
main element, names count only if all their words are words for parts (`related-posts`, but not `related-work`), and never on
headings. Beside a chosen article, what is dense enough in its main element counts, or, without one, the articles next to it.

Nulls and edge cases: null or empty HTML gives an empty text; text outside any element belongs to the body; elements that
are never closed end with the page, as HTML has it; a `<` that opens nothing is text; repeated rows and null ids give a row
each; an empty table gives an empty result; further columns are ignored. A page must fit in a task's memory.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names. Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg".split())
# Further spellings of a formula, which browsers do not show.
UNSHOWN = frozenset(("annotation", "annotation-xml"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mtable mtr mtd semantics".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("html body table td th caption button article section div aside nav footer header main form blockquote li".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu object embed canvas audio video datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
# Words in class and id that name parts which are not the article.
LAYOUT = (
    r"banner|sidebar|side-bar|aside|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|header|site-header|"
    r"page-header|share|sharing|social|related|recommended|login|signup|search|skip|toolbar|tags?"
)
OTHERS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"comments?|commentlist|disqus|replies|respond"
)
PARTS = re.compile(rf"(?:^|[\s_-])(?:{LAYOUT}|(?P<others>{OTHERS}))(?=$|[\s_-])", re.I)
# Words that go with them in names of parts, as against words of a heading, and names of headers, which articles have too.
BESIDE = (
    r"list|items?|box|wrap|wrapper|container|block|section|area|form|posts?|articles?|stories|links?|buttons?|icons?|bar|top|bottom|left|"
    r"right|inner|outer|content|main|primary|secondary|unit|slot|title|thread|user|reader|site|page|post|entry|inline|group|\d+"
)
WHOLE = re.compile(rf"(?:(?:{LAYOUT}|{OTHERS}|{BESIDE})(?:[_-]+|$))+", re.I)
HEADERS = re.compile(r"(?:^|[_-])(?:header|masthead|banner)$", re.I)
# Words behind these say what a wrapper has or lacks.
STATE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-]\S*", re.I)
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    """A block element with the counts of its subtree. `named` says whether class or id words name it as a part: 0 no,
    1 of the layout, 2 of what others wrote; `slug` is the id if only the id does. `dropped` is final once `_frames` has looked at the named ones."""

    __slots__ = ("tag", "parent", "main", "named", "slug", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, main: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.main, self.named, self.slug = tag, parent, dropped, main, 0, ""
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(value: str, in_article: bool) -> int:
    """What a class or an id names, as in `Node.named`."""
    if not PARTS.search(value):
        return 0
    if in_article:
        value = " ".join(name for name in value.split() if WHOLE.fullmatch(name) and not HEADERS.search(name))
    found = [m["others"] for m in PARTS.finditer(STATE.sub(" ", value))]
    return 1 + any(found) if found else 0


def _slug(text: str) -> str:
    """A heading's text as ids are made from it."""
    return "-".join(re.findall(r"\w+", text.lower()))


def _part(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int, str]:
    """Whether an element is no part of the article, whether it is marked as the main one, what its words name, and its id if
    only the id names that."""
    dropped, role, named, slug = tag in DROPPED or (tag == "header" and not in_article), "", 0, ""
    by_class, nameless = 0, ("body", "html", *ARTICLE)
    if attributes and not dropped:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if tag in nameless or (tag in HEADINGS and (in_article or name == "id")):
                    continue
                found = _named(value, in_article)
                named = max(named, found)
                if name == "class":
                    by_class = max(by_class, found)
                elif found:
                    slug = _slug(value.replace("_", "-"))
            elif name == "role":
                role = value.lower()
            elif name == "hidden":
                dropped = True
            elif name == "aria-hidden":
                dropped |= value.lower() == "true"
            else:
                dropped |= re.search(r"display\s*:\s*none", value, re.I) is not None
    return dropped or role in ROLES, tag in ARTICLE or role == "main", named, "" if by_class else slug


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The page's block nodes, parents first, and its blocks of text in order, each with the node it is in."""
    root = Node("html", None, False)
    nodes, blocks = [root], []
    open_: list[tuple[str, Node]] = [("html", root)]  # elements, inline ones with the block they are in
    count = Counter(("html",))  # of open elements, so that a search that must fail does not walk
    links, texts, at, size = 0, [], 0, len(page)

    def flush() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                node = open_[-1][1]
                blocks.append((node, text))
                if node.tag in HEADINGS:
                    _opened(node, text)
            texts.clear()

    def pop(place: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in open_[place:]):
            flush()
        links -= sum(t == "a" for t, _ in open_[place:])
        count.subtract(t for t, _ in open_[place:])
        del open_[place:]

    def push(tag: str, node: Node) -> None:
        open_.append((tag, node))
        count[tag] += 1

    def add(text: str) -> None:
        node = open_[-1][1]
        if text and not node.dropped:
            text = entities.unescape(text) if "&" in text else text
            texts.append(text)
            n = len(" ".join(text.split()))
            node.chars += n
            node.link_chars += n * (links > 0)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if not count[tag]:
                continue
            for place in range(len(open_) - 1, 0, -1):
                if open_[place][0] == tag:
                    pop(place)
                    break
                if tag in INLINE and open_[place][0] not in INLINE:
                    break  # an inline end tag closes no block
            continue
        if tag in UNSHOWN:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            node = open_[-1][1]
            node.tags += 1
            node.link_tags += tag == "a"
            if tag == "br":
                texts.append(" ")
            elif tag not in VOID and not m[3].endswith("/"):
                push(tag, node)
                links += tag == "a"
            continue
        if tag == "html":
            continue
        closed, until = CLOSES.get(tag, (frozenset(), frozenset()))
        for place in range(len(open_) - 1, 0, -1) if any(count[t] for t in closed) else ():
            name = open_[place][0]
            if name in closed:
                pop(place)
                if tag != "tr":
                    break
            elif name in until:
                break
        # A block ends an open paragraph, and the body the head.
        for place in range(len(open_) - 1, 0, -1) if count["p"] or count["head"] else ():
            if open_[place][0] == "p" or (open_[place][0] == "head" and (tag == "body" or tag not in RAW | VOID)):
                pop(place)
                break
            if open_[place][0] in SCOPE:
                break
        flush()
        parent = open_[-1][1]
        dropped, main, named, slug = _part(tag, m[3], parent.main)
        node = Node(tag, parent, parent.dropped or dropped, main or (parent.main and tag not in ARTICLE))
        node.named, node.slug = named, slug
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        push(tag, node)
        if tag == "xmp":  # its tags are text
            end = re.compile(r"</xmp\s*>?", re.I).search(page, at)
            add(entities.escape(page[at : end.start() if end else size]))
            at = end.end() if end else size
            pop(len(open_) - 1)
    flush()
    _frames(nodes)
    return nodes, blocks


def _opened(heading: Node, text: str) -> None:
    """Forgets what the id of the part around a heading names, if the id was made from the heading's text. Reader comments and
    adverts can have such a heading too, so their words have to stand beside others in it."""
    up, slug = heading.parent, _slug(text)
    while up is not None and up.tag in ("header", "hgroup"):
        up = up.parent
    if up is not None and up.slug and up.slug == slug and (up.named == 1 or not WHOLE.fullmatch(slug)):
        up.named, up.slug = 0, ""


def _frames(nodes: list[Node]) -> None:
    """Drops the subtrees that class or id words name, unless they are the frame of the page.

    A frame holds an article or main element where none lies outside of named parts, or most of the characters outside links
    of the page, or of the main element it is in. What others wrote (comments, adverts, notices) can be long and each comment
    an article, so such a part has to hold a main element or a single article, or most characters with a heading of the first
    level, an article, or no other text around.
    """
    kept = [n for n in nodes if not n.dropped]
    if not any(n.named for n in kept):
        return
    marks = {n: int(n.main and n.tag != "body" and (n.tag in ARTICLE or not n.parent.main)) for n in kept}
    own = dict(marks)
    mains = {n: marks[n] > 0 and n.tag != "article" for n in kept}
    titles = {n: n.tag == "h1" for n in kept}
    plain = {n: n.chars - n.link_chars for n in kept}
    free: set[Node] = set()  # nodes outside of named parts
    scope = {kept[0]: kept[0]}  # the main element around a node, or the page
    for node in kept:
        if not node.named and (node.parent is None or node.parent in free):
            free.add(node)
        if node.parent is not None:
            scope[node] = node.parent if mains[node.parent] and node.parent in free else scope[node.parent]
    lone, alone = not any(marks[n] for n in free), not any(plain[n] for n in free)
    for node in reversed(kept[1:]):
        plain[node.parent] += plain[node]
    for node in reversed(kept[1:]):
        if node.named:
            most = 2 * plain[node] > plain[scope[node]]
            if node.named == 1:
                stays = most or (lone and marks[node] > 0)
            else:
                around = (alone and node.parent in free) or plain[node] == plain[kept[0]]
                stays = (lone and (mains[node] or marks[node] == 1)) or (most and (titles[node] or marks[node] == 1 or around))
            if not stays:
                continue
            node.named = 0
        marks[node.parent] += own[node] or marks[node]
        mains[node.parent] |= mains[node]
        titles[node.parent] |= titles[node]
    for node in kept[1:]:
        node.dropped = node.named > 0 or node.parent.dropped


def measure(nodes: list[Node]) -> Node:
    """Fills in densities and sums of all nodes that are not left out, and returns the body."""
    kept = [n for n in nodes if not n.dropped]
    for node in reversed(kept[1:]):
        up = node.parent
        up.chars += node.chars
        up.tags += node.tags + 1
        up.link_chars += node.link_chars
        up.link_tags += node.link_tags
    body = next((n for n in kept if n.tag == "body"), kept[0])
    share = body.link_chars / max(1, body.chars)
    for n in kept:
        if n.chars:
            plain = n.chars - n.link_chars
            base = math.log(n.chars / max(1, plain) * n.link_chars + share * n.chars + math.e)
            ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
            n.density = n.chars / max(1, n.tags) * math.log(max(1.0, ratio)) / base
    for n in kept[1:]:
        n.parent.total += n.density
    return body


def _subtree(nodes: list[Node], top: Node) -> set[Node]:
    """`top` and all nodes below it; `nodes` has parents first."""
    found = {top}
    for node in nodes:
        if node.parent in found:
            found.add(node)
    return found


def select(nodes: list[Node]) -> tuple[Node, Node, float]:
    """The subtree that holds the article, the article or main element if there is one; the column other parts of it can be in:
    the main element around an article or else what holds it, the main element itself, or the body; and the density from which
    on nodes of the column belong to the article, the thinnest on the way from the densest subtree to the column."""
    body = measure(nodes)
    below = _subtree(nodes, body)
    inside = [n for n in nodes if n in below and not n.dropped] or [body]
    best = max(inside, key=lambda n: n.total)  # the first of equals
    if best.total == 0:
        best = max(inside, key=lambda n: n.density)
    path, up = [best], best
    while up is not body and up.parent is not None:
        up = up.parent
        path.append(up)
    article = next((n for n in path if n.tag == "article"), None)
    main = next((n for n in reversed(path) if n.main and n.tag != "article"), None)
    if article is not None:
        column = main if main is not None and main in path[path.index(article) :] else article.parent
        if column is None or column is article or column not in below:
            return article, article, 0.0
        return article, column, min(n.density for n in path[: path.index(column) + 1])
    if main is not None:
        return main, main, 0.0
    return best, body, min(n.density for n in path)


def _dense(nodes: list[Node], threshold: float) -> set[Node]:
    """Of some nodes, parents first, those that are dense enough and not mostly links, each with all of the heaviest subtree
    in it."""
    heaviest = {n: n for n in nodes}
    for node in reversed(nodes):
        up = heaviest.get(node.parent)
        if up is not None and heaviest[node].total > up.total:
            heaviest[node.parent] = heaviest[node]
    found, whole = set(), set()
    for node in nodes:
        if node.parent in whole or node in whole:
            whole.add(node)
        elif node.density >= threshold and 2 * node.link_chars < node.chars:
            found.add(node)
            whole.add(heaviest[node])
    return found | whole


def _articles(nodes: list[Node], around: Node) -> set[Node]:
    """The articles right below a node, and all nodes in them."""
    found: set[Node] = set()
    for node in nodes:
        if node.parent in found or (node.parent is around and node.tag == "article"):
            found.add(node)
    return found


def _leads(blocks: list[tuple[Node, str]], article: Node, main: Node) -> set[Node]:
    """Paragraphs right below the main element and before the article in it, which can be too short to be dense."""
    found = set()
    for node, _ in blocks:
        up = node
        while up is not None and up is not article:
            up = up.parent
        if up is article:
            break
        if node.tag == "p" and node.parent is main and not node.dropped and 2 * node.link_chars < node.chars:
            found.add(node)
    return found


def _headings(blocks: list[tuple[Node, str]], column: set[Node], wanted: set[Node]) -> set[Node]:
    """Headings of the article that stand outside its nodes, as they are short and so never dense: those of the first level, and
    the others that a wanted block follows. Headings that are mostly links are none."""
    found, leads = set(), False
    for node, _ in reversed(blocks):
        if node.dropped or node not in column:
            continue
        if node in wanted:
            leads = True
        elif node.tag not in HEADINGS:
            leads = False
        elif (leads or node.tag == "h1") and 2 * node.link_chars < node.chars:
            found.add(node)
    return found


def main_text(page: str | None) -> str:
    """The article's blocks, two line breaks between them."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    top, around, threshold = select(nodes)
    core = _subtree(nodes, top)
    wanted = {n for n in core if not n.dropped}
    if around is not top:
        column = _subtree(nodes, around)
        if top.tag == "article" and not around.main:
            column = _articles(nodes, around)
        wanted |= _dense([n for n in nodes if n in column and n is not around and not n.dropped], threshold)
        wanted |= _headings(blocks, column, wanted)
        if top.tag == "article" and around.main:
            wanted |= _leads(blocks, top, around)
    return "\n\n".join(text for node, text in blocks if node in wanted)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page": batch.page, "url": batch.url, "text": [main_text(h) for h in batch.html]})

    rows = pages.select(
        F.col("page_id").cast("string").alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    rows = rows.mapInPandas(texts, "page string, url string, text string")
    return rows.select(F.col("page").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
