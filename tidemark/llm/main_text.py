"""Main text of web pages by tree scoring (operator 6).

A page is cut into tags and texts; open elements form a tree.  Every block
of text (a paragraph) earns points for its length and its commas and passes
them to its ancestors, less with each level.  A container's points are
discounted by its link density.  The best container is kept; an article or
main element around it is taken whole.  What stands beside it or beside one of
its ancestors is kept too, unless at least ``MOST_LINKED`` of its text is in
links (an unnamed menu); of such an element, the parts under that share that
are long enough for a paragraph stay.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments) gives neither points nor text.  Some tags and roles are furniture
whatever they hold.  Names only mark a candidate: a class or id token that is
a furniture name, alone or with words for boxes or at its end, marks it
strongly, one that merely holds such a name (``share-price-report``) weakly,
``has-sidebar`` and the like not at all.  A strongly marked element, a header,
a form and a fieldset with controls are furniture unless they hold most of
the page's unlinked text; a weakly marked one is furniture if it is short or
mostly links.  A form around the page thus loses its controls, not its
paragraphs.  Comments stay furniture however long they are.

Defined results: null or empty html gives an empty text; unclosed and stray
tags are tolerated; character references are decoded once; white space inside
a block is one space; blocks are joined in page order by a line feed.  Very
long pages are read whole; repeated rows give repeated results; an empty table
gives an empty result; other columns, of whatever name, are left alone.  Rows
are independent, so no shuffle.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts_of

CHUNK_BYTES = 8 << 20

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg annotation".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover "
    "munder munderover semantics mstyle mspace mpadded".split())
FURNITURE_TAGS = frozenset(
    "nav footer aside button select dialog menu head object audio video canvas".split())
CONTROLS = frozenset("input select textarea button".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu "
    "submenu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist "
    "disqus respond replies cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar skip".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies".split())
# Words for boxes beside a name, and words that turn a name round.
BOX_WORDS = frozenset(
    "area bar block bottom box buttons container content entry fixed form group holder inline inner item items left links list "
    "main outer page panel posts right row section site slot small sticky text top unit wrap wrapper".split())
TURNING_WORDS = frozenset("has no not non with without hide show is".split())
NEVER_BY_NAME = frozenset("html body article main".split())
CLOSED_BY = {  # an open element of the key is closed by the start of these
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
LEVELS = 5
LEAST_PARAGRAPH = 25
SIBLING_SHARE = 0.2
LEAST_SIBLING = 10.0
MOST_LINKED = 0.5
MOST_OF_PAGE, LEAST_OF_PAGE = 0.5, 250  # share of the page's unlinked text, and characters, that show a marked element holds the text
SHORT, LINKED = 120, 0.3  # a weakly marked element up to this size, or with this share of links, is furniture

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Node:
    __slots__ = ("commas", "controls", "furniture", "kept", "links", "mark", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: _Node | None, mark: str):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.furniture = mark == "always" or parent is not None and parent.furniture
        self.points, self.size, self.links, self.commas, self.controls, self.kept = 0.0, 0, 0, 0, 0, False


def _mark_of_names(value: str, in_article: bool) -> str:
    found = ""
    for token in value.split():
        words = [w.lower() for w in _NAMES.findall(token)]
        if in_article:
            words = [w for w in words if w != "header"]
        if not FURNITURE_NAMES.intersection(words) or TURNING_WORDS.intersection(words):
            continue
        if words[-1] not in FURNITURE_NAMES and not all(w in FURNITURE_NAMES or w in BOX_WORDS for w in words):
            found = found or "weak"
        elif COMMENT_NAMES.intersection(words):
            return "comments"
        else:
            found = "strong"
    return found


def _mark(tag: str, attrs: str, in_article: bool) -> str:
    """always, comments, strong, controls, weak, or nothing."""
    if tag in FURNITURE_TAGS:
        return "always"
    found = "controls" if tag == "fieldset" else "strong" if tag == "form" or tag == "header" and not in_article else ""
    for m in _ATTR.finditer(attrs):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "always"
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "always"
        if name == "role" and value.lower() in FURNITURE_ROLES:
            if value.lower() != "form":
                return "always"
            found = "strong"
        if name in ("class", "id") and tag not in NEVER_BY_NAME:
            named = _mark_of_names(value, in_article)
            if named == "comments" or named and not found or named == "strong":
                found = named
    return found


def _settle(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Decide which marked elements are furniture."""
    if not any(n.mark not in ("", "always") for n in nodes):
        return
    size, links = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for holder, text, linked in blocks:
        size[holder] += len(text)
        links[holder] += linked
    aside = 0
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            size[node.parent] += size[node]
            links[node.parent] += links[node]
            node.parent.controls += node.controls
    for node in nodes:
        if node.mark == "comments" and not node.furniture:
            node.furniture = True
            aside += size[node] - links[node]
        node.furniture = node.furniture or node.parent is not None and node.parent.furniture
    whole = size[nodes[0]] - links[nodes[0]] - aside
    for node in nodes:  # parents come before their children
        if node.parent is not None and node.parent.furniture:
            node.furniture = True
        elif node.mark == "weak":
            node.furniture = size[node] <= SHORT or links[node] >= LINKED * size[node]
        elif node.mark == "strong" or node.mark == "controls" and node.controls:
            own = size[node] - links[node]
            node.furniture = own < LEAST_OF_PAGE or own <= MOST_OF_PAGE * whole


def _tree(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """Nodes in page order, and blocks: (element, text, characters inside links)."""
    root = _Node("html", None, "")
    nodes, blocks, stack, open_tags = [root], [], [root], Counter()
    parts: list[str] = []
    held_links = articles = anchors = 0

    def flush():
        nonlocal held_links
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                holder = next(n for n in reversed(stack) if n.tag not in INLINE)
                blocks.append((holder, text, min(held_links, len(text))))
            parts.clear()
        held_links = 0

    def pop_to(tag: str):
        nonlocal articles, anchors
        while len(stack) > 1:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            articles -= gone.tag in ("article", "main")
            anchors -= gone.tag == "a"
            if gone.tag == tag:
                return

    at, end = 0, len(page)
    while at < end:
        m = _MARK.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].furniture:
            parts.append(page[at:stop])
            if anchors:
                held_links += stop - at
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing, attrs = (m.group(1) or m.group(4)) == "/", m.group(3) or m.group(6) or ""
        if tag == "br":
            parts.append(" ")
            continue
        if closing:
            if tag not in INLINE:
                flush()
            if open_tags[tag]:
                pop_to(tag)
            continue
        if tag in RAW:
            stack[-1].controls += tag == "textarea"
            if not attrs.endswith("/") or tag != "svg":
                shut = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = shut.end() if shut else end if tag in ("script", "style", "textarea", "xmp") else at
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            stack[-1].controls += tag == "input"
            continue
        if tag not in INLINE:
            flush()
            if open_tags["p"]:
                pop_to("p")
            for inner, by in CLOSED_BY.items():
                if tag in by and open_tags[inner]:
                    scope = next((n.tag for n in reversed(stack) if n.tag in (inner, "ul", "ol", "dl", "table")), "")
                    if scope == inner:
                        pop_to(inner)
            if tag in ("html", "body") and len(nodes) < 3 and tag == "html":
                continue
        above = stack[-1]
        node = _Node(tag, above, _mark(tag, attrs, articles > 0))
        node.controls += tag in CONTROLS
        nodes.append(node)
        stack.append(node)
        open_tags[tag] += 1
        articles += tag in ("article", "main")
        anchors += tag == "a"
    flush()
    return nodes, blocks


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    nodes, blocks = _tree(page)
    _settle(nodes, blocks)
    blocks = [b for b in blocks if not b[0].furniture]
    if not blocks:
        return ""
    for holder, text, links in blocks:
        holder.size += len(text)
        holder.links += links
        length = len(text)
        points = 1 + text.count(",") + min(length / 100, 3) if length >= LEAST_PARAGRAPH else length / 100
        points *= 1 - links / length
        above = holder.parent if holder.tag not in ("div", "section", "article", "main", "body", "html") else holder
        for level in range(LEVELS):
            if above is None:
                break
            above.points += points / (1, 2, 6, 9, 12)[level]
            above = above.parent
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
    best, best_points = None, -1.0
    for node in nodes:
        if not node.furniture and node.points:
            node.points *= 1 - node.links / max(node.size, 1)
            if node.points > best_points:
                best, best_points = node, node.points
    if best is None:
        return ""
    around = best
    while around is not None:
        if around.tag in ("article", "main"):
            best = around
            break
        around = around.parent
    best.kept = True
    above, around = set(), best.parent
    while around is not None:
        above.add(around)
        around = around.parent
    for node in nodes:  # parents come before their children
        if node.parent is None or node.furniture or node is best or node in above:
            continue
        beside = node.parent in above
        node.kept = node.parent.kept \
            or node.links < MOST_LINKED * node.size and (beside or node.size >= LEAST_PARAGRAPH) \
            or node.parent is best.parent and node.points >= max(LEAST_SIBLING, SIBLING_SHARE * best_points)
    return "\n".join(text for holder, text, links in blocks if holder.kept or links < MOST_LINKED * len(text)
                     and (holder in above or len(text) >= LEAST_PARAGRAPH))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, main text and its length in code points of every row."""
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "html", CHUNK_BYTES):
                found = [extract(h) for h in texts_of(batch.column("html"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("url"), pa.array(found, pa.string()),
                     pa.array(map(len, found), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")) \
        .mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long") \
        .withColumnsRenamed({"id": id_col, "url": url_col})
