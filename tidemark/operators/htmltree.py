"""Minimal HTML tree used inside the extraction task.

Only the predicates the extraction rules need: no CSS engine, no general
DOM.  Tree rules:

* tag names are lower-cased; void elements never get children;
* no implicit closing: an unclosed ``<p>`` contains later paragraphs;
* an end tag closes the nearest open element of that name and is ignored
  when none is open; everything still open is closed at end of input;
* ``script``/``style``/``template`` strings and comments are not text,
  ``noscript`` content is;
* ``<title>`` content is text (entities decoded, tags inside not parsed).
"""

from __future__ import annotations

import html
from html.parser import HTMLParser

# Elements that never hold children.
VOID_ELEMENTS = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
    "command", "frame", "image", "isindex", "nextid", "spacer",
})
# Elements whose direct strings are not document text.
NON_TEXT_ELEMENTS = frozenset({"script", "style", "template"})


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []  # Node or str
        self.parent = parent

    # -- traversal -------------------------------------------------------
    def iter(self):
        """Elements in document order (self included)."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            for child in reversed(node.children):
                if isinstance(child, Node):
                    stack.append(child)

    def find(self, pred):
        for node in self.iter():
            if node is not self and pred(node):
                return node
        return None

    def strings(self):
        """Text strings in document order, skipping non-text containers."""
        stack = [self]
        out = []
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            if item.tag in NON_TEXT_ELEMENTS:
                # strings directly inside are not text; nested elements are walked
                stack.extend(c for c in reversed(item.children) if isinstance(c, Node))
                continue
            stack.extend(reversed(item.children))
        return out

    def text(self) -> str:
        """Each string stripped, empties dropped, joined with nothing."""
        return "".join(s.strip() for s in self.strings() if s.strip())

    def single_string(self):
        """The only string below a chain of single children, else None."""
        node = self
        while True:
            if len(node.children) != 1:
                return None
            child = node.children[0]
            if isinstance(child, str):
                return child
            node = child

    def classes(self) -> str:
        return " ".join((self.attrs.get("class") or "").split())


class Index:
    """First element per tag / id / class token / role, and all meta tags,
    recorded while parsing so every lookup of the extraction rules is O(1)."""

    __slots__ = ("tag", "id", "cls", "role", "meta")

    def __init__(self):
        self.tag: dict = {}
        self.id: dict = {}
        self.cls: dict = {}
        self.role: dict = {}
        self.meta: list = []

    def add(self, node):
        self.tag.setdefault(node.tag, node)
        a = node.attrs
        if "id" in a:
            self.id.setdefault((node.tag, a["id"]), node)
            self.id.setdefault((None, a["id"]), node)
        if a.get("class"):
            for c in a["class"].split():
                self.cls.setdefault(c, node)
        if "role" in a:
            self.role.setdefault(a["role"], node)
        if node.tag == "meta":
            self.meta.append(node)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.stack = [self.root]
        self._in_title = False
        self.index = Index()

    def handle_starttag(self, tag, attrs):
        if self._in_title:
            self._text(self.get_starttag_text() or "")
            return
        parent = self.stack[-1]
        node = Node(tag, {k: ("" if v is None else v) for k, v in attrs}, parent)
        parent.children.append(node)
        self.index.add(node)
        if tag in VOID_ELEMENTS:
            return
        self.stack.append(node)
        if tag == "title":
            self._in_title = True
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        if self._in_title:
            self._text(self.get_starttag_text() or "")
            return
        parent = self.stack[-1]
        node = Node(tag, {k: ("" if v is None else v) for k, v in attrs}, parent)
        parent.children.append(node)
        self.index.add(node)

    def handle_endtag(self, tag):
        if self._in_title:
            if tag != "title":
                self._text(f"</{tag}>")
                return
            self._in_title = False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def _text(self, data: str):
        if not data:
            return
        parent = self.stack[-1]
        if parent.children and isinstance(parent.children[-1], str):
            parent.children[-1] += data
        else:
            parent.children.append(data)

    def handle_data(self, data):
        if self._in_title:
            data = html.unescape(data)
        self._text(data)


def release(nodes) -> None:
    """Cut the links of a tree that isn't needed any more, so that it goes at once and not when the collector runs."""
    for node in nodes:
        node.parent = None
        node.children = ()


def parse(doc: str) -> Node:
    return parse_indexed(doc)[0]


def parse_indexed(doc: str):
    """-> (root, Index).  The index reflects the document before any removal."""
    b = _Builder()
    try:
        b.feed(doc or "")
        b.close()
    except Exception:  # malformed markup: keep what was built
        pass
    return b.root, b.index
