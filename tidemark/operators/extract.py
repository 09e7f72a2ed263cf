"""Page extraction (D0-D7) as one Arrow-batched pass over ``(url, html)``.

HTML crosses into Python exactly once per page; the task emits a narrow
struct of candidates and measures (no shuffle, output far smaller than
input).  Every *decision* that can be a column expression (title,
description and meta values D1-D3, CSR rule D4, Markdown cleaning D8-D10,
soft-404 D12) is taken afterwards on the JVM side.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import htmltree
from ..functions import text as tx

MAX_DESCRIPTION_LENGTH = 500
MIN_CONTENT_TEXT = 100      # a content candidate must hold more text than this
MIN_PARAGRAPH_TEXT = 20     # first-paragraph description needs more than this
SLICE_BYTES = 1 << 20       # markup that a task holds as text and trees at a time

# Noise selectors (D5) expressed as predicates.
NOISE_TAGS = frozenset({"nav", "header", "footer", "aside", "script", "style",
                        "noscript", "iframe", "button"})
NOISE_ROLES = frozenset({"navigation", "banner", "contentinfo"})
NOISE_CLASSES = frozenset({"nav", "navbar", "header", "footer", "sidebar", "cookie-banner",
                           "cookie-consent", "popup", "modal", "ad", "advertisement"})
NOISE_IDS = frozenset({"cookie-banner", "cookie-consent"})
NOISE_CLASS_SUBSTRINGS = ("cta", "social-proof", "logo-cloud", "logo-grid", "logo-bar",
                          "logo-wall", "client-logo", "partner-logo", "customer-logo",
                          "trust-badge", "testimonial", "banner", "announcement")
# Main-content candidates (D6), tried in this order.
CONTENT_CANDIDATES = (("tag", "main"), ("tag", "article"), ("role", "main"),
                      ("class", "content"), ("class", "post-content"),
                      ("class", "article-content"), ("class", "entry-content"),
                      ("class", "page-content"), ("id", "content"), ("id", "main-content"))

_META_TAG = T.StructType([T.StructField(a, T.StringType()) for a in ("property", "name", "content")])
# What the pass over a page emits: candidates and measures, no choices.
CANDIDATE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title_string", T.StringType()),
    T.StructField("h1_text", T.StringType()),
    T.StructField("p_text", T.StringType()),
    T.StructField("meta_tags", T.ArrayType(_META_TAG)),
    T.StructField("markdown", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("has_body", T.BooleanType()),
    T.StructField("body_text_len", T.IntegerType()),
    T.StructField("body_link_count", T.IntegerType()),
    T.StructField("body_child_count", T.IntegerType()),
    T.StructField("has_next_div", T.BooleanType()),
    T.StructField("root_text_len", T.IntegerType()),
    T.StructField("has_noscript", T.BooleanType()),
])
OG_FIELDS = {"og_title": "og:title", "og_description": "og:description", "og_type": "og:type", "og_image": "og:image"}
_MEASURES = [f.name for f in CANDIDATE_SCHEMA.fields[5:]]
PAGE_FIELDS = ["url", "title", "description", *OG_FIELDS, *_MEASURES]


# ---------------------------------------------------------------------------
# choices among the candidates (D1-D3), as columns
# ---------------------------------------------------------------------------

def meta_value(value: str, *attributes: str) -> Column:
    """D3: content of the first meta tag whose attribute is ``value``; the
    attributes are tried in order, and an empty content gives NULL."""
    def first(attribute):
        return F.get(F.filter("meta_tags", lambda tag: tag[attribute] == value), F.lit(0))

    content = F.coalesce(*(first(a) for a in attributes))["content"]
    return F.when(content != "", tx.py_strip(content))


def with_page_fields(candidates: DataFrame) -> DataFrame:
    """Title, description and Open Graph fields from the candidates."""
    title = F.when(F.coalesce(F.col("title_string"), F.lit("")) != "", tx.py_strip(F.col("title_string"))) \
        .otherwise(F.col("h1_text"))
    description = F.coalesce(
        F.nullif(meta_value("description", "name"), F.lit("")),
        F.nullif(meta_value("og:description", "property", "name"), F.lit("")),
        F.when(F.length("p_text") > MIN_PARAGRAPH_TEXT, F.col("p_text")))
    fields = {"title": title, "description": F.substring(description, 1, MAX_DESCRIPTION_LENGTH)}
    fields |= {c: meta_value(v, "property", "name") for c, v in OG_FIELDS.items()}
    return candidates.withColumns(fields).drop("title_string", "h1_text", "p_text", "meta_tags")


# ---------------------------------------------------------------------------
# per-page rules (run inside the task)
# ---------------------------------------------------------------------------

def _is_noise(n) -> bool:
    if n.tag in NOISE_TAGS:
        return True
    a = n.attrs
    if a.get("role") in NOISE_ROLES or a.get("id") in NOISE_IDS:
        return True
    if (a.get("type") or "").lower() == "submit":
        return True
    cls = n.classes()
    if cls:
        if NOISE_CLASSES.intersection(cls.split(" ")):
            return True
        if any(s in cls for s in NOISE_CLASS_SUBSTRINGS):
            return True
    return False


def _drop_noise(node, removed: set):
    kept = []
    for c in node.children:
        if isinstance(c, str) or not _is_noise(c):
            kept.append(c)
        else:
            removed.add(id(c))
    node.children = kept
    for c in kept:
        if isinstance(c, htmltree.Node):
            _drop_noise(c, removed)


def _alive(n, removed: set) -> bool:
    while n is not None:
        if id(n) in removed:
            return False
        n = n.parent
    return True


def _candidate(root, idx, removed, kind, value):
    if kind == "tag":
        first, pred = idx.tag.get(value), (lambda n: n.tag == value)
    elif kind == "role":
        first, pred = idx.role.get(value), (lambda n: n.attrs.get("role") == value)
    elif kind == "id":
        first, pred = idx.id.get((None, value)), (lambda n: n.attrs.get("id") == value)
    else:
        first, pred = idx.cls.get(value), (lambda n: value in n.classes().split(" "))
    if first is None:
        return None
    if _alive(first, removed):
        return first
    return root.find(pred)  # first match was removed as noise: search the pruned tree


def _content_root(root, idx, removed):
    for kind, value in CONTENT_CANDIDATES:
        el = _candidate(root, idx, removed, kind, value)
        if el is not None and len(el.text()) > MIN_CONTENT_TEXT:
            return el
    body = idx.tag.get("body")
    if body is not None and _alive(body, removed):
        return body
    body = root.find(lambda n: n.tag == "body")
    return body if body is not None else root


# -- Markdown renderer (D7) ----------------------------------------------------
# Contract: '#'-headings, '* ' list items nested by two spaces, '[text](href)'
# for links not starting with '#', '**' / '_' emphasis around inline-only
# content, fenced 'pre', '> ' quotes, no images, one newline between blocks,
# white space inside text collapsed to single spaces.
_BLOCK = frozenset({"p", "div", "section", "article", "main", "header", "footer", "aside",
                    "nav", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre",
                    "blockquote", "table", "tr", "form", "figure", "hr", "dl", "dt", "dd",
                    "body", "html", "[document]"})
_WS = re.compile(r"\s+")


def _has_block(node) -> bool:
    for n in node.iter():
        if n is not node and n.tag in _BLOCK:
            return True
    return False


class _Renderer:
    def __init__(self):
        self.lines: list[str] = []
        self.buf: list[str] = []
        self.prefix = ""
        self.depth = 0

    def flush(self):
        text = _WS.sub(" ", "".join(self.buf)).strip()
        self.buf = []
        if text:
            self.lines.append(self.prefix + text)
            if self.prefix.lstrip().startswith("*"):
                self.prefix = "  " * self.depth + "  "

    def inline(self, node) -> str:
        parts = []
        for c in node.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag in htmltree.NON_TEXT_ELEMENTS or c.tag == "img":
                continue
            elif c.tag == "br":
                parts.append(" ")
            else:
                parts.append(self._inline_el(c))
        return "".join(parts)

    def _inline_el(self, c) -> str:
        inner = self.inline(c)
        tag = c.tag
        if tag == "a":
            href = c.attrs.get("href", "")
            label = _WS.sub(" ", inner).strip()
            if href and not href.startswith("#") and label:
                return f"[{label}]({href})"
            return inner
        if tag in ("b", "strong"):
            return f"**{inner.strip()}**" if inner.strip() else inner
        if tag in ("i", "em"):
            return f"_{inner.strip()}_" if inner.strip() else inner
        if tag == "code":
            return f"`{inner}`"
        return inner

    def block(self, node):
        for c in node.children:
            if isinstance(c, str):
                self.buf.append(c)
                continue
            tag = c.tag
            if tag in htmltree.NON_TEXT_ELEMENTS or tag == "img":
                continue
            if tag == "br":
                self.flush()
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.flush()
                text = _WS.sub(" ", self.inline(c)).strip()
                if text:
                    self.lines.append("#" * int(tag[1]) + " " + text)
            elif tag == "pre":
                self.flush()
                self.lines.append("```")
                self.lines.extend("".join(c.strings()).strip("\n").split("\n"))
                self.lines.append("```")
            elif tag in ("ul", "ol"):
                self.flush()
                self.depth += 1
                self.block(c)
                self.depth -= 1
                self.flush()
            elif tag == "li":
                self.flush()
                saved = self.prefix
                self.prefix = "  " * max(self.depth - 1, 0) + "* "
                self.block(c)
                self.flush()
                self.prefix = saved
            elif tag == "blockquote":
                self.flush()
                saved = self.prefix
                self.prefix = saved + "> "
                self.block(c)
                self.flush()
                self.prefix = saved
            elif tag == "hr":
                self.flush()
                self.lines.append("* * *")
            elif tag in _BLOCK:
                self.flush()
                self.block(c)
                self.flush()
            elif _has_block(c):
                self.block(c)  # inline wrapper around blocks: render transparently
            else:
                self.buf.append(self._inline_el(c))

    def render(self, node) -> str:
        self.block(node)
        self.flush()
        return "\n".join(self.lines)


def to_markdown(node) -> str:
    return _Renderer().render(node)


def candidates_of(url: str, doc: str) -> dict:
    """Candidates and measures of one page."""
    root, idx = htmltree.parse_indexed(doc)
    nodes = list(root.iter())
    body, title = idx.tag.get("body"), idx.tag.get("title")
    app = idx.id.get(("div", "root")) or idx.id.get(("div", "app"))
    out = {
        "url": url,
        "title_string": title.single_string() if title is not None else None,
        "meta_tags": [{a: m.attrs.get(a) for a in ("property", "name", "content")} for m in idx.meta],
        "links": [n.attrs["href"] for n in nodes if n.tag == "a" and "href" in n.attrs],
        "has_body": body is not None,
        "has_next_div": ("div", "__next") in idx.id,
        "root_text_len": len(app.text()) if app is not None else None,
        "has_noscript": "noscript" in idx.tag,
        **{f"{t}_text": n.text() for t in ("h1", "p") if (n := idx.tag.get(t)) is not None},
    }
    if body is not None:
        out["body_text_len"] = len(body.text())
        out["body_link_count"] = sum(1 for n in body.iter() if n.tag == "a" and "href" in n.attrs)
        out["body_child_count"] = sum(1 for c in body.children if isinstance(c, htmltree.Node)
                                      and c.tag not in ("script", "style", "link"))
    removed: set = set()
    _drop_noise(root, removed)
    out["markdown"] = to_markdown(_content_root(root, idx, removed))
    htmltree.release(nodes)
    return out


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = SLICE_BYTES):
    """Slices of a batch with about ``most_bytes`` of ``text``, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(CANDIDATE_SCHEMA)


_ARROW_SCHEMA = _arrow_schema()


def extract_pages(snapshots: DataFrame) -> DataFrame:
    """``(url, html, ...)`` -> one row per page with fields and measures.

    Other input columns (keys such as ``site``, ``page_id``) travel through
    the same task beside ``url`` and ``html``; nothing is shuffled.  Task
    sizes follow the file splits of the scan.  Whatever the size of an Arrow
    batch, ``SLICE_BYTES`` of it are parsed and emitted at a time.
    """
    keys = [c for c in snapshots.columns if c not in ("url", "html")]
    packed = snapshots.select(F.struct(*keys, F.lit(None).alias("_")).alias("_k"), "url", "html") if keys \
        else snapshots.select(F.struct(F.lit(0).alias("_")).alias("_k"), "url", "html")
    schema = T.StructType([T.StructField("_k", packed.schema["_k"].dataType), *CANDIDATE_SCHEMA.fields])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "html")):
            rows = [candidates_of(u, d or "") for u, d in
                    zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            found = pa.RecordBatch.from_pylist(rows, schema=_ARROW_SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), *found.columns], ["_k", *found.schema.names])

    raw = packed.mapInArrow(run, schema)
    return with_page_fields(raw).select(*(F.col(f"_k.{k}").alias(k) for k in keys), *PAGE_FIELDS)


def with_content(extracted: DataFrame) -> DataFrame:
    """D8-D10 on the raw Markdown, natively; empty result -> NULL content."""
    cleaned = tx.cap_text(tx.strip_boilerplate(tx.clean_markdown(F.col("markdown"))))
    return extracted.withColumn("content_text", F.nullif(cleaned, F.lit("")))


def with_csr(extracted: DataFrame) -> DataFrame:
    """Ordered CSR rules as one CASE over the measures from D0."""
    useful_meta = (F.coalesce(F.col("title"), F.lit("")) != "") & \
        (F.coalesce(F.col("description"), F.lit("")) != "")
    t = F.col("body_text_len")
    is_csr = (F.when(~F.col("has_body"), True)
              .when(t > 200, False)
              .when(F.col("has_next_div") & useful_meta, False)
              .when(F.col("root_text_len").isNotNull() & (F.col("root_text_len") < 50), True)
              .when(F.col("has_noscript") & (t < 100), True)
              .when((F.col("body_child_count") <= 1) & (t < 50), True)
              .otherwise(False))
    return extracted.withColumn("is_js_rendered", is_csr).withColumn("has_useful_meta", useful_meta)


def crawl_needs_render(extracted: DataFrame) -> DataFrame:
    """Link-crawl CSR rule (< 3 links and < 500 text chars; false without a body)."""
    few = (F.col("body_link_count") < 3) & (F.col("body_text_len") < 500)
    return extracted.withColumn("needs_render", F.col("has_body") & F.coalesce(few, F.lit(False)))
