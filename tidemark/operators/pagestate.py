"""Fetch classification, soft-404 and re-render merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases marking a 200 page as an error page.
SOFT_404_PHRASES = [
    "page not found", "404 not found", "404 error", "not found", "page doesn't exist",
    "page does not exist", "nothing here", "this page isn't available",
    "this page could not be found", "we couldn't find", "no longer available",
    "has been removed", "has been moved", "does not exist", "access denied", "forbidden",
    "403 forbidden", "you don't have permission", "blocked", "just a moment", "error 404",
    "error 403", "error 500", "internal server error", "service unavailable",
]
SOFT_404_HTTP = "Soft 404: page content indicates an error page"
SOFT_404_RENDERED = "Soft 404: rendered page content indicates an error page"
RETRY_STATUSES = (403, 429)

_SOFT_404_RE = "(" + "|".join(p.replace("'", "'") for p in SOFT_404_PHRASES) + ")"


def classify_fetch(fetches: DataFrame) -> DataFrame:
    """``fetches(url, status, content_type, html, error)`` -> status/error.

    Order: exception (status 0) ; content type without ``text/html`` ;
    status >= 400.  Error rows keep only url, status, error; ``html`` is
    kept for good rows only, so extraction never sees error bodies.
    """
    ct = F.coalesce(F.col("content_type"), F.lit(""))
    err = (F.when(F.col("error").isNotNull(), F.col("error"))
           .when(~ct.contains("text/html"), F.concat(F.lit("Non-HTML content type: "), ct))
           .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
    status = F.when(F.col("error").isNotNull(), F.lit(0)).otherwise(F.col("status"))
    out = fetches.withColumn("fetch_error", err).withColumn("fetch_status", status.cast("int"))
    return (out.withColumn("html", F.when(F.col("fetch_error").isNull(), F.col("html")))
            .drop("error", "status").withColumnRenamed("fetch_error", "error"))


def soft_404_hit(title, description, content=None):
    """D12 predicate on lower-cased fields (content: first 500 chars)."""
    fields = [F.lower(F.trim(F.coalesce(title, F.lit("")))),
              F.lower(F.trim(F.coalesce(description, F.lit(""))))]
    if content is not None:
        fields.append(F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 500)))
    hit = None
    for f in fields:
        h = f.rlike(_SOFT_404_RE)
        hit = h if hit is None else (hit | h)
    return hit


def flag_soft_404(extracted: DataFrame, use_content: bool = False) -> DataFrame:
    """Rows whose text reads like an error page become error rows.

    HTTP path (``use_content=False``): content is not yet attached when the
    check runs, so only title and description are tested.  Rendered path:
    all three fields.  Error rows keep url, status and error only.
    """
    hit = soft_404_hit(F.col("title"), F.col("description"),
                       F.col("content_text") if use_content else None)
    msg = SOFT_404_RENDERED if use_content else SOFT_404_HTTP
    cleared = ["title", "description", "og_title", "og_description", "og_type", "og_image",
               "content_text"]
    out = extracted.withColumn("_hit", F.coalesce(F.col("error").isNull() & hit, F.lit(False)))
    for c in cleared:
        if c in out.columns:
            out = out.withColumn(c, F.when(~F.col("_hit"), F.col(c)))
    if "is_js_rendered" in out.columns:
        out = out.withColumn("is_js_rendered", F.col("is_js_rendered") & ~F.col("_hit"))
    return out.withColumn("error", F.when(F.col("_hit"), F.lit(msg)).otherwise(F.col("error"))).drop("_hit")


def needs_render(extracted: DataFrame) -> DataFrame:
    """Rows for the browser pass: CSR without error, or blocked (403/429)."""
    return extracted.filter((F.col("is_js_rendered") & F.col("error").isNull())
                            | F.col("fetch_status").isin(*RETRY_STATUSES))


def merge_rendered(extracted: DataFrame, rendered: DataFrame) -> DataFrame:
    """Replace a row by its rendered version when needed and successful.

    ``rendered`` carries the same columns as ``extracted`` (already extracted
    and soft-404 checked) plus ``error``.  The rendered row is marked
    js-rendered; a failed render leaves the original row.
    """
    need = ((F.col("o.is_js_rendered") & F.col("o.error").isNull())
            | F.col("o.fetch_status").isin(*RETRY_STATUSES))
    take = need & F.col("r.url").isNotNull() & F.col("r.error").isNull()
    cols = [c for c in extracted.columns if c != "url"]
    rcols = set(rendered.columns)
    out = [F.col("o.url").alias("url")]
    for c in cols:
        if c == "is_js_rendered":
            out.append(F.when(take, F.lit(True)).otherwise(F.col("o.is_js_rendered")).alias(c))
        elif c in rcols:
            out.append(F.when(take, F.col(f"r.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return extracted.alias("o").join(rendered.alias("r"), F.col("o.url") == F.col("r.url"), "left").select(out)
