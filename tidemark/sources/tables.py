"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- A1 page snapshots -------------------------------------------------------
FETCH_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("error", T.StringType()),
])


def load_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: fetch table ``(url, status, content_type, html, error)``."""
    return spark.read.format(fmt).schema(FETCH_SCHEMA).load(path)


def pages_as_fetches(pages: DataFrame) -> DataFrame:
    """A1 for the driver ``pages`` table: every row is a 200 ``text/html`` fetch."""
    return pages.select("page_id", "url", F.lit(200).alias("status"),
                        F.lit("text/html; charset=utf-8").alias("content_type"), "html",
                        F.lit(None).cast("string").alias("error"))


# -- A2/A3 robots and sitemap bodies -----------------------------------------
def load_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2: ``(site, body)``; sites without a row get an empty result downstream."""
    return spark.read.format(fmt).schema("site string, body string").load(path)


def load_sitemaps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A3: ``(sitemap_url, body)``; a missing URL contributes no entries."""
    return spark.read.format(fmt).schema("sitemap_url string, body string").load(path)


# -- A4 job table --------------------------------------------------------------
JOB_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("mode", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("config", T.StringType()),
    T.StructField("result_llms_txt", T.StringType()), T.StructField("result_meta", T.StringType()),
    T.StructField("llms_full_txt_key", T.StringType()), T.StructField("error_message", T.StringType()),
    T.StructField("ip_address", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("completed_at", T.TimestampType()),
])

RESULT_META_SCHEMA = T.StructType([
    T.StructField("total_pages", T.LongType()), T.StructField("pages_processed", T.LongType()),
    T.StructField("pages_failed", T.LongType()), T.StructField("generation_time_seconds", T.DoubleType()),
    T.StructField("llm_calls_made", T.LongType()), T.StructField("llm_cost_usd", T.DoubleType()),
])


def load_jobs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: job table with JSON text columns ``config`` / ``result_meta``."""
    return spark.read.format(fmt).schema(JOB_SCHEMA).load(path)


# -- A5 progress events ----------------------------------------------------------
PROGRESS_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("urls_found", T.IntegerType()),
    T.StructField("completed", T.IntegerType()), T.StructField("total", T.IntegerType()),
    T.StructField("current_url", T.StringType()), T.StructField("timestamp", T.TimestampType()),
])


def _message(col: str):
    return F.from_json(F.col(col).cast("string"), PROGRESS_SCHEMA, {"mode": "PERMISSIVE"})


def message_fault(col: str = "value"):
    """Why a message can't be used: no JSON object, or one without job or phase; null if it can."""
    is_object = F.from_json(F.col(col).cast("string"), T.MapType(T.StringType(), T.StringType())).isNotNull() & \
        F.col(col).rlike(r"^\s*\{")
    message = _message(col)
    return (F.when(~F.coalesce(is_object, F.lit(False)), F.lit("not a JSON object"))
            .when(message["job_id"].isNull(), F.lit("no job_id")).when(message["phase"].isNull(), F.lit("no phase")))


def parse_progress(raw: DataFrame, col: str = "value") -> DataFrame:
    """A5: JSON messages -> typed events; bad JSON (or no job/phase) dropped."""
    return (raw.select(_message(col).alias("e")).select("e.*")
            .filter(F.col("job_id").isNotNull() & F.col("phase").isNotNull()))


def _lines(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path)


def read_progress(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A5: JSON-lines progress messages from files, batch or stream."""
    return parse_progress(_lines(spark, path, stream), "value")


def progress_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A5 in the form of the event operators: messages have no number, so a hash of the line settles ties."""
    raw = _lines(spark, path, stream)
    return raw.select(F.xxhash64("value").alias("event_id"), _message("value").alias("e")) \
        .select("e.job_id", "event_id", "e.phase", "e.message", "e.completed", "e.total", F.col("e.timestamp").alias("ts")) \
        .where("job_id IS NOT NULL AND phase IS NOT NULL")


def unreadable_progress(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A5: the lines that ``read_progress`` leaves out, ``(file, line, reason)``."""
    return _lines(spark, path, stream).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"),
                                              message_fault().alias("reason")).where("reason IS NOT NULL")


# -- A6 document sink ------------------------------------------------------------
def write_documents(docs: DataFrame, metrics: DataFrame, path: str, mode: str = "overwrite",
                    buckets: int = 64) -> None:
    """Documents as Parquet ``(site, doc)`` and metrics as JSON text.

    Written per run directory; partitioned by a site hash bucket so one
    run with millions of sites does not produce millions of folders.
    """
    bucket = F.pmod(F.xxhash64("site"), F.lit(buckets)).alias("bucket")
    docs.select(bucket, "site", "doc").write.mode(mode).partitionBy("bucket").parquet(f"{path}/docs")
    meta = metrics.select("site", run_meta_json(metrics).alias("meta"))
    meta.write.mode(mode).parquet(f"{path}/meta")


def run_meta_json(metrics: DataFrame):
    """Metrics row -> JSON text without the documents themselves."""
    cols = [c for c in ("total_pages", "pages_processed", "pages_failed", "llm_calls_made",
                        "llm_cost_usd") if c in metrics.columns]
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


# -- A7 run-config ingest --------------------------------------------------------
CONFIG_SCHEMA = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("crawl", T.StructType([
        T.StructField("max_urls", T.LongType()), T.StructField("max_depth", T.LongType()),
        T.StructField("crawl_delay_ms", T.LongType()), T.StructField("timeout_seconds", T.LongType()),
        T.StructField("respect_robots_txt", T.BooleanType()),
    ])),
])
# Defaults and bounds of a run configuration.
CONFIG_DEFAULTS = {"mode": "default", "max_urls": 50, "max_depth": 2, "crawl_delay_ms": 300,
                   "timeout_seconds": 30, "respect_robots_txt": True}
CONFIG_BOUNDS = {"max_urls": (1, 100), "max_depth": (1, 3), "crawl_delay_ms": (0, None),
                 "timeout_seconds": (5, 60)}
MODES = ("default", "detailed")


def parse_config(df: DataFrame, col: str = "config") -> DataFrame:
    """JSON config -> defaults filled, bounds checked; ``reject_reason`` set when invalid."""
    p = F.from_json(F.col(col), CONFIG_SCHEMA)
    out = df.withColumn("_p", p)
    mode = F.coalesce(F.col("_p.mode"), F.lit(CONFIG_DEFAULTS["mode"]))
    # a struct parse of invalid JSON yields NULL fields, not NULL: validate through a map
    is_obj = F.from_json(F.col(col), T.MapType(T.StringType(), T.StringType())).isNotNull() & \
        F.col(col).rlike(r"^\s*\{")
    reason = F.when(F.col(col).isNotNull() & ~F.coalesce(is_obj, F.lit(False)), F.lit("config: not a JSON object"))
    reason = reason.when(~mode.isin(*MODES), F.concat(F.lit("mode: '"), mode, F.lit("' is not a valid choice")))
    fields = []
    for name, (lo, hi) in CONFIG_BOUNDS.items():
        v = F.coalesce(F.col(f"_p.crawl.{name}"), F.lit(CONFIG_DEFAULTS[name]).cast("bigint"))
        fields.append(v.alias(name))
        reason = reason.when(v < lo, F.lit(f"{name}: must be >= {lo}"))
        if hi is not None:
            reason = reason.when(v > hi, F.lit(f"{name}: must be <= {hi}"))
    return out.withColumn("mode", mode).select(
        *[c for c in df.columns if c != "mode"], "mode", *fields,
        F.coalesce(F.col("_p.crawl.respect_robots_txt"), F.lit(CONFIG_DEFAULTS["respect_robots_txt"])).alias("respect_robots_txt"),
        reason.alias("reject_reason"))
