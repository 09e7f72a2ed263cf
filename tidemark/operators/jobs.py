"""Job-table analytics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import shown_error
from ..sources.tables import RESULT_META_SCHEMA

# Job lifecycle.
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
PHASE_ORDER = ["pending", "discovering", "extracting", "enhancing", "generating", "completed"]
STATUSES = (*PHASE_ORDER, "failed", "cancelled")
HISTORY_COLUMNS = ["id", "url", "mode", "status", "created_at", "updated_at", "completed_at"]
HISTORY_SIZE = 50


def job_history(jobs: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """H1: each user's ``n`` newest jobs (anonymous jobs have no history)."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id"))
    return (jobs.filter(F.col("user_id").isNotNull())
            .withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= n)
            .select("user_id", "position", *HISTORY_COLUMNS))


def visible_jobs(jobs: DataFrame, callers: DataFrame) -> DataFrame:
    """H2: ``callers(request_id, job_id, caller_user_id)`` -> visibility.

    Hidden only when the job has a user, the caller has a user, and they
    differ; anonymous callers see every job.  Unknown ids are not found.
    """
    j = callers.join(jobs.select(F.col("id").alias("job_id"), F.col("user_id").alias("owner_id"),
                                 F.lit(True).alias("_exists")), "job_id", "left")
    hidden = F.col("owner_id").isNotNull() & F.col("caller_user_id").isNotNull() & \
        (F.col("owner_id") != F.col("caller_user_id"))
    return j.select("request_id", "job_id", "caller_user_id",
                    (F.coalesce(F.col("_exists"), F.lit(False)) & ~hidden).alias("visible"))


def result_meta(col: str = "result_meta") -> Column:
    return F.from_json(F.col(col), RESULT_META_SCHEMA)


def job_snapshots(jobs: DataFrame, latest_progress: DataFrame | None = None) -> DataFrame:
    """H3: status snapshot per job; the result only for completed jobs with text.

    Missing metrics read as 0; the error goes through H5.
    """
    m = result_meta()
    has_result = (F.col("status") == "completed") & (F.coalesce(F.col("result_llms_txt"), F.lit("")) != "")
    metric = lambda name: F.when(has_result, F.coalesce(m[name], F.lit(0)))
    out = jobs.select(
        "id", "status", has_result.alias("has_result"),
        F.when(has_result, F.col("result_llms_txt")).alias("llms_txt"),
        metric("total_pages").cast("bigint").alias("total_pages"),
        metric("pages_processed").cast("bigint").alias("pages_processed"),
        metric("pages_failed").cast("bigint").alias("pages_failed"),
        metric("llm_calls_made").cast("bigint").alias("llm_calls_made"),
        metric("llm_cost_usd").cast("double").alias("llm_cost_usd"),
        shown_error(F.col("error_message")).alias("error"))
    if latest_progress is not None:
        p = latest_progress.select(F.col("job_id").alias("id"), F.col("phase").alias("progress_phase"),
                                   F.col("message").alias("progress_message"))
        out = out.join(p, "id", "left")
    return out


def rename_mode(jobs: DataFrame, mapping: dict | None = None) -> DataFrame:
    """H7: value migration of ``mode`` (default: quick -> default)."""
    mapping = mapping or {"quick": "default"}
    expr = F.col("mode")
    for old, new in mapping.items():
        expr = F.when(F.col("mode") == old, F.lit(new)).otherwise(expr)
    return jobs.withColumn("mode", expr)


def latest_jobs(updates: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """H8: latest update wins per job id (ties broken by the remaining columns)."""
    cols = [c for c in updates.columns if c != key]
    agg = updates.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order]))
                                   .alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def progress_pct(phase) -> Column:
    """H9: index in the six phases x 20 (unknown, failed, cancelled -> 0)."""
    p = F.col(phase) if isinstance(phase, str) else phase
    idx = F.array_position(F.array(*[F.lit(x) for x in PHASE_ORDER]), p) - 1
    idx = F.when(idx < 0, F.lit(0)).otherwise(idx)
    return F.least(idx * F.lit(100.0) / F.lit(len(PHASE_ORDER) - 1), F.lit(100.0))


def is_waiting(status, progress) -> Column:
    return (F.col(status) == "pending") & F.col(progress).isNull()


def _camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def _snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m.group(0).lower(), name)


def _rename(dt: T.DataType, fn) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(fn(f.name), _rename(f.dataType, fn), f.nullable) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_rename(dt.elementType, fn), dt.containsNull)
    if isinstance(dt, T.MapType):
        return T.MapType(dt.keyType, _rename(dt.valueType, fn), dt.valueContainsNull)
    return dt


def convert_keys(df: DataFrame, style: str = "camel") -> DataFrame:
    """Snake <-> camel case on every (nested) field name.

    The new schema is computed once on the driver; each column is a single
    cast to the renamed type (struct casts match fields by position), so
    no per-row code runs.
    """
    fn = _camel if style == "camel" else _snake
    cols = []
    for f in df.schema.fields:
        new_t = _rename(f.dataType, fn)
        c = F.col(f"`{f.name}`")
        cols.append((c.cast(new_t) if new_t != f.dataType else c).alias(fn(f.name)))
    return df.select(*cols)


def job_counts(jobs: DataFrame, keys=("mode", "status")) -> DataFrame:
    """Job counts by the given keys (map-side partial aggregation)."""
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_jobs"))
