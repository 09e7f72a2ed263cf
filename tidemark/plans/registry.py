"""Registered queries: name -> (spark builder, DuckDB SQL or None).

Every query reads the driver tables (or data Spark derives from them), so
its work grows with the tables.  Builders take ``(spark, sf_dir)``.
Timestamps are returned as ISO text and arrays as newline-joined text so
both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query builder (and its DuckDB SQL).

    Builders run with the session time zone pinned to UTC, so timestamp
    arithmetic and the ISO text of results do not depend on the caller's
    zone (DuckDB timestamps are zone-less).
    """
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def ts_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ts_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def lines_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c, "\n")


def derive(spark: SparkSession, sf: str, name: str, exprs, where: str | None = None) -> DataFrame:
    df = table(spark, sf, name)
    return D.apply(df.filter(where) if where else df, exprs)


def derive_sql(name: str, exprs, where: str | None = None) -> str:
    return D.sql(name, exprs, where)


# register the query groups (import side effects fill QUERIES / ORACLES)
from . import q_site  # noqa: E402,F401
from . import q_urls  # noqa: E402,F401
from . import q_discovery  # noqa: E402,F401
from . import q_pages  # noqa: E402,F401
from . import q_sections  # noqa: E402,F401
from . import q_enhance  # noqa: E402,F401
from . import q_jobs  # noqa: E402,F401
from . import q_events  # noqa: E402,F401
from . import q_runs  # noqa: E402,F401
