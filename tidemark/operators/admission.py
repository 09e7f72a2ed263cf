"""Sliding-window admission (I1), batch form.

Whether a request is admitted depends on which earlier requests of its key
were, so a key is a recurrence in time order.  Two properties keep it
parallel and cheap:

* After a silence of at least the window nothing counts any more.  Keys are
  cut there into independent pieces (the cuts come from windows over
  ``(key, time bucket)`` and one summary row per bucket), and pieces, not
  keys, are dealt to tasks.  Only a key that never falls silent stays one
  sequence; it is read in sorted Arrow batches with at most ``limit``
  records of state.
* Inside a piece the walk goes from record to record: while the key is full
  every request up to the moment its oldest record leaves is refused in one
  step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default limits per day and the per-domain window.
ANONYMOUS_DAILY_LIMIT = 10
AUTHENTICATED_DAILY_LIMIT = 25
DOMAIN_WINDOW_S = 1
DAY_S = 86400


def decide(ts: np.ndarray, limits: np.ndarray, given: np.ndarray, records: list[int], window: int):
    """Decisions for the sorted requests ``ts`` of one piece.

    ``records`` holds the admitted moments that still count and is updated;
    rows marked in ``given`` were admitted before and only leave their record.
    Requests at one moment share a record.  Returns (allowed, remaining,
    moment of the next room; the last two are 0 where they don't apply).
    """
    n = len(ts)
    allowed, remaining, room_at = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    i = 0
    while i < n:
        now = int(ts[i])
        gone = int(np.searchsorted(records, now - window, "right")) if records else 0
        del records[:gone]
        free = int(limits[i]) - len(records)
        if given[i] or free > 0:
            allowed[i], remaining[i] = True, max(free - 1, 0)
            if not records or records[-1] != now:
                records.append(now)
            i += 1
        elif not records:  # a limit of nothing
            room_at[i] = now + window
            i += 1
        else:
            leaves = records[0] + window
            stop = i + int(np.searchsorted(ts[i:], leaves, "left"))
            same = np.flatnonzero((limits[i:stop] != limits[i]) | given[i:stop])
            stop = i + int(same[0]) if len(same) else stop
            room_at[i:stop] = leaves
            i = stop
    return allowed, remaining, room_at


def _walk(window: int):
    def run(batches):
        piece, records = None, []
        for pdf in batches:
            starts = pdf["_piece"].to_numpy()
            keys = pdf["_key"].to_numpy()
            new = np.flatnonzero((starts[1:] != starts[:-1]) | (keys[1:] != keys[:-1])) + 1
            parts = []
            for a, b in zip([0, *new], [*new, len(pdf)], strict=True):
                if a == b:
                    continue
                if piece != (keys[a], starts[a]):
                    piece, records = (keys[a], starts[a]), []
                parts.append(decide(pdf["_us"].to_numpy()[a:b], pdf["_limit"].to_numpy()[a:b],
                                    pdf["_given"].to_numpy()[a:b], records, window))
            if not parts:
                continue
            allowed, remaining, room_at = (np.concatenate(p) for p in zip(*parts, strict=True))
            out = pdf.drop(columns=["_piece", "_key", "_us", "_limit"])
            out["allowed"], out["remaining"] = allowed, remaining
            out["_room_us"] = pd.array(np.where(allowed, 0, room_at), dtype="Int64")
            yield out[~pdf["_given"].to_numpy()]
    return run


def _with_pieces(rows: DataFrame, window: int) -> DataFrame:
    """``_piece``: first moment of the stretch of the key without a silence of ``window``.

    Buckets are as long as the window, so the event before the first one of
    a bucket counts only if it lies in the bucket right before.
    """
    rows = rows.withColumn("_bucket", F.floor(F.col("_us") / F.lit(window)))
    summary = rows.groupBy("_key", "_bucket").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    by_key = Window.partitionBy("_key").orderBy("_bucket")
    summary = summary.withColumn("_before", F.when(F.lag("_bucket").over(by_key) == F.col("_bucket") - 1,
                                                   F.lag("_last").over(by_key)))
    # two events of one bucket are less than a window apart: only its first one can start a piece
    opens = F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= window)
    summary = summary.withColumn("_piece", F.last(F.when(opens, F.col("_first")), ignorenulls=True).over(
        by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.join(summary.select("_key", "_bucket", "_piece"), ["_key", "_bucket"]).drop("_bucket")


def admit(requests: DataFrame, limit: int = ANONYMOUS_DAILY_LIMIT, window_s: int = DAY_S,
          key: str = "key", ts: str = "ts", tie: str | None = None, limit_col: str | None = None,
          earlier: DataFrame | None = None) -> DataFrame:
    """Per request ``allowed``, ``remaining``, ``reset_at``.

    Within a key, requests are taken in ``(ts, tie)`` order.  Expiry is
    inclusive (an admitted request at ``now - window`` is gone).  A refused
    request reports 0 remaining and ``reset_at``, the oldest record plus the
    window.  ``limit_col`` gives each request its own limit.  ``earlier``
    (key, ts) are moments admitted before these requests (stream form).
    """
    window = window_s * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.withColumns({
        "_key": F.col(key), "_us": us, "_given": F.lit(False),
        "_limit": F.col(limit_col).cast("long") if limit_col else F.lit(limit).cast("long")})
    if earlier is not None:
        old = earlier.select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
                             F.lit(True).alias("_given"), F.lit(0).cast("long").alias("_limit"))
        rows = rows.unionByName(old, allowMissingColumns=True)
    cut = _with_pieces(rows, window)
    order = [F.desc("_given"), *([tie] if tie else [])]
    dealt = cut.repartition("_key", "_piece").sortWithinPartitions("_key", "_piece", "_us", *order)
    kept = [f for f in dealt.schema.fields if f.name not in ("_piece", "_key", "_us", "_limit")]
    schema = T.StructType([*kept, T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType()),
                           T.StructField("_room_us", T.LongType())])
    out = dealt.mapInPandas(_walk(window), schema)
    return out.withColumn("reset_at", F.when(~F.col("allowed"), F.timestamp_micros("_room_us"))) \
        .drop("_room_us", "_given")


def records_after(admitted: DataFrame, window_s: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, ts) of admitted moments that still count at the key's last one (at most its limit)."""
    last = admitted.groupBy(key).agg(F.max(ts).alias("_last"))
    live = F.unix_micros(F.col(ts).cast("timestamp")) > F.unix_micros(F.col("_last").cast("timestamp")) - window_s * 1_000_000
    return admitted.join(last, key).where(live).select(key, ts).distinct()
