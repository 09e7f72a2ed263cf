"""A stated query set against all vectors, in blocks (for operators 5 and 10).

Candidates are dealt into blocks by a hash of their id and queries into
blocks of their own; one task handles one pair of blocks, so its memory is
bounded whatever the table holds, and no id, value or label is hot.  A task
returns the best few of its block for each of its queries; a ranked window
merges them.

Rows without an id or a vector, or whose vector holds null or non-finite
components, take no part.  Vectors of another length than the query's are no
candidates of it.  Rows that repeat an id count once (the smallest vector of
the id); they are the query's own if the query has that id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 2048


def finite(vector) -> F.Column:
    return F.forall(vector, lambda x: F.coalesce(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & v.isNotNull() & finite(v))


def search(vectors: DataFrame, query_every: int, k: int, kind: str, per_block: Callable) -> DataFrame:
    """Best ``k`` of all usable ``vectors`` (id, v) for each id divisible by ``query_every``.

    ``per_block(query ids, queries, ids, candidates, k)`` yields
    ``(query position, candidate positions, scores)``; both matrices are
    float64 and in order of id.
    """
    is_query = F.col("id") % query_every == 0
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))

    def part(number: int, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(number))

    def every(number: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))

    left = vectors.where(is_query).select("id", "v", part(query_blocks, 1).alias("qb"), every(blocks).alias("cb"))
    right = vectors.select("id", "v", every(query_blocks).alias("qb"), part(blocks, 2).alias("cb"))
    value = pa.int64() if kind == "long" else pa.float64()
    names = ["query_id", "vec_id", "score"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", value)])

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        outs: list[list] = [[], [], []]
        for width, q_ids, q in _by_width(queries):
            for other, c_ids, c in _by_width(candidates):
                if other != width:
                    continue
                for i, at, scores in per_block(q_ids, q, c_ids, c, k):
                    outs[0].append(np.full(len(at), q_ids[i]))
                    outs[1].append(c_ids[at])
                    outs[2].append(scores)
        if not outs[0]:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(o), t) for o, t in zip(outs, schema.types, strict=True)], names=names)

    best = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")) \
        .applyInArrow(cell, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _by_width(rows: pa.Table):
    """(vector length, ids, matrix) of the rows, ids ascending and unique."""
    if not rows.num_rows:
        return
    ids = rows.column("id").to_numpy()
    vectors = rows.column("v").combine_chunks()
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        matrix, own = flat.reshape(len(at), width), ids[at]
        order = np.lexsort([*matrix.T[::-1], own]) if len(np.unique(own)) < len(own) else np.argsort(own)
        own, matrix = own[order], matrix[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        yield width, own[first], np.ascontiguousarray(matrix[first])


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort([ids[keep], -scores[keep]])[:k]]
