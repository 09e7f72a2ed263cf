"""Exact top-k inner products by no-random-access aggregation (operator 5).

Per block of candidates every dimension has a list sorted by its value; a
query reads it from the top where its own component is positive and from the
bottom where it is negative.  All lists are read in step, a stretch at a time,
and what has been read of a row is held as its partial sum.  After each
stretch a row's upper bound counts its unread entries with the values at the
reading positions (for a row that no list has shown this is the bound of all
outsiders), its lower bound with the lists' worst values.  A row whose upper
bound is below the k-th best lower bound is out and is read no further.  A
query stops when few enough rows are left; their final scores are then
resolved.  Where the bounds never part the rows, the lists are read to their
ends and the partial sums are the scores.

The partial sums and bounds of many queries are computed together, as matrix
products of the queries' positive and negative parts with the stretch read.

Scores are integers below 2**53 in double precision, hence exact; where a
block's values could go beyond, its products use Python integers.  A score
out of the range of a long is clipped to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vector_blocks

STRETCHES = (1 / 8, 1 / 2, 7 / 8)  # shares of the lists read before a look at the bounds; then the rest
FEW = 4  # times k: so many rows may be left when the final scores are resolved
TOGETHER = 256  # queries whose bounds are held at once
LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors)


def top_inner_products(q_ids, queries, ids, rows, k):
    """For each query: (its position, positions of its k best rows, scores)."""
    q, x = quantized(queries), quantized(rows)
    own = np.searchsorted(ids, q_ids)
    own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids), own, -1)
    if x.shape[1] and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] >= 2.0 ** 53:
        yield from _by_integers(q, x, own, ids, k)
        return
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)  # ascending; read backwards from the top
    place = np.empty(x.shape, dtype=np.int32)
    np.put_along_axis(place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
    for at in range(0, len(q), TOGETHER):
        piece = np.arange(at, min(at + TOGETHER, len(q)))
        for i, rows, scores, _ in read_lists(q[piece], x, lists, place, own[piece], k):
            yield _resolved(piece[i], rows, scores, ids, k)


def read_lists(q, x, lists, place, own, k):
    """(query, rows left, their scores, share of the lists read) of every query, as they stop.

    ``place`` is the position of each entry in its ascending list.
    """
    n = len(x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    part = np.zeros((len(q), n))
    alive = np.ones((len(q), n), dtype=bool)
    alive[np.flatnonzero(own >= 0), own[own >= 0]] = False
    waiting, read = np.arange(len(q)), 0
    for share in (*STRETCHES, 1.0):
        if not len(waiting):
            return
        depth = n if n <= FEW * k else max(read, int(n * share))
        rows = np.flatnonzero(alive[waiting].any(axis=0))
        at, values = place[rows], x[rows]
        top, bottom = at >= n - depth, at < depth
        u, d = up[waiting], down[waiting]
        part[np.ix_(waiting, rows)] += u @ np.where(top & (at < n - read), values, 0).T + d @ np.where(bottom & (at >= read), values, 0).T
        read = depth
        if depth >= n:
            break
        if not depth:
            continue
        held = part[np.ix_(waiting, rows)]
        upper = held + u @ np.where(top, 0, lists[n - depth]).T + d @ np.where(bottom, 0, lists[depth - 1]).T
        lower = held + u @ np.where(top, 0, lists[0]).T + d @ np.where(bottom, 0, lists[-1]).T
        left = alive[np.ix_(waiting, rows)]
        lower[~left] = -np.inf
        bar = np.partition(lower, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
        left &= upper >= bar[:, None]
        alive[np.ix_(waiting, rows)] = left
        done = left.sum(axis=1) <= FEW * k
        for i in np.flatnonzero(done):
            few = rows[left[i]]
            yield waiting[i], few, x[few] @ q[waiting[i]], read / n
        waiting = waiting[~done]
    for w in waiting:
        rows = np.flatnonzero(alive[w])
        yield w, rows, part[w, rows], 1.0


def _resolved(query, rows, scores, ids, k):
    best = vector_blocks.top_rows(scores, ids[rows], k)
    return query, rows[best], scores[best].astype(np.int64)


def _by_integers(q, x, own, ids, k):
    whole = np.frompyfunc(int, 1, 1)(x)
    for i, row in enumerate(np.frompyfunc(int, 1, 1)(q)):
        scores = whole @ row
        rows = [r for r in sorted(range(len(x)), key=lambda r: (-scores[r], ids[r])) if r != own[i]][:k]
        yield i, np.array(rows, dtype=np.int64), np.array(
            [min(max(scores[r], LONG[0]), LONG[1]) for r in rows], dtype=np.int64)


def search(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of every query."""
    return vector_blocks.search(vector_blocks.usable(vectors, id_col, vector_col), query_every, k, "long",
                                top_inner_products)
