"""Approximate nearest neighbours by collision-counting hashing (operator 10).

Index: every row of a block is projected on ``PROJECTIONS`` random
directions (vectors scaled to length one, so that cosine and distance agree),
and each projection is kept as one sorted array.  A query opens a window
around its own projection in every array.  Widening the windows is virtual
rehashing: radius R means half a width of ``HALF_WIDTH * R``, and only the
newly covered stretches of the arrays are read.  A row that falls into the
windows of ``THRESHOLD`` or more arrays is verified with its original vector.
The search of a block ends once its k-th best verified row is no farther than
R, or all rows are verified.

At distance R a row collides in an array with probability 0.83, so it passes
the threshold of 20 of 32 with probability above 0.99; rows at distance 2 R
pass with probability 0.1.

Scores are exact cosines, in double precision, of original vectors.  Zero
vectors take no part.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_blocks

PROJECTIONS = 32
THRESHOLD = 20
HALF_WIDTH = 1.36
FIRST_RADIUS = 0.25
GROWTH = 1.25
SEED = 20_260


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row; the same row always gives the same number."""
    dot = (rows * q).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def _tame(vectors: np.ndarray) -> np.ndarray:
    """Very large or small vectors scaled by a power of two, which leaves cosines as they are."""
    most = np.abs(vectors).max(axis=1)
    far = (most > 2.0 ** 100) | (most < 2.0 ** -100)
    if far.any():
        vectors = vectors.copy()
        vectors[far] = np.ldexp(vectors[far], -np.frexp(most[far])[1][:, None])
    return vectors


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def nearest_in_block(q_ids, queries, ids, rows, k):
    """For each query: (its position, positions of the nearest rows found, cosines)."""
    queries, rows = _tame(queries), _tame(rows)
    axes = np.random.default_rng(SEED).standard_normal((rows.shape[1], PROJECTIONS))
    projected = (_unit(rows) @ axes).T
    order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(projected, order, axis=1)
    centres = (_unit(queries) @ axes).T
    n = len(rows)
    radii = [FIRST_RADIUS * GROWTH ** s for s in range(1 + int(np.ceil(np.log(2 / FIRST_RADIUS) / np.log(GROWTH))))]
    low = np.empty((len(radii), PROJECTIONS, len(queries)), dtype=np.int64)
    high = np.empty_like(low)
    for s, radius in enumerate(radii):
        for p in range(PROJECTIONS):
            low[s, p] = np.searchsorted(arrays[p], centres[p] - HALF_WIDTH * radius, "left")
            high[s, p] = np.searchsorted(arrays[p], centres[p] + HALF_WIDTH * radius, "right")
    for i, q in enumerate(queries):
        counts = np.zeros(n, dtype=np.int64)
        verified = np.zeros(n, dtype=bool)
        own = np.searchsorted(ids, q_ids[i])
        if own < n and ids[own] == q_ids[i]:
            verified[own] = True  # its own row is no candidate
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for s, radius in enumerate(radii):
            read = []
            for p in range(PROJECTIONS):
                a, b = low[s, p, i], high[s, p, i]
                if s:
                    read += [order[p, a:low[s - 1, p, i]], order[p, high[s - 1, p, i]:b]]
                else:
                    read.append(order[p, a:b])
            counts += np.bincount(np.concatenate(read), minlength=n)
            fresh = np.flatnonzero((counts >= THRESHOLD) & ~verified)
            if len(fresh):
                verified[fresh] = True
                found = np.concatenate([found, fresh])
                scores = np.concatenate([scores, cosines(q, rows[fresh])])
                best = vector_blocks.top_rows(scores, ids[found], k)
                found, scores = found[best], scores[best]
            # distance of unit vectors: square of it is 2 - 2 cosine
            if len(found) >= k and 2 - 2 * scores[-1] <= radius * radius:
                break
        if len(found) < k:  # fewer than k rows ever met the threshold: take the rest of the block as it is
            rest = np.flatnonzero(~verified)
            found = np.concatenate([found, rest])
            scores = np.concatenate([scores, cosines(q, rows[rest])])
            best = vector_blocks.top_rows(scores, ids[found], k)
            found, scores = found[best], scores[best]
        yield i, found, scores


def search(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found for every query."""
    usable = vector_blocks.usable(vectors, id_col, vector_col) \
        .where(F.exists("v", lambda x: x != 0.0))
    return vector_blocks.search(usable, query_every, k, "double", nearest_in_block)
