"""Ranked lexical search: accumulators of the short lists, documents over the long ones.

The documents stay where they are read.  A task takes them in chunks of
``CHUNK_BYTES`` of text, builds the posting lists of the asked terms over a
chunk, with every posting's share of the score worked out, and searches all
items in it before it goes on; the best ``k`` of an item so far carry over
from chunk to chunk, and their least score is the threshold.  In a chunk, for
each item:

* **term at a time**: lists shorter than ``LONG_SHARE`` of the chunk's
  documents are summed into accumulators;
* the accumulators then count as one more iterator, bounded by their
  maximum, beside the long lists;
* **document at a time**: the documents are passed in windows of
  ``WINDOW``.  A window in which the bounds of all iterators together don't
  reach the threshold is skipped.  In the others the long lists are read in
  descending order of their bounds, and a document is dropped as soon as its
  sum and the bounds of the lists still to come don't reach the threshold.

A task returns the best ``k`` of each item; ranked windows merge them, first
inside hashed parts of an item, so that no task merges all of them.

Before that, one pass counts documents, terms and document frequencies.  Only
the items' own terms travel to the tasks.  Items are taken in batches of about
``BATCH_BYTES`` of distinct terms, dealt by a hash of their id, so what is
sent is bounded however many items there are.

A term is a maximal run of characters other than the ASCII ones that are
neither digits nor letters; only A-Z are lower-cased.  A null or empty text
has no terms; such a document isn't counted and never found.  Rows of an item
id (null included) are one item with the terms of all of them; repeated
words count once.  Documents that share an id are ranked as documents of
their own; equal scores go by ascending id, null ids last.  Very long texts
are a chunk of their own.  Extra columns are left alone.  Without documents
or items the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, texts_of

TOP = 50
CHUNK_BYTES = 16 << 20
BATCH_BYTES = 16 << 20
LONG_SHARE = 1 / 16
WINDOW = 128
MERGE_PARTS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_HIT = "item long, doc long, score long"


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, as UTF-8 (bytes of other characters are all from 128 up)."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, term)."""
    folded = F.translate(items[text_col].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({TERM})"), F.lit(1)))
    return items.select(items[id_col].cast("long").alias("item"), F.explode(found).alias("term")).distinct()


def collection_counts(docs: DataFrame, index: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and documents by asked term."""
    asked, width = frozenset(index), len(index)

    def count(batches):
        frequency, n_docs, n_terms = np.zeros(width, dtype=np.int64), 0, 0
        for batch in batches:
            for text in texts_of(batch.column("text")):
                found = terms(text)
                n_docs += bool(found)
                n_terms += len(found)
                frequency[[index[t] for t in asked.intersection(set(found))]] += 1
        held = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([frequency[held], [n_docs, n_terms]]))],
            names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counted = {r.term: r.n for r in rows}
    frequency = np.zeros(width, dtype=np.int64)
    for term, n in counted.items():
        if term >= 0:
            frequency[term] = n
    return counted.get(-1, 0), counted.get(-2, 0), frequency


def term_weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()], dtype=np.int64)


class Best:
    """The best ``k`` documents of an item so far; ``least`` is the score another needs."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores = self.docs = np.empty(0, dtype=np.int64)
        self.no_id = np.empty(0, dtype=bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, no_id: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        no_id = np.concatenate([self.no_id, no_id])
        keep = np.lexsort([docs, no_id, -scores])[:self.k]
        self.scores, self.docs, self.no_id = scores[keep], docs[keep], no_id[keep]
        if len(keep) == self.k:
            self.least = max(1, int(self.scores[-1]))


class Postings:
    """Posting lists of the asked terms over one chunk of documents."""

    def __init__(self, texts: list[str], index: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int):
        get, parts, lengths = index.get, [], []
        for text in texts:
            found = terms(text)
            lengths.append(len(found))
            parts.append(np.array([t for t in map(get, found) if t is not None], dtype=np.int64))
        self.size = len(texts)
        term = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        doc = np.repeat(np.arange(self.size), [len(p) for p in parts])
        key, tf = np.unique(term * self.size + doc, return_counts=True)
        term, self.doc = np.divmod(key, max(self.size, 1))
        norm = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in lengths], dtype=np.int64)
        self.share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(index) + 1))
        self.n_windows = -(-self.size // WINDOW)
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def length(self, term: int) -> int:
        return int(self.first[term + 1] - self.first[term])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[term], self.first[term + 1])
        return self.doc[at], self.share[at]

    def windows(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest share of a long list by window, and where its windows start."""
        if term not in self._bounds:
            doc, share = self.of(term)
            starts = np.searchsorted(doc, np.arange(self.n_windows + 1) * WINDOW)
            bound = np.zeros(self.n_windows, dtype=np.int64)
            np.maximum.at(bound, doc // WINDOW, share)
            self._bounds[term] = bound, starts
        return self._bounds[term]


def search_chunk(lists: Postings, wanted: list[int], best: Best, docs: np.ndarray, no_id: np.ndarray) -> None:
    """One item over one chunk; what qualifies goes to ``best``."""
    wanted = [t for t in wanted if lists.length(t)]
    short = [t for t in wanted if lists.length(t) <= LONG_SHARE * lists.size]
    long = [t for t in wanted if lists.length(t) > LONG_SHARE * lists.size]
    sums = np.zeros(lists.n_windows * WINDOW, dtype=np.int64)
    for t in short:  # term at a time
        doc, share = lists.of(t)
        sums[doc] += share
    bounds = np.array([lists.windows(t)[0] for t in long], dtype=np.int64).reshape(len(long), lists.n_windows)
    reach = sums.reshape(lists.n_windows, WINDOW).max(axis=1, initial=0) + bounds.sum(axis=0)
    for w in np.flatnonzero(reach >= best.least).tolist():
        if reach[w] < best.least:  # the threshold has risen meanwhile
            continue
        start = w * WINDOW
        score, rest = sums[start:start + WINDOW].copy(), int(bounds[:, w].sum())
        alive = score + rest >= best.least
        for i in np.argsort(-bounds[:, w], kind="stable").tolist():
            if not alive.any():
                break
            doc, share = lists.of(long[i])
            starts = lists.windows(long[i])[1]
            at = slice(starts[w], starts[w + 1])
            place, more = doc[at] - start, share[at]
            kept = alive[place]
            score[place[kept]] += more[kept]
            rest -= int(bounds[i, w])
            alive &= score + rest >= best.least
        found = np.flatnonzero(alive & (score >= best.least))
        found = found[found + start < lists.size]
        if len(found):
            best.add(score[found], docs[start + found], no_id[start + found])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    def top(*key):
        return F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc")))

    part = F.pmod(F.xxhash64("doc"), F.lit(MERGE_PARTS))
    few = hits.withColumn("part", part).withColumn("rank", top("item", "part")).where(F.col("rank") <= k)
    return few.withColumn("rank", top("item").cast("int")).where(F.col("rank") <= k)


def _search_batch(docs: DataFrame, wanted: dict[int | None, list[str]], k: int) -> DataFrame:
    """Hits (item, doc, score) of the items of one batch."""
    asked = sorted({t for found in wanted.values() for t in found})
    index = {t.encode("utf-8", "replace"): i for i, t in enumerate(asked)}
    number = {t: i for i, t in enumerate(asked)}
    items, lists = list(wanted), [sorted(number[t] for t in found) for found in wanted.values()]
    n_docs, n_terms, frequency = collection_counts(docs, index)
    weights = term_weights(n_docs, frequency)

    def search(batches) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                ids = part.column("id")
                no_id = ids.is_null().to_numpy(zero_copy_only=False)
                own = ids.fill_null(0).to_numpy(zero_copy_only=False)
                postings = Postings(texts_of(part.column("text")), index, weights, n_docs, n_terms)
                for item, found in zip(lists, best, strict=True):
                    search_chunk(postings, item, found, own, no_id)
        for item, found in zip(items, best, strict=True):
            if len(found.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found.scores), pa.int64()), pa.array(found.docs, mask=found.no_id),
                     pa.array(found.scores)], names=["item", "doc", "score"])

    return docs.mapInArrow(search, _HIT)


def rank(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
         item_text: str = "text", k: int = TOP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    documents = docs.select(docs[doc_id].cast("long").alias("id"), docs[doc_text].cast("string").alias("text"))
    asked = item_terms(items, item_id, item_text)
    size = asked.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    hits = []
    for b in range(batches):
        wanted: dict[int | None, list[str]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b).collect():  # about batch_bytes
            wanted.setdefault(r.item, []).append(r.term)
        if wanted:
            hits.append(_search_batch(documents, wanted, k))
    found = reduce(DataFrame.union, hits) if hits else docs.sparkSession.createDataFrame([], _HIT)
    return _ranked(found, k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
