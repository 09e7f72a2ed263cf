"""Near-duplicate classes by improved consistent weighted sampling (operator 7).

Shingles are five consecutive words (runs of letters, marks and digits of any
script, in lower case; of scripts written without spaces each character is a
word); a text of fewer words is one shingle.  A shingle's weight in a text is its frequency there times an
inverse document frequency between 1 and ``1 + IDF_RANGE``.  Document
frequencies are counted over all rows in ``BUCKETS`` hashed counters, so
their table has a fixed size; the narrow range keeps a group of copies
similar however large it grows.

Sampling: each of ``BANDS * ROWS`` samples keeps the shingle (and its
quantized weight) that minimizes the consistent-weighted-sampling value; two
texts agree in a sample with the probability of their weighted Jaccard
similarity.  Texts that agree in all samples of a band share a bucket.

Verification is exact: the weighted Jaccard similarity of the full shingle
vectors must reach ``LEAST_SIMILARITY``.  Classes are the connected
components of verified links.  A bucket is not turned into all its pairs.
First its members are compared with ``PIVOTS`` pivots; pairs whose samples
agree too rarely (``LEAST_AGREEING``; chance below one in 100,000 at the least
similarity) aren't compared; in buckets of more members than that a stricter
choice (``LEAST_IN_LARGE``) does, as a second round follows.  Where such a
larger bucket still holds members of several components, those outside its
largest one are held against the members of other components, in blocks of
``BLOCK`` rows.  A block compares outlines first: weights summed in
``OUTLINE`` hashed slots, whose overlap is never below that of the vectors.
Pairs that pass this exact bound are verified in the block, the likeliest
first, and a found link joins the components at once, so a block returns the
links of a spanning forest, not all its pairs.  No two members of a bucket
stay in different classes without having been compared.

Exact copies are joined first by their digest and carried by one node.

Defined results: a null text is a class of its own; equal texts are one
class, the empty text included; a class is named by its smallest id (null
sorts first) and, as ids may repeat, by the digest of that text; every input
row is returned.
"""

from __future__ import annotations

import itertools
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_to_table, single_user_column

WORDS = 5
LEAST_SIMILARITY = 0.8
BANDS, ROWS = 14, 4
LEAST_AGREEING = 28  # of BANDS * ROWS samples
LEAST_IN_LARGE = 40  # in buckets that the second round holds against an exact bound anyway
IDF_RANGE = 0.25
IDF_STEPS = 16  # weights are kept in this part of one
MOST_UNITS = (1 << 32) - 1
BUCKETS = 1 << 16
ALL_ROWS = -1  # stands for the number of rows beside the counters
PIVOTS = 2  # of a bucket
BLOCK = 1024  # rows of a bucket in a block
OUTLINE = 1024  # slots of 8 bits
ENTRIES = 14  # bits of the tables of random numbers
PIECE = 1 << 18  # bytes of short texts worked on at a time
SEED = 7_207
FIRST_ID = -(1 << 63)

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[b for b in range(128) if chr(b).isalnum()]] = True
# Unicode ranges of Thai and Lao, Burmese, Khmer, kana and ideographs, written without spaces.
_UNSPACED = ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
             (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
             (0x1B000, 0x1B16F), (0x20000, 0x323AF))
_CODES = 0x32400  # no letters beyond
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x *= _ODD_2
    x ^= x >> np.uint64(29)
    return x


@lru_cache(maxsize=1)
def _code_kinds() -> np.ndarray:
    """Per code point: 0 between words, 1 in a word, 2 a word by itself."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(_CODES)), np.uint8, _CODES)
    for first, last in _UNSPACED:
        kinds[first:last + 1] *= 2
    return kinds


def _mark_beyond_ascii(part: np.ndarray, word: np.ndarray, cut: np.ndarray) -> None:
    """Mark the bytes of words beyond ASCII, and the cuts around words of one character."""
    start = np.flatnonzero(part >= 0xC0)
    if not len(start):
        return
    lead = part[start]
    length = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = (lead & (0x7F >> length)).astype(np.int64)
    for k in (1, 2, 3):
        more = length > k
        code[more] = code[more] << 6 | part[start[more] + k] & 0x3F
    kind = np.where(code < _CODES, _code_kinds()[np.minimum(code, _CODES - 1)], 0)
    for k in range(4):
        word[start[(length > k) & (kind > 0)] + k] = True
    alone = kind == 2
    cut[start[alone]] = True
    cut[(start + length)[alone]] = True


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = int(_ODD)
    inverse = pow(base, -1, 1 << 64)
    one = np.ones(1, dtype=np.uint64)
    up, down = (np.cumprod(np.concatenate([one, np.full(n, k, dtype=np.uint64)])) for k in (base, inverse))
    return up, down


def _pieces(offsets: np.ndarray):
    """(first, last) rows of stretches of about PIECE bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def shingles(column: pa.Array):
    """Distinct shingles of the texts of a column, piece by piece.

    Yields (first row, rows, row of each shingle, shingle as 48 bits, how
    often), sorted by row and shingle.
    """
    lower = pc.utf8_lower(column)
    if isinstance(lower, pa.ChunkedArray):
        lower = lower.combine_chunks()
    if not len(lower):
        return
    _, offsets, data = lower.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(lower.type) else np.int32)
    offsets = offsets[lower.offset:lower.offset + len(lower) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i, j in _pieces(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        row, shingle = _piece_shingles(part, at)
        key = np.sort(row.astype(np.uint64) << np.uint64(48) | shingle) if j - i < 1 << 16 else None
        if key is None:
            order = np.lexsort([shingle, row])
            row, shingle = row[order], shingle[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])])
        else:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            row, shingle = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
        if not len(row):
            yield i, j - i, row, shingle, np.zeros(0, np.int64)
            continue
        first = np.flatnonzero(new)
        yield i, j - i, row[first], shingle[first], np.diff(np.append(first, len(row)))


def _piece_shingles(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every place where a shingle begins."""
    n = len(part)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _IS_WORD[part]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    _mark_beyond_ascii(part, word, cut)
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(max(PIECE, 1 << (n - 1).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[part] * up[:n])])
    words = _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    row = np.searchsorted(at, start, "right") - 1
    count = np.bincount(row, minlength=len(at) - 1)
    rows, values = [], []
    if len(words) >= WORDS:
        whole = row[:len(row) - WORDS + 1] == row[WORDS - 1:]
        held = np.zeros(len(words) - WORDS + 1, dtype=np.uint64)
        for k in range(WORDS):
            held = _mixed(held + words[k:len(words) - WORDS + 1 + k])
        rows.append(row[:len(whole)][whole])
        values.append(held[whole])
    first = np.concatenate([[0], np.cumsum(count)])
    for r in np.flatnonzero((count > 0) & (count < WORDS)):
        held = np.zeros(1, dtype=np.uint64)
        for w in words[first[r]:first[r + 1]]:
            held = _mixed(held + w)
        rows.append(np.array([r]))
        values.append(held)
    return np.concatenate(rows), np.concatenate(values) >> np.uint64(16)


# ---- weights ---------------------------------------------------------------


def _frequency_rows(batches):
    counts, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, _, _, shingle, _ in shingles(batch.column("text")):
            counts += np.bincount((shingle % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, ALL_ROWS)), pa.array(np.append(counts[used], rows))], ["bucket", "n"])


def idf_table(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of each hashed counter, in steps of 1 / IDF_STEPS.

    The driver receives BUCKETS numbers at most.
    """
    rows = texts.select("text").mapInArrow(_frequency_rows, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = max(1, sum(r["n"] for r in rows if r["bucket"] == ALL_ROWS))
    idf = np.full(BUCKETS, 1 + IDF_RANGE)
    for r in (r for r in rows if r["bucket"] != ALL_ROWS):
        share = np.log(max(1.0, total / r["n"])) / np.log(BUCKETS)
        idf[r["bucket"]] = 1 + IDF_RANGE * min(1.0, share)
    return np.rint(idf * IDF_STEPS).astype(np.int64)


def weights(shingle: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights in steps of 1 / IDF_STEPS."""
    return times * idf[(shingle % np.uint64(BUCKETS)).astype(np.int64)]


def weighted_jaccard(a_ids, a_weights, b_ids, b_weights) -> float:
    """Similarity of two vectors with sorted ids."""
    _, i, j = np.intersect1d(a_ids, b_ids, assume_unique=True, return_indices=True)
    least = int(np.minimum(a_weights[i], b_weights[j]).sum())
    most = int(a_weights.sum()) + int(b_weights.sum()) - least
    return least / most if most else 0.0


# ---- consistent weighted samples -------------------------------------------


class Sampler:
    """Random numbers of all samples come from tables that a shingle's hash points into.

    Two shingles with one table entry tie; the smaller hash wins, in every
    text alike.
    """

    def __init__(self, idf: np.ndarray):
        rng = np.random.default_rng(SEED + 1)
        self.idf, self.n = idf, BANDS * ROWS
        shape = (self.n, 1 << ENTRIES)
        self.r, self.c = rng.gamma(2.0, 1.0, shape), np.log(rng.gamma(2.0, 1.0, shape))
        self.beta = rng.random(shape)
        self.multiplier = rng.integers(0, 1 << 63, self.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        levels = np.unique(idf)
        self.level_of = {int(w): i for i, w in enumerate(levels)}
        self.tables = [np.concatenate([self._high(k, slice(None), w) for w in levels]) for k in range(self.n)]

    def _high(self, k: int, entry, units) -> np.ndarray:
        """Sampling value of table entries at a weight, as order-keeping high 32 bits."""
        r, beta = self.r[k][entry], self.beta[k][entry]
        t = np.floor(np.log(units / IDF_STEPS) / r + beta)
        a = self.c[k][entry] - r * (t - beta) - r
        bits = a.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << np.uint64(32)

    def sign(self, rows: int, row: np.ndarray, shingle: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Samples (number, rows) of the texts; texts without a shingle get the largest number."""
        out = np.full((self.n, rows), np.iinfo(np.uint64).max, dtype=np.uint64)
        if not len(row):
            return out
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        units = weights(shingle, times, self.idf)
        often = np.flatnonzero(times > 1)
        lookup = np.zeros(int(self.idf.max()) + 1, dtype=np.int64)
        for w, i in self.level_of.items():
            lookup[w] = i
        level = lookup[np.where(times > 1, self.idf.max(), units)] << ENTRIES
        low = shingle & np.uint64((1 << 32) - 1)
        for k in range(self.n):
            entry = (shingle * self.multiplier[k] >> np.uint64(64 - ENTRIES)).astype(np.int64)
            value = self.tables[k][entry + level]
            if len(often):
                value[often] = self._high(k, entry[often], units[often])
            out[k, row[first]] = np.minimum.reduceat(value | low, first)
        return out


def _signature_rows(idf):
    def run(batches):
        sampler = Sampler(idf.value)  # made anew: quick, and a worker that goes on doesn't keep its tables
        seeds = np.arange(1, BANDS + 1, dtype=np.uint64)
        for batch in batches:
            for i, n, row, shingle, times in shingles(batch.column("text")):
                samples = sampler.sign(n, row, shingle, times)
                has = np.zeros(n, dtype=bool)
                has[row] = True
                held = np.repeat(seeds[:, None], n, axis=1)
                for k in range(ROWS):
                    held = _mixed(held + samples[k::ROWS])
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)),
                    pa.array(np.ascontiguousarray(held.T[has]).view(np.int64).ravel()))
                short = (_mixed(samples) >> np.uint64(56)).astype(np.uint8).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").slice(i, n), batch.column("doc").slice(i, n), bands,
                     pa.array([s.tobytes() for s in short], pa.binary())], ["digest", "doc", "bands", "samples"])
    return run


def _vector_rows(idf):
    def run(batches):
        for batch in batches:
            for i, n, row, shingle, times in shingles(batch.column("text")):
                ends = np.searchsorted(row, np.arange(n + 1)).tolist()
                units = np.minimum(weights(shingle, times, idf.value), MOST_UNITS).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, n),
                     pa.array([shingle[a:b].tobytes() + units[a:b].tobytes() for a, b in itertools.pairwise(ends)],
                              pa.binary())], ["node", "vector"])
    return run


def vector_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, weights) of a packed vector: 8 bytes a shingle, then 4 bytes a weight."""
    n = len(packed) // 12
    return (np.frombuffer(packed, dtype="<u8", count=n),
            np.frombuffer(packed, dtype="<u4", count=n, offset=8 * n).astype(np.int64))


def outlines(n: int, row: np.ndarray, shingle: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Weights of each text summed in hashed slots of 8 bits (beyond: the largest number)."""
    slot = (_mixed(shingle) >> np.uint64(64 - OUTLINE.bit_length() + 1)).astype(np.int64)
    sums = np.bincount(row * OUTLINE + slot, weights=units, minlength=n * OUTLINE).reshape(n, OUTLINE)
    return np.minimum(sums, 255).astype(np.uint8)


def overlap_bound(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Most that the vectors behind ``one`` and each of ``others`` can share.

    A slot at its largest number may stand for any weight.
    """
    least = np.minimum(others, one)
    bound = least.sum(axis=1, dtype=np.float64)
    bound[(least == 255).any(axis=1)] = np.inf
    return bound


class _Rows:
    """Members of one side of a block."""

    def __init__(self, table: pa.Table):
        self.node, self.root, self.bucket, self.out = (
            table.column(c).to_numpy() for c in ("node", "root", "bucket", "out"))
        self.bands = np.array(table.column("bands").to_pylist(), dtype=np.int64).reshape(-1, BANDS)
        self.vectors = [vector_of(v) for v in table.column("vector").to_pylist()]
        lengths = [len(ids) for ids, _ in self.vectors]
        ids, units = (np.concatenate([v[k] for v in self.vectors]) for k in (0, 1))
        row = np.repeat(np.arange(len(lengths)), lengths)
        self.total = np.bincount(row, weights=units, minlength=len(lengths))
        self.outline = outlines(len(lengths), row, ids, units)


def _block_links(outside: pa.Table, members: pa.Table) -> pa.Table:
    """Links of a block that join components; a pair counts in its first common bucket."""
    found: list[tuple[int, int]] = []
    if outside.num_rows and members.num_rows:
        one, two = _Rows(outside), _Rows(members)
        roots = {r: k for k, r in enumerate(np.unique(np.concatenate([one.root, two.root])).tolist())}
        left, right = (np.array([roots[r] for r in x.root.tolist()]) for x in (one, two))
        share = LEAST_SIMILARITY / (1 + LEAST_SIMILARITY)  # of both weights, for the overlap
        for i in range(len(one.node)):
            at = np.flatnonzero((right != left[i]) & (~two.out | (two.node > one.node[i])))
            first = one.bands[i][(two.bands[at] == one.bands[i]).argmax(axis=1)]
            at = at[first == one.bucket[i]]
            bound = overlap_bound(one.outline[i], two.outline[at]) / (one.total[i] + two.total[at])
            likely = np.argsort(-bound, kind="stable")
            for j in at[likely[bound[likely] >= share - 1e-9]].tolist():
                if right[j] != left[i] and weighted_jaccard(*one.vectors[i], *two.vectors[j]) >= LEAST_SIMILARITY:
                    a, b = int(one.node[i]), int(two.node[j])
                    found.append((min(a, b), max(a, b)))
                    gone, kept = right[j], left[i]
                    left[left == gone] = kept
                    right[right == gone] = kept
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                    names=["a", "b"])


def _agreeing(batches):
    """Pairs whose samples agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
                for c in ("samples", "other_samples"))
        large = batch.column("n").to_numpy() > PIVOTS + 1
        keep = (a == b).sum(axis=1) >= np.where(large, LEAST_IN_LARGE, LEAST_AGREEING)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _similar(batches):
    """Pairs whose weighted Jaccard similarity is high enough; of each batch a spanning forest."""
    for batch in batches:
        above: dict[int, int] = {}

        def root(x, above=above):
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        keep = []
        for a, b, v, w in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "vector", "other_vector")), strict=True):
            ra, rb = root(a), root(b)
            joins = ra != rb and weighted_jaccard(*vector_of(v), *vector_of(w)) >= LEAST_SIMILARITY
            if joins:
                above[ra] = rb
            keep.append(joins)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]) \
            .filter(pa.array(keep, pa.bool_()))


# ---- classes ---------------------------------------------------------------


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b): the least node of each component.

    Least labels travel along links and along labels until none changes;
    links and labels stay in Spark, the driver sees one count a round.
    """
    both = cut_to_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut_to_table(both.groupBy("a").agg(F.min("b").alias("b"))
                          .select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        least = labels.join(near, "node").select("node", F.col("root").alias("old"),
                                                 F.least("root", "seen").alias("step"))
        above = labels.select(F.col("node").alias("step"), F.col("root").alias("above"))
        moved = cut_to_table(least.join(above, "step", "left").select(
            "node", "old", F.least("step", F.coalesce("above", "step")).alias("root")), "labels")
        changed = moved.where(F.col("old") != F.col("root")).limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, digest, text of the rows that have a text."""
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(FIRST_ID)).alias("doc"),
                       F.md5(docs[text_col]).alias("digest"), docs[text_col].alias("text")) \
        .where(F.col("text").isNotNull())


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members of one bucket whose samples agree often."""
    other = right.select("bucket", F.col("node").alias("other"), F.col("samples").alias("other_samples"))
    smaller = F.col("node") < F.col("other")
    return left.join(other, "bucket").where(F.col("node") != F.col("other")).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"),
        F.when(smaller, F.col("samples")).otherwise(F.col("other_samples")).alias("samples"),
        F.when(smaller, F.col("other_samples")).otherwise(F.col("samples")).alias("other_samples"), "n") \
        .mapInArrow(_agreeing, "a long, b long").distinct()


def _verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    one = vectors.withColumnRenamed("node", "a")
    two = vectors.select(F.col("node").alias("b"), F.col("vector").alias("other_vector"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_similar, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, digest, class_doc, class_digest of every row with a text."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    idf = spark.sparkContext.broadcast(idf_table(rows))
    signed = cut_to_table(
        rows.mapInArrow(_signature_rows(idf), "digest string, doc long, bands array<long>, samples binary"), "signed")
    nodes = cut_to_table(
        signed.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"),
                                     F.first("samples").alias("samples"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    every = nodes.select("node", "samples", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = cut_to_table(every.join(shared, "bucket").withColumn("turn", F.xxhash64("node", "bucket")), "members")
    active = members.select("node").distinct().join(nodes.select("node", "digest", "doc"), "node")
    # a repeated row (same id and text) would give its vector twice
    vectors = cut_to_table(
        rows.join(active, ["digest", "doc"]).select("node", "text").mapInArrow(
            _vector_rows(idf), "node long, vector binary")
        .dropDuplicates(["node"]), "vectors")

    order = Window.partitionBy("bucket").orderBy("turn", "node")
    chosen = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    links = cut_to_table(_verified(cut_to_table(_pairs(members, chosen), "pairs"), vectors), "verified")
    labels = cut_to_table(_roots(links), "components")
    rest = _unresolved(members, labels, nodes, vectors)
    if rest.limit(1).count():
        labels = _merged(labels, cut_to_table(_block_wise(rest), "verified"))
    rooted = nodes.select("node", "digest", "doc").join(labels, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min(F.struct("doc", "digest")).alias("name"))
    named = rooted.join(named, "root").select(
        "digest", F.col("name.doc").alias("class_doc"), F.col("name.digest").alias("class_digest"))
    return signed.select("doc", "digest").join(named, "digest")


def _unresolved(members: DataFrame, labels: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Members of buckets in which the pivots left several components, with their vectors.

    In a bucket of ``PIVOTS + 1`` members or fewer all pairs have met a pivot.
    """
    rooted = members.select("bucket", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = cut_to_table(rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")), "roots")
    mixed = cut_to_table(by_root.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
        .where((F.col("n") > F.col("most")) & (F.col("n") > PIVOTS + 1)), "mixed")
    return cut_to_table(
        rooted.join(mixed, "bucket").withColumn("out", F.col("root") != F.col("main")).drop("main")
        .join(vectors, "node").join(nodes.select("node", "bands"), "node"), "unresolved")


def _block_wise(members: DataFrame) -> DataFrame:
    """Links (a, b) of members outside their bucket's main component with members of
    other components."""
    def part(rows, seed):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(rows / F.lit(BLOCK)))

    def every(rows):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(rows / F.lit(BLOCK)) - 1))

    columns = ["bucket", "node", "root", "out", "vector", "bands"]
    outside = F.col("n") - F.col("most")
    left = members.where("out").select(*columns, part(outside, 1).alias("i"), every(F.col("n")).alias("j"))
    right = members.select(*columns, every(outside).alias("i"), part(F.col("n"), 2).alias("j"))
    cell = ["bucket", "i", "j"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_block_links, "a long, b long")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the links (a, b) are added to the components so far."""
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left") \
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where(F.col("a") != F.col("b"))
    roots = _roots(lifted)
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
    moved = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    fresh = roots.join(labels.select("node"), "node", "left_anti")
    return cut_to_table(moved.union(fresh.select("node", "root")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, class_key, is_representative of every row."""
    def shown(c):
        return F.when(F.col(c) != FIRST_ID, F.col(c))

    found = classes(docs, id_col, text_col)
    own = (F.col("doc") == F.col("class_doc")) & (F.col("digest") == F.col("class_digest"))
    found = found.select(shown("doc").alias(id_col), shown("class_doc").alias("class_id"),
                         F.col("class_digest").alias("class_key"), own.alias("is_representative"))
    empty = docs.where(docs[text_col].isNull()).select(
        docs[id_col].cast("long").alias(id_col), docs[id_col].cast("long").alias("class_id"),
        F.lit(None).cast("string").alias("class_key"), F.lit(True).alias("is_representative"))
    return found.unionByName(empty)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class (all columns kept); rows without a text stay."""
    doc, digest = single_user_column(docs, "doc"), single_user_column(docs, "digest")
    chosen = classes(docs, id_col, text_col) \
        .where((F.col("doc") == F.col("class_doc")) & (F.col("digest") == F.col("class_digest"))) \
        .select(F.col("doc").alias(doc), F.col("digest").alias(digest)).distinct()
    tagged = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))) \
        .withColumn(digest, F.md5(F.col(text_col)))
    kept = tagged.join(chosen.hint("merge"), [doc, digest]).dropDuplicates([doc, digest])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(F.col(text_col).isNull()))
