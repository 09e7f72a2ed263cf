"""Exact substring dedup by bucket-pointer refinement (operator 9).

Every byte covered by a 100-byte string that also starts earlier in the
corpus (smaller id, or same document and earlier start) is removed.

Bucket identifiers.  Positions are bucketed by their 8 bytes; a bucket is
refined by the bucket identifiers of later offsets, and the refined
identifiers are used again for the next refinement:
``b16[p] = (b8[p], b8[p+8])``, ``b32[p] = (b16[p], b16[p+16])``,
``b64``, ``b100``.  Identifiers are hashes of their two parts, so all tasks
agree on them without an exchange and no suffix array is held anywhere.

Sparse positions.  Of the 69 b32 buckets inside a 100-byte string the one
with the least identifier (leftmost of equals) is its anchor.  Equal strings
have equal anchors at equal offsets, so only anchors (about one position in
35) are exchanged.  An anchor stands for the run of strings that share it;
its context identifier is refined from the b100 of the first and last string
of the run.

1. Anchors are counted by bucket (partial sums before the shuffle); only
   buckets that occur twice go on.
2. Classes: anchors of one bucket and one context.  All strings of an anchor
   that isn't the first of its class start earlier too.
3. Only a bucket with several contexts (the edge of a shared passage) is
   refined further, on the first anchor of each class alone.  Its strings fall
   into four ranges by their distance to the anchor.  All strings of a range
   hold one stretch of 83 bytes: the next bucket, with the bytes of the whole
   range as its context, and the same rule as in step 2.
4. The ranges that are firsts of a stretch with several contexts give their
   strings, with two independent b100 identifiers (128 bits); all but the
   first of equal strings are removed.

Hot buckets (a passage in a third of all documents) are pre-aggregated and
then joined, so adaptive skew splitting applies; no bucket is collected.

Defined results: a null text is empty; a null id sorts first; rows with the
same id and text are the same document (neither is earlier); rows with the
same id and different texts are ordered by a hash of the text; texts under
100 bytes stay as they are; other columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_to_table, single_user_column

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
RANGE = 18
PIECE = 1 << 18  # bytes worked on at a time
POSITION_BITS = np.uint64(20)
FIRST_ID = -(1 << 63)
TEXT_BITS, START_BITS, RUN_BITS = 25, 31, 7  # of a place: hash of the text, start, strings of the run less one

# Odd multipliers of the two independent chains of identifiers.
CHAINS = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _refine(a: np.ndarray, b: np.ndarray, chain: int) -> np.ndarray:
    """Identifier of the pair of buckets (a, b)."""
    first, second = (np.uint64(k) for k in CHAINS[chain])
    out = a * first
    out ^= out >> np.uint64(31)
    out += b
    out *= second
    out ^= out >> np.uint64(29)
    return out


def buckets(data: np.ndarray, chain: int = 0) -> np.ndarray:
    """b32 of every position of ``data`` that has 32 bytes."""
    b8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    b16 = _refine(b8[:-8], b8[8:], chain)
    return _refine(b16[:-16], b16[16:], chain)


def strings(b32: np.ndarray, at: np.ndarray, chain: int = 0) -> np.ndarray:
    """b100 of the positions ``at``."""
    return _refine(_b64(b32, at, chain), _b64(b32, at + LENGTH - 64, chain), chain)


def _b64(b32: np.ndarray, at: np.ndarray, chain: int) -> np.ndarray:
    return _refine(b32[at], b32[at + 32], chain)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least value of each stretch of ``span``."""
    width, out = 1, values
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(out) - (span - width)], out[span - width:]) if span > width else out


def _pieces(offsets: np.ndarray):
    """(first byte, last byte, first and last document) of pieces of a text buffer.

    Short documents share a piece; a longer one is cut into pieces that
    overlap by 99 bytes, which only splits the run of an anchor.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1
        if j > i:
            yield int(offsets[i]), int(offsets[j]), i, j
            i = j
            continue
        for s in range(int(offsets[i]), int(offsets[i + 1]) - LENGTH + 1, PIECE):
            yield s, min(s + PIECE + LENGTH - 1, int(offsets[i + 1])), i, i + 1
        i += 1


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of the documents ``data[offsets[i]:offsets[i + 1]]``.

    Yields, piece by piece, (b32 of the piece, its first byte, document, start
    of the first string, strings of the run, place of the anchor, context);
    the last five are arrays, places count from the first byte of the piece.
    """
    for low, high, i, j in _pieces(offsets):
        if high - low < LENGTH:
            continue
        part = data[low:high]
        b32 = buckets(part)
        key = b32 >> POSITION_BITS << POSITION_BITS
        key |= np.arange(len(b32), dtype=np.uint64)
        least = _least(key, SPAN)  # for each string: its anchor's bucket (rounded) and place
        first = np.maximum(offsets[i:j] - low, 0)
        stop = np.minimum(offsets[i + 1:j + 1] - low - LENGTH + 1, len(least))
        fits = stop > first
        if not fits.any():
            continue
        inside = np.zeros(len(least) + 1, dtype=np.int8)
        inside[first[fits]] += 1
        inside[stop[fits]] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        edge = np.ones(len(least) + 1, dtype=bool)
        edge[1:-1] = least[1:] != least[:-1]
        edge[first[fits]] = edge[stop[fits]] = True
        places = np.flatnonzero(edge)
        run = np.diff(places)
        start = places[:-1]
        keep = inside[start]
        start, run = start[keep], run[keep]
        anchor = (least[start] & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
        last = start + run - 1
        shape = (run * 128 + anchor - start).astype(np.uint64)
        context = _refine(strings(b32, start), strings(b32, last) + shape, 0)
        owner = i + np.searchsorted(first, start, "right") - 1
        yield b32, low, owner, start, run, anchor, context


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _place(text_hash, start, run):
    return text_hash << (START_BITS + RUN_BITS) | start << RUN_BITS | (run - 1)


def _bucket_counts(batches):
    for batch in batches:
        for b32, _, _, _, _, anchor, _ in anchors(*_text_buffer(batch.column("text"))):
            values, n = np.unique(b32[anchor].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["bucket", "n"])


def _rows(bucket, context, doc, place):
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(place)],
        ["bucket", "context", "doc", "place"])


def _anchor_rows(batches):
    for batch in batches:
        doc, text_hash = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
        data, offsets = _text_buffer(batch.column("text"))
        for b32, low, owner, start, run, anchor, context in anchors(data, offsets):
            yield _rows(b32[anchor], context, doc[owner],
                        _place(text_hash[owner], start + low - offsets[owner], run))


def _wanted(batch: pa.RecordBatch, offsets: np.ndarray):
    """(document, first byte, strings) of the places of a batch, by first byte."""
    places = batch.column("places")
    owner = np.repeat(np.arange(len(places)), np.diff(np.asarray(places.offsets)))
    place = places.flatten().to_numpy()
    at = offsets[owner] + (place >> RUN_BITS & (1 << START_BITS) - 1)
    order = np.argsort(at)
    return owner[order], at[order], ((place & (1 << RUN_BITS) - 1) + 1)[order]


def _range_rows(batches):
    """Ranges of the anchors whose runs begin at the given places."""
    for batch in batches:
        doc, text_hash = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
        data, offsets = _text_buffer(batch.column("text"))
        _, wanted, _ = _wanted(batch, offsets)
        for b32, low, owner, start, run, anchor, _ in anchors(data, offsets):
            mine = np.isin(start + low, wanted)
            owner, start, run, anchor = owner[mine], start[mine], run[mine], anchor[mine]
            far, near = anchor - start, anchor - start - run + 1  # distance of the first and the last string
            for j in range(-(-SPAN // RANGE)):
                most, least = np.minimum(far, RANGE * j + RANGE - 1), np.maximum(near, RANGE * j)
                has = np.flatnonzero(most >= least)
                at = anchor[has] - RANGE * j
                stretch = _refine(_b64(b32, at, 0), _b64(b32, at + LENGTH - RANGE + 1 - 64, 0) + np.uint64(j), 0)
                first, last = anchor[has] - most[has], anchor[has] - least[has]
                n = last - first + 1
                shape = (n * 128 + most[has]).astype(np.uint64)
                context = _refine(strings(b32, first), strings(b32, last) + shape, 0)
                yield _rows(stretch, context, doc[owner[has]],
                            _place(text_hash[owner[has]], first + low - offsets[owner[has]], n))


def _string_rows(batches):
    """Every string of the given places, with two independent identifiers."""
    for batch in batches:
        doc, text_hash = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
        data, offsets = _text_buffer(batch.column("text"))
        owner, at, run = _wanted(batch, offsets)
        ends = np.cumsum(run)
        at = np.repeat(at - (ends - run), run) + np.arange(ends[-1] if len(ends) else 0)
        owner = np.repeat(owner, run)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        for low, high, _, _ in _pieces(offsets):
            a, b = np.searchsorted(at, [low, high - LENGTH + 1])
            if a < b:
                part, who = data[low:high], owner[a:b]
                one, two = (strings(buckets(part, chain), at[a:b] - low, chain) for chain in (0, 1))
                yield _rows(one, two, doc[who], _place(text_hash[who], at[a:b] - offsets[who], 1))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash, text without nulls; (doc, text_hash) names a document."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(FIRST_ID)).alias("doc"),
        F.xxhash64(text).bitwiseAND((1 << TEXT_BITS) - 1).alias("text_hash"), text.alias("text"))


def removed_stretches(docs: DataFrame) -> DataFrame:
    """doc, text_hash, starts and ends of removed stretches (they may overlap) of ``keyed`` rows."""
    scanned = docs.select("doc", "text_hash", "text")
    schema = "bucket long, context long, doc long, place long"
    seen_twice = cut_to_table(
        docs.select("text").mapInArrow(_bucket_counts, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("bucket"), "twice")
    rows = cut_to_table(
        scanned.mapInArrow(_anchor_rows, schema).join(seen_twice.hint("merge"), "bucket"), "anchors")
    classes = _classes(rows)
    removed = _not_first(rows, classes)
    for name, deal in (("ranges", _range_rows), ("strings", _string_rows)):
        rows = cut_to_table(scanned.join(_edges(classes).hint("merge"), ["doc", "text_hash"])
                            .mapInArrow(deal, schema), name)
        classes = _classes(rows)
        removed = removed.unionByName(_not_first(rows, classes))
    return cut_to_table(_by_text(removed), "removed")


def _classes(rows: DataFrame) -> DataFrame:
    """First place and number of members of every class.

    Written, so that both sides of the joins below are plain exchanges and
    a hot bucket can be split between tasks.
    """
    return cut_to_table(rows.groupBy("bucket", "context").agg(
        F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("members")), "classes")


def _not_first(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """doc, place of the rows that aren't the first of their class."""
    found = classes.where(F.col("members") > 1).select("bucket", "context", "first")
    return rows.join(found.hint("merge"), ["bucket", "context"]) \
        .where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place"))).select("doc", "place")


def _edges(classes: DataFrame) -> DataFrame:
    """Firsts of the classes whose bucket has several contexts, by text."""
    several = cut_to_table(classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("contexts"))
                           .where(F.col("contexts") > 1).select("bucket"), "several")
    return _by_text(classes.join(several.hint("merge"), "bucket").select("first.*"))


def _by_text(rows: DataFrame) -> DataFrame:
    """doc, text_hash and its places; their number is bounded by the length of the text."""
    return rows.select("doc", _text_hash("place"), "place") \
        .groupBy("doc", "text_hash").agg(F.collect_list("place").alias("places"))


def _text_hash(place: str) -> F.Column:
    return F.shiftrightunsigned(F.col(place), START_BITS + RUN_BITS).alias("text_hash")


def spans(places: np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) of packed places."""
    if places is None or not len(places):
        return []
    places = np.sort(np.asarray(places, dtype=np.int64))
    start = places >> RUN_BITS & (1 << START_BITS) - 1
    end = np.maximum.accumulate(start + (places & (1 << RUN_BITS) - 1) + LENGTH)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), end[last].tolist(), strict=True))


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in removed:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, bytes, removed bytes, removed runs and digest of what is left, of every row."""
    def run(batches):
        for batch in batches:
            rows = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                raw, removed = text.encode(), spans(places)
                rows.append((len(raw), sum(e - s for s, e in removed), len(removed),
                             hashlib.sha256(kept_bytes(raw, removed)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, t) for c, t in zip(
                    columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(docs, id_col, text_col)
    joined = rows.join(removed_stretches(rows).hint("merge"), ["doc", "text_hash"], "left")
    return joined.select("doc", "text", "places") \
        .mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string") \
        .withColumn("doc", F.when(F.col("doc") != FIRST_ID, F.col("doc"))).withColumnRenamed("doc", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The input with removed bytes taken out of ``text_col``.

    Bytes of a character that was cut in two are dropped with it; a null text
    stays null; ``size_col`` (if given) becomes the new number of code points.
    """
    doc, text_hash, places, new = (single_user_column(docs, c) for c in ("doc", "text_hash", "places", "kept"))

    def run(text, removed):
        import pandas as pd

        return pd.Series([None if t is None else kept_bytes(t.encode(), spans(p)).decode("utf-8", "ignore")
                          for t, p in zip(text, removed, strict=True)], dtype="object")

    rows = keyed(docs, id_col, text_col)
    found = removed_stretches(rows).select(
        F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("places").alias(places))
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))) \
        .withColumn(text_hash, F.xxhash64(text).bitwiseAND((1 << TEXT_BITS) - 1))
    kept = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)
    joined = tagged.join(found.hint("merge"), [doc, text_hash], "left").withColumn(new, kept(text_col, places))
    out = {text_col: F.col(new)} | ({size_col: F.length(new).cast(docs.schema[size_col].dataType)} if size_col else {})
    return joined.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns))
