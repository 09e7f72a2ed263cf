"""Best-fit packing of documents into fixed-size sequences (operator 4).

Length-histogram planning: the packer never looks at documents.  It needs
only how many pieces there are of each length (at most ``capacity`` counts,
whatever the corpus holds).  Best fit runs over these counts, longest
lengths first, and moves whole groups of equal sequences at a time.  The
result is a plan of slots, ``(length, ranks from..to) -> (sequence, offset)``,
and the pieces take their slots by joining on their rank within their
length.

Ranks without a hot group: pieces of one length (a large group of copies has
one length) are first spread over hashed buckets; a piece's rank is the
number of pieces in earlier buckets of its length plus its place in its own
bucket.

A document's ids and one separator id make its stream; a stream longer than
the capacity is cut into full pieces, only its first piece may be shorter.

Defined results: a null text is the empty text (the separator alone); a null
id is kept; repeated rows are packed as often as they occur; an empty input
gives no rows.  Ties (equal lengths) are ordered by id and piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut_lineage

CAPACITY = 2048
SEPARATOR = 0
BUCKET_ROWS = 20_000  # pieces of one length in one bucket, about
LEAST_BUCKETS = 64

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a stream of ``n`` ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           separator: int = SEPARATOR, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """One row per piece: id, piece, start, length, checksum of its ids."""
    def run(batches):
        for column, rows in bpe.encoded(batches, vocabulary):
            owner, numbers, starts, lengths, sums = [], [], [], [], []
            for i, ids in enumerate(rows):
                stream = np.append(ids, np.uint32(separator)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(stream), capacity)):
                    owner.append(i)
                    numbers.append(k)
                    starts.append(s)
                    lengths.append(n)
                    sums.append(zlib.crc32(stream[s:s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [column.take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")) \
        .mapInArrow(run, f"id {kind}, {PIECE_SCHEMA}")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for the counted lengths: (length, first rank, ranks, first sequence, offset, per sequence).

    Rank ``r`` of a length goes to sequence ``first + (r - rank) // per`` at
    ``offset + (r - rank) % per * length``.  Best fit, longest first: a length
    goes to the open sequences with the least room that still holds it, as
    often as it fits there.  Open sequences with the same content are one
    group; a step splits a group in at most three, so the plan's size depends
    on the capacity, not on the counts.
    """
    groups: dict[int, list[list]] = {}  # room left -> [number of sequences, [(length, times)]]
    closed: list[list] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                fits = capacity // length
                number, content, room = (left // fits or 1), [], capacity
            else:
                fits = room // length
                number, content = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            used = min(number, left // fits)
            rest = number - used
            if used:
                _put(groups, closed, room - fits * length, used, [*content, (length, fits)])
                left -= used * fits
            if rest and left and left < fits:
                _put(groups, closed, room - left * length, 1, [*content, (length, left)])
                rest, left = rest - 1, 0
            if rest:
                _put(groups, closed, room, rest, content)
    out, next_rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for number, content in closed + [g for gs in groups.values() for g in gs]:
        offset = 0
        for length, times in content:
            out.append((length, next_rank[length], number * times, sequence, offset, times))
            next_rank[length] += number * times
            offset += length * times
        sequence += number
    return out


def _put(groups: dict, closed: list, room: int, number: int, content: list) -> None:
    if room:
        groups.setdefault(room, []).append([number, content])
    else:
        closed.append([number, content])


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rank``, from 0, within each length, without a task per length."""
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    return spread.withColumn("place", place - 1).join(bases, ["length", "bucket"]) \
        .withColumn("rank", F.col("base") + F.col("place")).drop("bucket", "place", "base")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         separator: int = SEPARATOR, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Pieces with their sequence and their place in it."""
    spark = docs.sparkSession
    cut_up = cut_lineage(pieces(docs, id_col, text_col, capacity, separator, vocabulary))
    histogram = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
                 cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity),
        "slot_length long, from_rank long, ranks long, first_sequence long, slot_offset long, per long")
    r = F.col("rank") - F.col("from_rank")
    # the plan has a few thousand rows at most, whatever the input holds
    placed = ranked(cut_up, sum(histogram.values())).join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("from_rank") + F.col("ranks")))
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(r / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(r, F.col("per")) * F.col("length")).cast("long").alias("offset"))
