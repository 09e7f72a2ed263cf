"""A bounded set of hashed keys, to thin a large table out inside its scan.

``KeySet`` is a bitmap over the hashes of a table's keys, 8 to 16 bits a key
and never more than ``MOST_BITS``, so it may be broadcast whatever the table
holds.  ``possible`` keeps the rows whose bit is set: all rows with a key of
the set and a few others, which an exact join behind it drops.  A full bitmap
keeps every row and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def bits_for(keys: int, least: int = LEAST_BITS, most: int = MOST_BITS) -> int:
    """Size of the bitmap for about so many keys, a power of two."""
    return min(max(least, 1 << (8 * keys).bit_length()), most)


class KeySet:
    def __init__(self, keys: DataFrame, columns: list, bits: int):
        """The set of the hashed ``columns`` of ``keys``."""
        self.bits = bits
        self.words = keys.select(self._place(columns).alias("at")) \
            .groupBy(F.shiftright("at", 6).alias("_word")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("_set"))

    def _place(self, columns: list) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def mark(self, rows: DataFrame, columns: list, out: str) -> DataFrame:
        """``rows`` with ``out``: the key in ``columns`` may be in the set."""
        marked = rows.withColumn("_at", self._place(columns)).withColumn("_word", F.shiftright("_at", 6)) \
            .join(F.broadcast(self.words), "_word", "left")
        hit = F.expr("_set IS NOT NULL AND getbit(_set, cast(_at & 63 AS int)) = 1")
        return marked.withColumn(out, hit).drop("_at", "_word", "_set")

    def possible(self, rows: DataFrame, columns: list) -> DataFrame:
        return self.mark(rows, columns, "_hit").where("_hit").drop("_hit")
