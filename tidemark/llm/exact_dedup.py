"""Exact duplicates up to the case of A-Z, by progressive refinement.

Texts are equal if they are identical after lower-casing A-Z only.  Rows
are told apart step by step, each step only among those that the step
before it left together:

1. by length in bytes, which the case of A-Z doesn't change;
2. by the hash of the first ``PREFIX_CHARS`` characters;
3. by the SHA-256 of the whole normalised text.

Two scans read the texts.  The first takes length and prefix hash, a narrow
table on which steps 1 and 2 run; the second reads the full content of the
rows whose length and prefix are shared.  Which rows those are is carried by
a ``KeySet``, a bitmap of 8 to 16 bits a row and never more than ``MOST_BITS``,
so its broadcast has a fixed bound and no text is shuffled.  A bit that two
pairs share (or a full bitmap) costs hashes that weren't needed and changes no
result.

Groups are pre-aggregated before they are exchanged.  Group sizes are written
and joined back, so that a group that holds a third of all rows can be split
by the adaptive skew join.

Null text counts as empty, so null and empty texts are one group.  Of equal
texts the row with the largest id stays; a null id is smaller than any other.
If several rows of a group have that id, exactly one of them stays.  Very
long texts are hashed whole.  Other columns, of whatever name, are left
alone.  An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyset import LEAST_BITS, MOST_BITS, KeySet, bits_for
from .common import cut_to_table

PREFIX_CHARS = 256


def normalised(text) -> F.Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _filled(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.alias("text"), *more)


def _length_and_prefix(prefix_chars: int) -> list[F.Column]:
    prefix = normalised(F.substring("text", 1, prefix_chars))
    return [F.octet_length("text").alias("n_bytes"), F.xxhash64(prefix).alias("prefix")]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS,
            digest_all: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest, and ``data`` with the carried columns.

    ``digest`` is the SHA-256 (lowercase hex) of texts that came as far as
    step 3; with ``digest_all`` it is given for all rows, which decides nothing.
    """
    sketch = cut_to_table(_filled(docs, id_col, text_col).select(*_length_and_prefix(prefix_chars)), "exact-sketch")
    bits = bits_for(sketch.count(), LEAST_BITS, MOST_BITS)

    many = F.col("n") > 1
    lengths = sketch.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).where(many)
    by_length = KeySet(lengths, ["n_bytes"], bits).possible(sketch, ["n_bytes"])
    prefixes = by_length.groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("n")).where(many)

    data = [F.struct(*(docs[c] for c in carry)).alias("data")] if carry else []
    read = _filled(docs, id_col, text_col, *data).select("*", *_length_and_prefix(prefix_chars))
    found = KeySet(prefixes, ["n_bytes", "prefix"], bits).mark(read, ["n_bytes", "prefix"], "hit")
    digest = F.when(F.col("hit") | F.lit(digest_all), F.sha2(normalised("text"), 256))
    rows = cut_to_table(
        found.select("id", "n_bytes", "hit", digest.alias("digest"), *(["data"] if carry else []),
                     F.monotonically_increasing_id().alias("row")), "exact-rows")

    groups = rows.where("hit").groupBy("n_bytes", "digest") \
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("last")).where(many)
    groups = cut_to_table(groups.select("n_bytes", "digest", "n", F.col("last.id").alias("last_id"),
                                        F.col("last.row").alias("last_row")), "exact-groups")
    alone = F.col("n").isNull()
    grouped = rows.where("hit").join(groups, ["n_bytes", "digest"], "left").select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("last_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("last_row"))).alias("kept"), "digest", *(["data"] if carry else []))
    single = rows.where(~F.col("hit")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "digest", *(["data"] if carry else []))
    return grouped.unionByName(single)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return classes(docs, id_col, text_col, carry=tuple(docs.columns)).where("kept").select("data.*")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return classes(docs, digest_all=True).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
