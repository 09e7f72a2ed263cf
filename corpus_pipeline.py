"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is
written as Parquet to the shared folder and read again as the next stage's
``docs``:

1. ``language_id``: documents of which no language can be identified go (null,
   without a letter, or without a word or letter that the model knows).
2. ``near_dedup``: one document of each group of near duplicates stays.
3. ``suffix_dedup``: passages of 100 bytes and more that occur earlier in the
   corpus are cut out of the texts.
4. ``pii``: personal data is replaced by the name of its kind.
5. ``packing``: the texts are packed into sequences of at most 2048 tokens;
   one row per piece.

All but the last return the columns of ``docs``, whatever they are; where
there is a column ``n_chars`` it follows the text.  A null text has no
language and goes in the first stage; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language_id, near_dedup, packing, pii, suffix_dedup
from tidemark.llm.common import cut_to_table, sf_table


def _size_column(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs), by_evidence=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs, size_col=_size_column(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, size_col=_size_column(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models, sampling and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = sf_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_to_table(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
