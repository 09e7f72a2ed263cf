"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, ensure_checkpoint_dir

__all__ = ["chunks", "cut_lineage", "cut_to_table", "ensure_checkpoint_dir", "sf_table", "single_user_column", "texts_of"]


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Values of a text column; null counts as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most_bytes`` of the column ``text``.

    A slice has at least one row, so a single row longer than the bound
    travels alone.  Keeps the memory of a task bounded when a batch of
    10,000 rows holds very long texts.
    """
    import numpy as np

    n = batch.num_rows
    if n == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    start, held = 0, 0
    for i in range(n):
        if held and held + lengths[i] > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(lengths[i])
    yield batch.slice(start, n - start)


def single_user_column(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def cut_to_table(df: DataFrame, stem: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Like a checkpoint it cuts the lineage and survives the loss of
    executors, but it is stored by column and compressed.  What the query
    before it has shuffled isn't needed any more and would pile up on the
    executors' disks until the driver happens to collect its garbage, so the
    driver is asked to.  Spark holds on to the last job until the next one
    has run, hence the tiny job.
    """
    import gc

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.range(2).groupBy("id").count().collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
