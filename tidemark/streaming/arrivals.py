"""Input that arrives bit by bit: file sources, and tables dealt into slices of time."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

Result = TypeVar("Result")
_SLICE = "_slice"
ROWS_A_TASK = 500_000


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Stream the files of a folder; ``files`` of them a micro-batch, else all that are new."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


class Dealt(NamedTuple):
    """A table dealt out by slices of time, and the folder that they arrive in."""
    spark: SparkSession
    folder: str
    schema: T.StructType
    slices: int
    fmt: str

    @property
    def inbox(self) -> str:
        return f"{self.folder}/inbox"

    def deliver(self, i: int) -> None:
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(_SLICE, T.IntegerType())])) \
            .parquet(f"{self.folder}/dealt").where(F.col(_SLICE) == i)
        rows.select(*self.schema.names).write.mode("append").format(self.fmt).save(self.inbox)

    def stream(self) -> DataFrame:
        return file_stream(self.spark, self.inbox, self.schema, self.fmt)


def deal(df: DataFrame, ts: str, folder: str, slices: int = 4, files: int = 4, delay_s: int = 0, tie: str | None = None,
         fmt: str = "parquet") -> Dealt:
    """Deal ``df`` out by time in one pass, each slice into several files.

    A row arrives at its time plus a delay below ``delay_s``, drawn from a
    hash of ``tie``, so that rows come out of order, across slices too.  Rows
    without a time come first.  With the format ``text`` the time isn't sent.
    A large table is dealt by more than ``files`` tasks, ``ROWS_A_TASK`` each.
    """
    delay = F.pmod(F.xxhash64(tie), F.lit(delay_s)) if delay_s and tie else F.lit(0).cast("long")
    us = F.unix_micros(F.col(ts).cast("timestamp")) + delay * 1_000_000
    low, high, n = df.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    files = max(files, -(-n // ROWS_A_TASK))
    width = max(1, -(-(high - low + 1) // slices)) if low is not None else 1
    number = F.coalesce(F.floor((us - F.lit(low or 0)) / F.lit(width)), F.lit(0)).cast("int")
    sent = df.drop(ts) if fmt == "text" else df
    sent_and_slice = sent.columns + [_SLICE]
    df.withColumn(_SLICE, number).select(*sent_and_slice).repartition(files).write.partitionBy(_SLICE).parquet(f"{folder}/dealt")
    return Dealt(df.sparkSession, folder, sent.schema, slices, fmt)


def arrive(dealt: Dealt, run: Callable[[DataFrame], Result], before: Callable[[int], None] = lambda i: None) -> Result:
    """Let slice after slice arrive and call ``run`` with the stream after each; the last result.

    ``run`` resumes from its own checkpoint, as after a restart.  ``before``
    is called with the number of the slice before it arrives.
    """
    result = None
    for i in range(dealt.slices):
        before(i)
        dealt.deliver(i)
        result = run(dealt.stream())
    return result
