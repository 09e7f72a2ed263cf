"""A stored table with one row per key, of which only touched buckets are rewritten.

Keys are hashed into buckets, each a folder.  ``merge`` reads the buckets
that the new rows fall into, merges and puts these buckets in place of the
old ones (dynamic partition overwrite); all others stay as they are.  Such an
overwrite replaces a bucket only when all of its tasks are done, so it may
read the old ones, and a merge that is run again gives the same table as long
as merging the same rows twice changes nothing.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

BUCKET = "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = T.StructType.fromDDL(schema)
        self._stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that hold the keys of ``rows``; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def near(self, rows: DataFrame) -> DataFrame:
        """Stored rows of the buckets that ``rows`` fall into."""
        return self._rows().where(F.col(BUCKET).isin(self.touched(rows))).drop(BUCKET)

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> int:
        """Put ``combine(stored and new rows)`` in place of the touched buckets; how many those are."""
        rows = rows.select(*self.schema.names)
        touched = self.touched(rows)
        if not touched:
            return 0
        stored = self._rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = combine(stored.unionByName(rows)).select(*self.schema.names).withColumn(BUCKET, self.bucket())
        merged.repartition(BUCKET) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        return len(touched)
