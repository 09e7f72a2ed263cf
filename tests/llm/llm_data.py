"""Small tables with the odd cases that every operator must bear."""

import os

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "ö", "日本語のテキスト", "a" * 5000, "x y " * 4000, "1 2 3", "<p>&amp;", "\u0000﻿​"]

#: Names that the operators use inside; a table may have them too.
CLASHING = ("id", "doc", "place", "bucket", "context", "digest", "node", "root", "score", "rank", "v", "lang_pred",
            "piece", "length", "spans", "n_tokens", "held_out", "html", "sequence_id", "__doc", "__digest", "__redacted")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    from pyspark.sql import functions as F

    taken = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(f"~{c}").alias(c) for c in CLASHING if c.lower() not in taken))


def documents(spark, sf=SF):
    return spark.read.parquet(os.path.join(sf, "documents.parquet"))
