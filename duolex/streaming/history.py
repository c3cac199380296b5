"""The translation log: a bounded, newest-first record set kept by a streaming sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolex.functions.text import format_ts, make_direction
from duolex.operators.filters import complete_records
from duolex.operators.ordering import HISTORY_ROWS, latest_n
from duolex.sources.tables import HISTORY_SCHEMA

STORED = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("seq", T.LongType())])


def history_records(df: DataFrame, ts: str, seq: str) -> DataFrame:
    """Log records of (source, target, source_lang, target_lang, ts), with a tie-breaking number."""
    return df.select(
        F.col("source").alias("source_text"),
        F.col("target").alias("target_text"),
        format_ts(ts).alias("timestamp"),
        make_direction("source_lang", "target_lang").alias("direction"),
        F.col(seq).cast("long").alias("seq"),
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("batch=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def load_history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Complete records of the newest finished version, or none."""
    versions = [v for v in _versions(spark, path) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], STORED)
    stored = spark.read.schema(STORED).parquet(f"{path}/batch={versions[-1]}")
    return complete_records(stored)


def history_sink(path: str, n: int = HISTORY_ROWS) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that merges a batch of `history_records` into the stored log.

    Batch b always reads the newest version before b and writes version b, so a batch that is
    run again after a failure writes the same rows in the same place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = load_history(batch.sparkSession, path, before=batch_id)
        merged = latest_n(stored.unionByName(batch), "timestamp", ["seq"], n)
        merged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
