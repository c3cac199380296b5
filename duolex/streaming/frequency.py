"""Word counts that accumulate file by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolex.operators.frequency import count_words

COUNTS = "iso string, term string, count bigint, batch bigint"


def frequency_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that stores the counts of a batch of (iso, text).

    Counts add up, so no word has to stay in streaming state: each batch writes its own
    aggregate, and a batch that runs again replaces it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        count_words(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def accumulated_frequency(spark: SparkSession, path: str) -> DataFrame:
    """(iso, term, count) over all stored batches."""
    stored = spark.read.schema(COUNTS).option("basePath", path).parquet(path)
    return stored.groupBy("iso", "term").agg(F.sum("count").alias("count"))


def stream_frequency(texts: DataFrame) -> DataFrame:
    """The same counts held in streaming state, for update or complete output."""
    return count_words(texts)
