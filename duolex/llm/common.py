"""What the operators of this folder share: the registry, inputs and row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolex.session import materialize, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Rows of a range that one task orders, when the session's partitions would be larger.
RANGE_ROWS = 500_000


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) and the SQL it must agree with."""

    def register(run):
        @wraps(run)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(ship_package(spark), sf_dir)

        QUERIES[name] = shipped
        if sql:
            SQL[name] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def ranged(df: DataFrame, *order: str, name: str = "ranged") -> DataFrame:
    """The rows cut into ranges of `order`, stored, each with the number of its range in `part`.

    Stored because the cuts are sampled: later passes must see the same ones.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    return materialize(df.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id()), name)


def before_part(stored: DataFrame, **sums: Column) -> DataFrame:
    """Per range, the sums over all earlier ranges: a row for each range, so small enough to send."""
    totals = stored.groupBy("part").agg(*[value.alias(key) for key, value in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", *[F.coalesce(F.sum(key).over(earlier), F.lit(0)).alias(key) for key in sums])


def text_blocks(texts: pd.Series, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows with about `limit` characters together, or of one longer row."""
    sizes = texts.str.len().to_numpy()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the bounds of each."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0] + [len(p) for p in parts])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends
