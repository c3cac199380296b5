"""Aligned text files: one row per line, numbered over all files of the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolex.functions.text import strip
from duolex.operators.joins import join_small
from duolex.session import materialize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, text): lines in file order, files in name order, both ends stripped.

    Spark reads a large file as several byte ranges. Inside a range the generated ids are
    consecutive, so one pass counts the lines of every range into a stored table, the counts add
    up to offsets per range, and the second pass adds them. Only the table of ranges is ever
    ordered, and the text is read twice in all.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    ranges = raw.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    ranges = materialize(ranges, "line-ranges")
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = ranges.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    by_name = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(by_name), F.lit(0)).alias("_base"))
    offsets = (
        ranges.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
        .join(files, "_file")
        .select("_file", "_block", (F.col("_base") + F.col("_before") - F.col("_first")).alias("_shift"))
    )
    numbered = join_small(raw, offsets, ["_file", "_block"])
    return numbered.select((F.col("_id") + F.col("_shift")).alias("row_index"), strip("value").alias("text"))
