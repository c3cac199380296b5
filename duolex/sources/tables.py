"""Directories of tables, JSON arrays and the result sinks."""

from __future__ import annotations

import logging
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolex.session import materialize

log = logging.getLogger(__name__)

LANGUAGE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "code", "iso_code")])
HISTORY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source_text", "target_text", "timestamp", "direction")]
)
TAGGED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "target", "source_lang", "target_lang")]
)
INDEX_COLUMN = "__index_level_0__"
# Splits that a task writes side by side; with more of them it sorts the rest by split.
OPEN_FILES_KEY, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 8
# What Spark says of a file that is no Parquet; any other error, such as a refused access, is raised.
UNREADABLE = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA")


def _parquet_files(spark: SparkSession, path: str) -> list[str]:
    """Parquet files and partition folders of a folder, in name order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    entries = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(e.toString() for e in entries if e.getName().endswith(".parquet") or "=" in e.getName())


def read_dir(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every Parquet entry of a folder that can be read, with the wanted columns it has.

    An entry whose footer cannot be read is logged and skipped, and so is one with none of the
    columns. Entries with one schema are scanned together; a column an entry lacks is null.
    """
    groups: dict[tuple, list[str]] = defaultdict(list)
    for entry in _parquet_files(spark, path):
        try:
            found = spark.read.parquet(entry).schema
        except Exception as error:  # noqa: BLE001 - told apart by what it says
            if not any(sign in str(error) for sign in UNREADABLE):
                raise
            log.warning("skipped %s: %s", entry, str(error).splitlines()[0])
            continue
        kept = tuple((f.name, f.dataType.simpleString()) for f in found if f.name in columns)
        if kept:
            groups[kept].append(entry)
        else:
            log.warning("skipped %s: none of %s", entry, columns)
    if not groups:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    frames = [
        spark.read.option("ignoreCorruptFiles", True).parquet(*entries).select(*[name for name, _ in kept])
        for kept, entries in groups.items()
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*[c if c in merged.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Train and test rows of `write_splits`, without a stray index column."""
    return spark.read.parquet(path).drop(INDEX_COLUMN)


def write_splits(df: DataFrame, path: str, in_order: bool = False) -> None:
    """One folder per split. Rows with a `position` lie in its order inside each file.

    Rows that come `in_order` of their position go to files kept open side by side; sorted by split
    as well, whole texts would be held, or spilled, a second time.
    """
    spark = df.sparkSession
    if "position" in df.columns and not in_order:
        # The writer sorts by split where rows don't come so, and may lose the order within it.
        df = df.sortWithinPartitions("split", "position")
    before = spark.conf.get(OPEN_FILES_KEY, "0")
    spark.conf.set(OPEN_FILES_KEY, str(OPEN_FILES) if in_order else before)
    try:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)
    finally:
        spark.conf.set(OPEN_FILES_KEY, before)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An array of objects. A missing or unreadable file gives no rows."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], schema)
    corrupt = "_corrupt"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    rows = (
        spark.read.schema(wide)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .json(path)
    )
    # A query that prunes all other columns may not read the marker, so the rows are parsed once.
    parsed = materialize(rows, "json")
    return parsed.filter(F.col(corrupt).isNull()).select(*schema.fieldNames())


def write_dictionary(df: DataFrame, path: str) -> None:
    """(iso, term, count) as one folder per language, most frequent first.

    Ranges of the order itself are the partitions, so a large language is many files, in name
    order, and none is larger than its neighbours.
    """
    order = ["iso", F.desc("count"), "term"]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").option("compression", "snappy").partitionBy("iso").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("iso", T.StringType()),
        ]
    )
    return spark.read.schema(schema).parquet(path).select("iso", "term", "count")


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
