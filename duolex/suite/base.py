"""Query registry, shared inputs and shared SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duolex.operators.datasets import union_datasets
from duolex.operators.indexing import ID_BITS, position_by_id
from duolex.operators.joins import join_null_safe, zip_rows
from duolex.session import materialize, scratch_path, ship_package

# A block of more rows is not looked through for each of its rows.
BLOCK_ROWS = 1024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
PAIRED = (("en", "de"), ("es", "fr"))
LANGUAGES = ("de", "en", "es", "fr")
# The fourth language of the texts is left out on purpose: its rows must be dropped.
NAMED = {"English": "en", "German": "de", "Spanish": "es"}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) and the SQL it must agree with."""

    def register(run):
        @wraps(run)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(ship_package(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = shipped
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over the cores if it has fewer files than there are cores.

    The test tables are one row group each, which one task would read and work on alone. A
    table of many files is left as it is scanned.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_KEYS and len(df.inputFiles()) < cores:
        return df.repartition(cores, TEXT_KEYS[name])
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, source, target, source_lang, target_lang, dataset, ordinal): every document
    with the next one by id, the last with the first; a data set for each source language.

    Stored, as pairs are at rest before anything is done with them.
    """
    return materialize(pairs_once(spark, sf_dir), "pairs")


def pairs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pairs` for a job that reads them a single time: they are made as it goes and not stored.

    Texts move once, to be numbered, and are stored in the files of the blocks of ids they are
    numbered in. There a row meets the next one without another shuffle; only the rows at the ends
    of blocks, and those without an id, move again to meet across blocks.
    """
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    numbered = position_by_id(docs, "doc_id").select(
        F.lit(0).alias("zone"), F.shiftright(F.col("doc_id").cast("long"), ID_BITS).alias("block"), "row_index", "lang", "text"
    )
    # The rows come as numbering deals them, which is how buckets of its columns are dealt.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = f"placed_{uuid.uuid4().hex}"
    writer = numbered.write.bucketBy(buckets, "zone", "block").format("parquet").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "placed")).saveAsTable(stored)
    placed = spark.table(stored)
    rows = placed.count()

    inside = ["zone", "block"]
    at = F.col("row_index")
    blocks = placed.groupBy(*inside).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
    # A block of many rows, as an id that repeats or is null makes it, is not looked through for each of them.
    few = (F.col("rows") <= BLOCK_ROWS) & F.col("block").isNotNull()
    large = materialize(blocks.withColumn("few", few), "blocks")
    met = join_null_safe(placed, large, inside)
    loose = ~F.col("few")
    marked = met.withColumns({"first": loose | (F.col("first") == at), "last": loose | (F.col("last") == at)})
    ends = materialize(marked.filter("first OR last").drop("rows"), "ends")
    calm = placed
    if not large.filter(loose & F.col("block").isNotNull()).isEmpty():
        calm = join_null_safe(placed, large.filter("few"), inside, "left_semi")

    def sources(frame: DataFrame, lang: str) -> DataFrame:
        return frame.filter(F.col("lang") == lang).withColumnsRenamed({"text": "source", "lang": "source_lang"})

    def targets(frame: DataFrame, before: Column) -> DataFrame:
        return frame.withColumns({"row_index": before}).withColumnsRenamed({"text": "target", "lang": "target_lang"})

    before = F.col("row_index") - 1
    following = targets(calm, before)
    # The last row meets the first.
    across = targets(ends.filter("first"), F.pmod(before, F.lit(max(rows, 1)))).select("row_index", "target", "target_lang")
    made = ["row_index", "source", "target", "source_lang", "target_lang"]

    def zipped(lang: str) -> DataFrame:
        near = zip_rows(sources(calm, lang), following, within=inside).select(*made)
        return near.unionByName(zip_rows(sources(ends.filter("last"), lang), across).select(*made))

    return union_datasets([(a, zipped(a)) for a in LANGUAGES]).select(*made, "dataset", "ordinal")


PAIRS = """
placed AS (SELECT lang, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_index, count(*) OVER () AS n
           FROM documents),
pairs AS (
  SELECT s.row_index, s.text AS source, t.text AS target, s.lang AS source_lang, t.lang AS target_lang, s.lang AS dataset
  FROM placed s JOIN placed t ON t.row_index = (s.row_index + 1) % s.n)
"""

# The i-th document of one language with the i-th of another; a surplus on one side is dropped.
SIDES = """
placed AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_index
           FROM documents),
pairs AS (
  SELECT s.row_index, s.text AS source, t.text AS target, s.lang AS source_lang, t.lang AS target_lang,
         s.lang || '-' || t.lang AS dataset
  FROM placed s JOIN placed t ON s.row_index = t.row_index
   AND ((s.lang = 'en' AND t.lang = 'de') OR (s.lang = 'es' AND t.lang = 'fr')))
"""

W = r"\s\x0b\p{Z}\x1c-\x1f\x{85}"


def sql_strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^[{W}]+', ''), '[{W}]+$', '')"


def sql_tags(e: str) -> str:
    return f"regexp_replace({e}, '<[^>]+>', '', 'g')"


def sql_urls(e: str) -> str:
    return f"regexp_replace({e}, 'http[^{W}]+|www[^{W}]+', '', 'g')"


def sql_punct(e: str) -> str:
    for mark in ("!", "?", "."):
        e = f"regexp_replace({e}, '[{mark}]+', '{mark}', 'g')"
    return e


def sql_normalize(e: str) -> str:
    clean = sql_punct(sql_urls(sql_tags(f"coalesce({e}, '')")))
    return f"trim(regexp_replace({clean}, '[{W}]+', ' ', 'g'))"


def sql_words(e: str) -> str:
    kept = rf"regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_{W}]', '', 'g')"
    return f"list_filter(string_split_regex({kept}, '[{W}]+'), lambda w: w <> '')"


def sql_keep(e: str) -> str:
    return rf"regexp_extract_all({e}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"


def sql_is_word(e: str) -> str:
    return rf"regexp_full_match({e}, '[\p{{L}}\p{{N}}_]+') AND NOT regexp_full_match({e}, '[0-9]+')"


def sql_sentence(e: str) -> str:
    s = sql_strip(e)
    s = rf"(CASE WHEN regexp_matches({s}, '^\p{{Ll}}') THEN upper(substr({s}, 1, 1)) || substr({s}, 2) ELSE {s} END)"
    return rf"({s} || CASE WHEN regexp_matches({s}, '[\p{{L}}\p{{N}}]$') THEN '.' ELSE '' END)"
