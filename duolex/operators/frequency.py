"""Word frequencies per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions.text import word_array
from duolex.operators.joins import join_small

MIN_FREQUENCY = 1


def stack_sides(pairs: DataFrame) -> DataFrame:
    """(name, text): both sides of every pair with their own language, in one scan."""
    sides = F.array(
        F.struct(F.col("source_lang").alias("name"), F.col("source").alias("text")),
        F.struct(F.col("target_lang").alias("name"), F.col("target").alias("text")),
    )
    return pairs.select(F.inline(sides))


def to_iso(df: DataFrame, languages: DataFrame, name: str = "name") -> DataFrame:
    """Language name to ISO code; rows of unlisted languages are dropped."""
    listed = languages.select(F.col("name").alias(name), F.col("iso_code").alias("iso"))
    return join_small(df, listed, name).drop(name)


def count_words(texts: DataFrame, min_count: int = MIN_FREQUENCY) -> DataFrame:
    """(iso, text) to (iso, term, count). Words are counted before anything is shuffled."""
    words = texts.select("iso", F.explode(word_array("text")).alias("term"))
    counts = words.groupBy("iso", "term").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") >= min_count) if min_count > 1 else counts


def word_frequency(pairs: DataFrame, languages: DataFrame, min_count: int = MIN_FREQUENCY) -> DataFrame:
    """Counts over both sides of all pairs, each under its own language."""
    return count_words(to_iso(stack_sides(pairs), languages), min_count)


def most_common(dictionary: DataFrame) -> DataFrame:
    return dictionary.orderBy(F.desc("count"), "term", "iso")
