"""Row filters and constant columns over pairs and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions import text as tx

SIMILARITY_THRESHOLD = 0.7
HISTORY_KEYS = ("source_text", "target_text", "timestamp", "direction")


def drop_identical(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return df.filter(~F.col(source).eqNullSafe(F.col(target)))


def similarity_filter(df: DataFrame, score: str = "score", threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    return df.filter(F.col(score) >= threshold)


def drop_empty(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return df.filter((F.length(source) > 0) & (F.length(target) > 0))


def tag_languages(df: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    return df.withColumns({"source_lang": F.lit(source_lang), "target_lang": F.lit(target_lang)})


def mirror(df: DataFrame) -> DataFrame:
    """Each pair once as it is and once with sides and language tags swapped, in one scan."""
    kept = [c for c in df.columns if c not in ("source", "target", "source_lang", "target_lang")]
    straight = F.struct("source", "target", "source_lang", "target_lang", F.lit(0).alias("direction"))
    swapped = F.struct(
        F.col("target").alias("source"),
        F.col("source").alias("target"),
        F.col("target_lang").alias("source_lang"),
        F.col("source_lang").alias("target_lang"),
        F.lit(1).alias("direction"),
    )
    return df.select(*kept, F.inline(F.array(straight, swapped)))


def normalize_pairs(df: DataFrame, repair: bool = True) -> DataFrame:
    """Normalize both sides, then keep pairs with text left on both.

    The generator holds both results as one row, so that the filter reads them and is not itself
    the whole of the work once more, as it is when it is pushed below what makes its columns.
    """
    sides = F.array(F.struct(*[tx.normalize_text(c, repair).alias(c) for c in ("source", "target")]))
    kept = [c for c in df.columns if c not in ("source", "target")]
    return drop_empty(df.select(*kept, F.inline(sides)).select(*df.columns))


def complete_records(df: DataFrame, keys: Sequence[str] = HISTORY_KEYS) -> DataFrame:
    return df.dropna(subset=list(keys))


def correction_gate(
    df: DataFrame,
    languages: Sequence[str],
    text: str = "text",
    lang: str = "lang",
    max_length: int = tx.MAX_CHECKED_LENGTH,
) -> DataFrame:
    """Texts that are checked at all: listed language, not blank, not too long."""
    return df.filter(
        F.col(lang).isin(*languages) & (F.length(text) <= max_length) & ~tx.is_blank(text)
    )
