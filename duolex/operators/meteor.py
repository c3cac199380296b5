"""METEOR with the exact-match stage, scored per row and over a set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolex.functions.text import SPACE, WORD

ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
# So many times the usual partitions.
FINER = 4
TOKEN = f"[{WORD}]+|[^{WORD}{SPACE}]"


def meteor_tokens(c: Column | str) -> Column:
    """Lower-cased word runs and single symbols."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def meteor_row(
    df: DataFrame,
    key: str = "row_id",
    prediction: str = "prediction",
    reference: str = "reference",
    carry: Sequence[str] = (),
    alpha: float = ALPHA,
    beta: float = BETA,
    gamma: float = GAMMA,
) -> DataFrame:
    """(key, carry..., matches, chunks, meteor), one row per distinct key.

    Equal tokens pair up counted from the end: the k-th last one of the prediction with the
    k-th last one of the reference. The rows are partitioned by key once, before their texts
    are taken apart; every later grouping and window is by key or finer and stays in place.
    """
    carry = list(carry)
    # Texts are far smaller than their tokens, so partitions are not joined by their size in the
    # shuffle, and are smaller than usual, for their tokens to be sorted in memory.
    partitions = FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(key, *carry, F.col(prediction).alias("_p"), F.col(reference).alias("_r")).repartition(partitions, key)
    texts = texts.select(key, *carry, meteor_tokens("_p").alias("_p"), meteor_tokens("_r").alias("_r"))
    sides = F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_p").alias("_tokens")),
        F.struct(F.lit(1).alias("_side"), F.col("_r").alias("_tokens")),
    )
    row = [key, *carry, "_np", "_nr"]
    # The outer forms keep rows whose texts are empty or share nothing.
    placed = texts.select(
        key, *carry, F.size("_p").alias("_np"), F.size("_r").alias("_nr"), F.inline(sides)
    ).select(*row, "_side", F.posexplode_outer("_tokens").alias("_at", "_token"))
    spots = placed.groupBy(*row, "_token").agg(
        F.sort_array(F.collect_list(F.when(F.col("_side") == 0, F.col("_at"))), False).alias("_in_p"),
        F.sort_array(F.collect_list(F.when(F.col("_side") == 1, F.col("_at"))), False).alias("_in_r"),
    )
    both = F.least(F.size("_in_p"), F.size("_in_r"))
    zipped = F.arrays_zip(
        F.slice("_in_p", F.lit(1), both).alias("_hyp"), F.slice("_in_r", F.lit(1), both).alias("_ref")
    )
    paired = spots.select(*row, F.inline_outer(zipped).alias("_hyp", "_ref"))
    along = Window.partitionBy(key).orderBy("_hyp")
    follows = (F.col("_hyp") - F.lag("_hyp").over(along) == 1) & (F.col("_ref") - F.lag("_ref").over(along) == 1)
    starts = F.when(F.col("_hyp").isNull() | F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    out = (
        paired.withColumn("_starts", starts)
        .groupBy(*row)
        .agg(F.count("_hyp").alias("matches"), F.sum("_starts").alias("chunks"))
    )
    m = F.col("matches").cast("double")
    precision, recall = m / F.col("_np"), m / F.col("_nr")
    mean = precision * recall / (F.lit(alpha) * precision + F.lit(1 - alpha) * recall)
    penalty = F.lit(gamma) * F.pow(F.col("chunks") / m, F.lit(beta))
    score = F.when(F.col("matches") > 0, (1 - penalty) * mean).otherwise(F.lit(0.0))
    return out.select(key, *carry, "matches", "chunks", score.alias("meteor"))


def meteor_corpus(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean row score; unscored rows count as 0. With `by`, subtotals of those columns too."""
    score = F.avg(F.coalesce("meteor", F.lit(0.0))).alias("meteor")
    count = F.count(F.lit(1)).alias("n_rows")
    return rows.rollup(*by).agg(score, count) if by else rows.agg(score, count)
