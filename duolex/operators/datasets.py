"""Combining data sets under one row budget."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slice_rows(df: DataFrame, start: int = 0, num: int | None = None, index: str = "row_index") -> DataFrame:
    """Skip `start` positions, then keep `num`, or all that follow."""
    kept = df.filter(F.col(index) >= start)
    return kept if num is None else kept.filter(F.col(index) < start + num)


def union_datasets(named: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union that remembers where each row came from."""
    tagged = [
        df.withColumns({"dataset": F.lit(name), "ordinal": F.lit(i)}) for i, (name, df) in enumerate(named)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def quotas(available: Sequence[int], max_rows: int, first_complete: bool = False) -> list[int]:
    """Rows each data set may give, in listed order, until the budget is used up."""
    left, out = max_rows, []
    for i, rows in enumerate(available):
        take = rows if first_complete and i == 0 else max(0, min(rows, left))
        out.append(take)
        left -= take
    return out


def row_budget(
    df: DataFrame,
    names: Sequence[str],
    max_rows: int,
    start: int = 0,
    first_complete: bool = False,
    index: str = "row_index",
) -> DataFrame:
    """Keep of each listed data set what the budget leaves, counting from row `start`.

    One counting pass gives a quota row per listed name. That table has as many rows as the
    list that made it, so it is broadcast, and the quota becomes a range predicate.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame(list(enumerate(names)), "ordinal int, dataset string")
    sizes = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.greatest(F.coalesce("_rows", F.lit(0)) - start, F.lit(0))
    plan = listed.join(sizes, "dataset", "left").withColumn("_usable", usable)
    plan = plan.withColumn("_left", F.lit(max_rows) - F.coalesce(F.sum("_usable").over(ahead), F.lit(0)))
    quota = F.greatest(F.least("_usable", "_left"), F.lit(0))
    if first_complete:
        quota = F.when(F.col("ordinal") == 0, F.col("_usable")).otherwise(quota)
    plan = plan.select("dataset", "ordinal", quota.alias("_quota"))
    kept = df.join(F.broadcast(plan), "dataset")
    kept = kept.filter((F.col(index) >= start) & (F.col(index) < F.col("_quota") + start))
    return kept.select(*df.columns, "ordinal")
