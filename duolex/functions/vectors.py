"""Row-wise vector arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors in double precision, in one pass over both; a zero vector scores 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("ab", "aa", "bb")])

    def add(s: Column, p: Column) -> Column:
        return F.struct(
            (s["ab"] + p["x"] * p["y"]).alias("ab"),
            (s["aa"] + p["x"] * p["x"]).alias("aa"),
            (s["bb"] + p["y"] * p["y"]).alias("bb"),
        )

    def finish(s: Column) -> Column:
        norm = F.sqrt(s["aa"]) * F.sqrt(s["bb"])
        return F.when(norm > 0, s["ab"] / norm).otherwise(F.lit(0.0))

    return F.aggregate(both, zero, add, finish)
