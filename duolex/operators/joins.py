"""Joins whose size or skew the corpus decides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.session import materialize

# The broadcast part of a lookup never has more rows than this, nor longer keys.
HOT_ROWS = 10_000
HOT_KEY_LENGTH = 64
# A key that so many unsettled rows share is looked up once and sent to them.
HEAVY_ROWS = 100_000
# A dimension is broadcast only after counting that it has no more rows than this.
SMALL_ROWS = 10_000


class AlignmentError(ValueError):
    """The two sides of a positional pairing have different lengths."""


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Equi-join in which a null key meets a null key, so that no group is lost."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, same, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Broadcast the small side if it is counted to be small, else join by shuffle."""
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    heaviest_first: Sequence[Column],
    hot_rows: int = HOT_ROWS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Left join to a table with distinct keys, where a few keys may hold most of the rows.

    The `hot_rows` heaviest entries of the table are broadcast; the rows they settle go straight
    into the result and are never shuffled. The other rows are stored, and the keys that still
    have `heavy_rows` of them or more, entry or not, are looked up once each and settled by
    broadcast too. Only what is left meets the table by shuffle. `df` is computed twice, so rows
    that were dear to make are best stored before.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in keys]

    def sendable(frame: DataFrame) -> DataFrame:
        return frame.filter(F.coalesce(F.length(F.col(keys[-1]).cast("string")), F.lit(0)) <= HOT_KEY_LENGTH)

    def settled_by(rows: DataFrame, entries: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(entries), keys).select(*df.columns, *[F.col("_entry")[v].alias(v) for v in values])

    hot = sendable(table).orderBy(*heaviest_first).limit(hot_rows)
    hot = materialize(hot.select(*keys, F.struct(*values).alias("_entry")), "hot")
    out = settled_by(df, hot)
    rest = materialize(df.join(F.broadcast(hot), keys, "left_anti"), "unsettled")
    counts = sendable(rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= heavy_rows))
    counts = counts.dropna(subset=keys)
    if not counts.isEmpty():
        heavy = materialize(counts.orderBy(F.desc("_rows"), *keys).limit(HOT_ROWS).drop("_rows"), "heavy")
        # In one join with all of `heavy` kept it would be the table that is sent.
        known = table.join(F.broadcast(heavy), keys)
        entries = heavy.join(F.broadcast(known), keys, "left").select(*keys, F.struct(*values).alias("_entry"))
        entries = materialize(entries, "heavy-entries")
        out = out.unionByName(settled_by(rest, entries))
        rest = rest.join(F.broadcast(entries), keys, "left_anti")
    # A null key meets nothing and needs no partner.
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # The table may be far larger than Spark takes it for, as after an explode.
    cold = rest.filter(whole).join(table.hint("merge"), keys, "left").select(*df.columns, *values)
    unkeyed = rest.filter(~whole).select(*df.columns, *[F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values])
    return out.unionByName(cold).unionByName(unkeyed)


def alignment_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: both sides' row counts and whether they agree."""
    n_left = left.agg(F.count(F.lit(1)).alias("left_rows"))
    n_right = right.agg(F.count(F.lit(1)).alias("right_rows"))
    # Both inputs are single aggregate rows.
    both = n_left.withColumn("_k", F.lit(1)).join(n_right.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("aligned", F.col("left_rows") == F.col("right_rows"))


def zip_rows(
    left: DataFrame, right: DataFrame, on: Sequence[str] = ("row_index",), on_mismatch: str = "truncate", within: Sequence[str] = ()
) -> DataFrame:
    """Pair rows at equal positions; a surplus is dropped, or refused with 'error'.

    With `within`, only rows that agree in these columns meet, and sides that are stored in buckets
    of them stay where they are: each row is held against all of its bucket key, which so has few.
    """
    if on_mismatch not in ("error", "truncate"):
        raise ValueError("on_mismatch is 'error' or 'truncate'")
    if on_mismatch == "error":
        sides = alignment_check(left, right).first()
        if not sides.aligned:
            raise AlignmentError(f"{sides.left_rows} rows on the left, {sides.right_rows} on the right")
    if not within:
        return left.join(right, list(on), "inner")
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in (*within, *on)})
    # As a key of the join a position would have both sides shuffled by it.
    same = [F.col(c) == F.col(f"_right_{c}") for c in within] + [F.col(c) - F.col(f"_right_{c}") == 0 for c in on]
    return left.join(renamed, reduce(lambda a, b: a & b, same)).drop(*[f"_right_{c}" for c in (*within, *on)])
