"""Row positions without a window over everything.

Each ranking here cuts its order into buckets that are a pure function of the row, counts the
buckets, adds the counts up in two steps and numbers rows inside one bucket at a time. No task
ever sorts more than one bucket, however many rows one group holds, and a retried task finds
the same buckets again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolex.operators.joins import join_null_safe
from duolex.session import materialize

# An id bucket spans this many bits, so it holds at most 256 rows with distinct ids, and a
# coarse bucket at most 65,536 of them.
ID_BITS, COARSE_BITS = 8, 16
# Ids that differ in so many low bits share a number with a bit for each; of so many numbers at most, all are sent.
WORD_BITS, WORDS = 6, 500_000
# A range of ids holds about so many rows; beyond so many ranges they grow. Ranges of a coarse one.
RANGE_ROWS, RANGES, COARSE_RANGES = 1024, 10_000, 100
# Counts that agree in so many leading bits are summed up together first.
LEADING_BITS = 10
# A hash bucket is named by this many hex digits: a million buckets per group.
HASH_DIGITS = 5
COARSE_DIGITS = 2


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """Hex digest that orders rows at random but the same way on every run and retry."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))).cast("binary"))


def _offsets(df: DataFrame, groups: Sequence[str], fine: Column, coarse) -> DataFrame:
    """(groups, _fine, _before): rows of the group that lie in earlier buckets.

    The running sum goes over coarse buckets first and then inside each, so neither window
    sees more than the coarse or the fine fan-out.
    """
    groups = list(groups)
    counts = df.groupBy(*groups, fine.alias("_fine")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_coarse", coarse(F.col("_fine")))
    top = counts.groupBy(*groups, "_coarse").agg(F.sum("_n").alias("_m"))
    before_top = Window.partitionBy(*groups).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*groups, "_coarse", F.coalesce(F.sum("_m").over(before_top), F.lit(0)).alias("_base"))
    inside = (
        Window.partitionBy(*groups, "_coarse").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = join_null_safe(counts, top, [*groups, "_coarse"])
    return joined.select(*groups, "_fine", (F.col("_base") + F.col("_inner")).alias("_before"))


def _number(df: DataFrame, groups: Sequence[str], fine: Column, coarse, order: Sequence, name: str) -> DataFrame:
    groups = list(groups)
    # A constant group keeps the ungrouped case on the same path.
    anchor = groups or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    # The offset of a bucket is one more row of it, the first one: rows meet it in the shuffle that
    # brings the bucket together, and no join moves them again.
    offsets = _offsets(df, anchor, fine, coarse).withColumn("_row", F.lit(False))
    rows = df.withColumns({"_fine": fine, "_row": F.lit(True)})
    bucket = Window.partitionBy(*anchor, "_fine").orderBy("_row", *order)
    upto = bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(offsets, allowMissingColumns=True)
    place = F.first("_before").over(upto) + F.row_number().over(bucket) - 2
    out = met.withColumn(name, place).filter("_row")
    return out.select(*[c for c in df.columns if c != "_all"], name)


def position_by_id(df: DataFrame, id_col: str, groups: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row inside its group, ascending by a distinct integer id."""
    fine = F.shiftright(F.col(id_col).cast("long"), ID_BITS)
    return _number(df, groups, fine, lambda f: F.shiftright(f, COARSE_BITS), [id_col], name)


def position_in_place(df: DataFrame, id_col: str, name: str = "row_index", words: int = WORDS) -> DataFrame:
    """As `position_by_id` without groups, for stored rows, which stay where they are.

    A bit for each id tells how many ids of its 64 come before it, and sums how many rows lie
    before the 64. Ids that repeat or are null, or too many to be sent, take `position_by_id`.
    """
    id_ = F.col(id_col).cast("long")
    word, bit = F.shiftright(id_, WORD_BITS), id_.bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    ids = df.select(F.lit(0).alias("_all"), word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    held = materialize(ids.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"), F.count(F.lit(1)).alias("_n")), "id-words")
    repeated = F.col("_word").isNull() | (F.bit_count("_bits") < F.col("_n"))
    if held.limit(words + 1).count() > words or not held.filter(repeated).isEmpty():
        return position_by_id(df, id_col, name=name)
    before = _offsets(ids, ["_all"], F.col("_word"), lambda f: F.shiftright(f, COARSE_BITS))
    marks = held.join(before.withColumnRenamed("_fine", "_word"), "_word").select("_word", "_bits", "_before")
    marks = materialize(marks, "id-offsets")
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    placed = df.withColumn("_word", word).join(F.broadcast(marks), "_word")
    placed = placed.withColumn(name, F.col("_before") + F.bit_count(F.col("_bits").bitwiseAND(lower)))
    return placed.select(*df.columns, name)


def range_bounds(df: DataFrame, id_col: str) -> list[float]:
    """Ids that cut the rows into ranges of like size, each between half and twice the mean."""
    value = df.select(F.col(id_col).cast("double").alias("_value")).filter("_value IS NOT NULL")
    ranges = min(value.count() // RANGE_ROWS, RANGES)
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(value.approxQuantile("_value", shares, 1 / (4 * ranges))))


def position_by_range(df: DataFrame, id_col: str, groups: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """As `position_by_id`, for ids that lie far apart or in clusters.

    Buckets of bits would hold a row each there, and their counts would be as many as the rows.
    Here the bounds of the buckets are quantiles of the ids, drawn once, so that a retry finds the
    same ones. Ids are told apart as doubles, which keep the order of integers; a null id comes
    first. `df` is read twice more, for its ids only, and had better be stored.
    """
    bounds = range_bounds(df, id_col)
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        cut = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="keep")
        placed = cut.transform(df.withColumn("_value", F.col(id_col).cast("double"))).drop("_value")
    else:
        placed = df.withColumn("_range", F.lit(0.0))
    fine = F.when(F.col(id_col).isNull(), -1).otherwise(F.col("_range")).cast("long")
    return _number(placed, groups, fine, lambda f: F.floor(f / COARSE_RANGES), [id_col], name).drop("_range")


def rows_above(df: DataFrame, count_col: str) -> DataFrame:
    """(count, rows): for every count, a positive integer, the rows with a higher one.

    Counts with equal leading bits are summed up together first: at most some 30,000 sums are put
    in order at once, however many counts there are.
    """
    bits = "length(bin(-_fine))"
    leading = F.expr(f"-({bits} * {1 << LEADING_BITS} + shiftright(-_fine, greatest({bits} - {LEADING_BITS}, 0)))")
    counts = df.select(F.lit(0).alias("_all"), (-F.col(count_col)).alias("_below"))
    offsets = _offsets(counts, ["_all"], F.col("_below"), lambda _: leading)
    return offsets.select((-F.col("_fine")).alias(count_col), F.col("_before").alias("rows"))


def position_by_hash(
    df: DataFrame,
    hash_col: str,
    groups: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row inside its group, ascending by a hex digest."""
    fine = F.substring(hash_col, 1, HASH_DIGITS)
    return _number(
        df, groups, fine, lambda f: F.substring(f, 1, COARSE_DIGITS), [hash_col, *ties], name
    )


def order_by_hash(
    df: DataFrame, hash_col: str, ties: Sequence[str] = (), partitions: int | None = None, name: str | None = None
) -> DataFrame:
    """Global order by a hex digest in one shuffle, and each row's place in it as `name`, if named.

    The digest is uniform, so equal slices of its range are balanced partitions already and no
    sampling pass over the input is needed to find the range bounds. A place is the row's number
    in its sorted slice, counted as the slice streams by, after the rows of earlier slices, of
    which there are as many sums as partitions; `df` is read once more for them, its digest only.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.conv(F.substring(hash_col, 1, 6), 16, 10).cast("long")
    slot = F.expr(f"cast(_prefix * {n} div {16**6} as int)")
    placed = df.withColumn("_prefix", prefix).withColumn("_slot", slot)
    ordered = placed.repartitionById(n, "_slot").sortWithinPartitions(hash_col, *ties)
    if name:
        earlier = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        sums = placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
        sums = sums.select("_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        # The low bits of such an id are the number in the partition, which is one slice.
        ordered = ordered.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        ordered = ordered.join(F.broadcast(sums), "_slot").withColumn(name, F.col("_before") + F.col("_at"))
    return ordered.select(*df.columns, *([name] if name else []))
