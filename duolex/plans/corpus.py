"""From aligned text to cleaned pairs, and from pairs to training and test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolex.functions.vectors import pair_cosine
from duolex.operators import datasets as ds
from duolex.operators import filters as fl
from duolex.operators import ordering as od
from duolex.operators.inference import Encoder, encode_pair
from duolex.operators.joins import alignment_check, zip_rows
from duolex.operators.reports import retention_report
from duolex.session import materialize
from duolex.sources.lines import read_lines
from duolex.sources.pairs import read_parquet_pair, read_side, side_path, write_pair
from duolex.sources.tables import write_splits


def score_pairs(pairs: DataFrame, load_encoder: Callable[[], Encoder]) -> DataFrame:
    """Drop identical pairs, then add the similarity of both sides' vectors as `score`.

    The identity filter comes first because a model run does not let filters pass below it.
    """
    kept = fl.drop_identical(pairs)
    vectors = kept.withColumn("_vectors", encode_pair("source", "target", load_encoder))
    return vectors.withColumn("score", pair_cosine(F.col("_vectors.a"), F.col("_vectors.b"))).drop("_vectors")


def clean_corpus(
    spark: SparkSession,
    folder: str,
    output: str,
    dataset: str,
    source_lang: str,
    target_lang: str,
    load_encoder: Callable[[], Encoder] | None = None,
    threshold: float = fl.SIMILARITY_THRESHOLD,
    on_mismatch: str = "error",
) -> DataFrame:
    """Two aligned text files to two aligned Parquet data sets; returns the retention report.

    Without an encoder the pairs are only aligned and stripped.
    """
    source = read_lines(spark, f"{folder}/{dataset}-{source_lang}.txt").withColumnRenamed("text", "source")
    target = read_lines(spark, f"{folder}/{dataset}-{target_lang}.txt").withColumnRenamed("text", "target")
    pairs = zip_rows(source, target, on_mismatch=on_mismatch)
    if load_encoder is None:
        # Nothing is dropped, so the positions have no gaps to close.
        write_pair(pairs, output, dataset, source_lang, target_lang, dense=False)
        kept = pairs.select("row_index")
    else:
        kept = fl.similarity_filter(score_pairs(pairs, load_encoder), threshold=threshold)
        kept = materialize(kept.select("row_index", "source", "target"), "clean")
        write_pair(kept, output, dataset, source_lang, target_lang, stored=True)
    rows_in = source.agg(F.count(F.lit(1)).alias("rows_in")).withColumn("dataset", F.lit(dataset))
    rows_kept = kept.agg(F.count(F.lit(1)).alias("rows_kept")).withColumn("dataset", F.lit(dataset))
    return rows_in.join(rows_kept, "dataset").select("dataset", "rows_in", "rows_kept")


def load_datasets(
    spark: SparkSession,
    base: str,
    names: Sequence[str],
    source_lang: str,
    target_lang: str,
    max_rows: int | None = None,
    start: int = 0,
    first_complete: bool = False,
) -> DataFrame:
    """Tagged pairs of the listed data sets, all of them or under one row budget.

    File footers tell how many rows each data set has, so every quota is known before any text
    is read, and reaches both sides of the positional join as a range filter.
    """
    paths = [
        (side_path(f"{base}/{n}", n, source_lang), side_path(f"{base}/{n}", n, target_lang)) for n in names
    ]
    available = [max(0, _rows(spark, *pair) - start) for pair in paths]
    named = [
        (name, read_parquet_pair(spark, *pair, start=start, num=quota))
        for name, pair, quota in zip(names, paths, ds.quotas(available, sum(available) if max_rows is None else max_rows, first_complete))
        if quota > 0
    ]
    if not named:
        raise ValueError("no data set has rows to read")
    return fl.tag_languages(ds.union_datasets(named), source_lang, target_lang)


def _rows(spark: SparkSession, source: str, target: str) -> int:
    from pyspark.errors import AnalysisException

    try:
        sides = alignment_check(read_side(spark, source, "source"), read_side(spark, target, "target")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return min(sides.left_rows, sides.right_rows)


def prepare_pairs(
    pairs: DataFrame,
    keys: Sequence[str] = ("dataset", "row_index"),
    test_size: float = od.TEST_SIZE,
    seed: int = od.SEED,
    leak_free: bool = True,
    repair: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Normalize, drop empty pairs, split per source language, mirror and shuffle tagged pairs.

    Normalizing does not look at the direction, so it runs once per pair, before mirroring.
    With `leak_free` so does the split: both directions of a pair land on one side, and the
    strata keep their exact sizes, as each direction's stratum is an image of the other's.
    Without it the mirrored rows are split one by one. `position` is the place in the shuffle.
    """
    clean = materialize(fl.normalize_pairs(pairs, repair), "normalized")
    if leak_free:
        rows = fl.mirror(od.stratified_split(clean, keys, test_size=test_size, seed=seed))
    else:
        rows = od.stratified_split(fl.mirror(clean), [*keys, "direction"], test_size=test_size, seed=seed)
    return od.shuffle(rows, [*keys, "direction"], seed, partitions, name="position")


def prepare_corpus(spark: SparkSession, base: str, names: Sequence[str], source_lang: str, target_lang: str, output: str, max_rows: int | None = None, start: int = 0, first_complete: bool = False, **options) -> DataFrame:
    """Listed data sets to train and test tables; returns the rows per data set that survived."""
    pairs = load_datasets(spark, base, names, source_lang, target_lang, max_rows, start, first_complete)
    prepared = prepare_pairs(pairs, **options)
    write_splits(prepared, output, in_order=True)
    written = spark.read.parquet(output)
    return retention_report(written, F.col("split") == "train")
