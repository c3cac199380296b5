"""From prepared tables to dictionaries, corrections and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolex.functions import text as tx
from duolex.operators import spelling as sp
from duolex.operators.filters import correction_gate
from duolex.operators.frequency import MIN_FREQUENCY, most_common, word_frequency
from duolex.operators.fuzzy import open_index, write_index
from duolex.operators.inference import Translator, translate
from duolex.operators.meteor import meteor_corpus, meteor_row
from duolex.operators.ordering import latest_n
from duolex.session import materialize
from duolex.sources import tables as tb

# The language names that stand for a code.
LANGUAGE_CODES = {"English": "en", "Turkish": "tr"}


def build_dictionary(
    spark: SparkSession,
    corpus: str,
    languages: str,
    output: str,
    min_count: int = MIN_FREQUENCY,
    index: str | None = None,
) -> DataFrame:
    """Count the words of every table below `corpus` and store one dictionary per language, and
    the index that lookups in it use, if a place for it is named."""
    columns = ["source", "target", "source_lang", "target_lang"]
    entries = tb.read_dir(spark, corpus, columns)
    dimension = tb.read_json_array(spark, languages, tb.LANGUAGE_SCHEMA)
    tb.write_dictionary(word_frequency(entries, dimension, min_count), output)
    stored = tb.read_dictionary(spark, output)
    if index:
        write_index(stored, index)
    return most_common(stored)


def correct_text(
    texts: DataFrame,
    dictionary: DataFrame,
    languages: Sequence[str],
    key: str = "doc_id",
    codes: dict[str, str] | None = None,
    index: str | None = None,
) -> DataFrame:
    """(key, rank, sentence) for the texts of (key, text, lang) that pass the gate.

    `index` is where the dictionary's index is stored; without it one is made for this call.
    """
    gated = correction_gate(texts, languages)
    coded = gated.select(key, tx.lang_code("lang", LANGUAGE_CODES if codes is None else codes).alias("iso"), "text")
    opened = open_index(texts.sparkSession, index) if index else None
    return sp.correct_texts(coded, dictionary, key, opened)


def evaluate_translations(
    pairs: DataFrame,
    load_translator: Callable[[], Translator],
    key: str,
    by: Sequence[str] = (),
    output: str | None = None,
    on_error: str = "empty",
) -> DataFrame:
    """Translate every source, score against its target, average over all rows."""
    translated = translate(pairs, load_translator, on_error=on_error)
    # A model run is worth more than a write: a lost executor must not start it again.
    # Only what is scored is stored.
    scored = translated.select(*dict.fromkeys([key, *by]), "prediction", F.col("target").alias("reference"))
    translated = materialize(scored, "translated")
    rows = meteor_row(translated, key, carry=by)
    if output:
        rows = materialize(rows, "row-scores")
    scores = meteor_corpus(rows, by)
    if output:
        tb.write_metrics(meteor_corpus(rows).select("meteor"), output)
    return scores


def read_history(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The newest complete records of a stored JSON log."""
    from duolex.operators.filters import complete_records

    return latest_n(complete_records(tb.read_json_array(spark, path, tb.HISTORY_SCHEMA)), "timestamp", n=n)
