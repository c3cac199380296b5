"""Typed input to logged translations, as one stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.operators.inference import Translator, translate
from duolex.streaming.debounce import debounce_stream
from duolex.streaming.history import history_records, history_sink


def translation_log(
    keystrokes: DataFrame,
    load_translator: Callable[[], Translator],
    source_lang: str,
    target_lang: str,
    path: str,
    gap_seconds: int = 1,
    watermark_seconds: int | None = None,
) -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    """The stream of log records for (key, ts, value, seq) input, and the sink that keeps them."""
    fired = debounce_stream(keystrokes, "key", "ts", "value", "seq", gap_seconds, watermark_seconds)
    asked = fired.withColumnsRenamed({"value": "source"}).withColumns(
        {"source_lang": F.lit(source_lang), "target_lang": F.lit(target_lang)}
    )
    done = translate(asked, load_translator, on_error="message", output="target")
    # Records of one second are ordered by a digest of their key, the same on every run.
    digest = F.md5(F.col("key").cast("string").cast("binary"))
    numbered = done.withColumn("seq", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    return history_records(numbered, "fired_at", "seq"), history_sink(path)
