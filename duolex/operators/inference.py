"""Batch models supplied by the caller: sentence encoders and translators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolex.functions.text import make_prompt

CHUNK_SIZE = 10_000
BATCH_SIZE = 8
ERROR_PREFIX = "Hata: "

Encoder = Callable[[list[str]], np.ndarray]
Translator = Callable[[list[str]], Sequence[str]]


def _vectors(model: Encoder, texts: pd.Series, chunk: int) -> list[np.ndarray]:
    filled = texts.fillna("").tolist()
    parts = [model(filled[i : i + chunk]) for i in range(0, len(filled), chunk)]
    return [v for part in parts for v in np.asarray(part, dtype=np.float32)]


def encode(text: Column | str, load_encoder: Callable[[], Encoder], chunk: int = CHUNK_SIZE) -> Column:
    """Vector of each text. The model is loaded once per worker process and partition."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_encoder()
        for texts in batches:
            yield pd.Series(_vectors(model, texts, chunk), index=texts.index)

    return run(F.col(text) if isinstance(text, str) else text)


def encode_pair(a: str, b: str, load_encoder: Callable[[], Encoder], chunk: int = CHUNK_SIZE) -> Column:
    """Struct (a, b) of the vectors of two columns, from one pass and one loaded model."""

    @F.pandas_udf("a array<float>, b array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load_encoder()
        for first, second in batches:
            yield pd.DataFrame({"a": _vectors(model, first, chunk), "b": _vectors(model, second, chunk)})

    return run(F.col(a), F.col(b))


def hashing_encoder(dim: int = 64) -> Encoder:
    """A model-free encoder for tests: words hashed into a count vector."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                out[row, zlib.crc32(word.encode()) % dim] += 1.0
        return out

    return model


def translate(
    df: DataFrame,
    load_translator: Callable[[], Translator],
    text: str = "source",
    batch_size: int = BATCH_SIZE,
    on_error: str = "empty",
    output: str = "prediction",
) -> DataFrame:
    """Add a translation per row; the translator sees prompts in batches.

    A batch that fails keeps its rows: with '' under 'empty', with the error under 'message'. A
    null text is an empty one.
    """
    if on_error not in ("empty", "message"):
        raise ValueError("on_error is 'empty' or 'message'")
    filled = [F.coalesce(F.col(c), F.lit("")) for c in ("source_lang", "target_lang", text)]

    # Only prompts go through Python; all other columns stay as they are.
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_translator()
        for given in batches:
            prompts = given.tolist()
            done: list[str] = []
            for i in range(0, len(prompts), batch_size):
                batch = prompts[i : i + batch_size]
                try:
                    made = [str(t) for t in model(batch)]
                    if len(made) != len(batch):
                        raise ValueError(f"{len(made)} translations for {len(batch)} prompts")
                except Exception as error:  # noqa: BLE001 - any model failure is a row value
                    made = ["" if on_error == "empty" else f"{ERROR_PREFIX}{error}"] * len(batch)
                done.extend(made)
            yield pd.Series(done, dtype=object)

    return df.withColumn(output, run(make_prompt(*filled)))


def identity_translator() -> Translator:
    """Returns the text behind the prompt; for tests."""
    return lambda prompts: [p.split(": ", 1)[1] for p in prompts]
