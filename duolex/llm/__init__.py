"""Operators of a training-data pipeline, with the queries that apply them to whole tables."""

from duolex.llm import (  # noqa: F401
    bpe,
    divergence,
    hnsw,
    imatch,
    language_model,
    languages,
    minhash,
    packing,
    repeats,
    search,
    sharding,
    toxicity,
    urls,
)
from duolex.llm.common import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
