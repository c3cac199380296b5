"""Fixed-length id sequences for pairs, over a word-level vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.functions.text import make_prompt, word_array
from duolex.operators.indexing import position_by_hash, rows_above
from duolex.operators.joins import lookup_join
from duolex.session import materialize

# The ids a sequence model of this family reserves, and the ignored label.
PAD_ID, END_ID, UNKNOWN_ID, IGNORED = 0, 1, 2, -100
FIRST_ID = 3
MAX_LEN = 128


def vocabulary(dictionary: DataFrame) -> DataFrame:
    """(term, count, id): ids by falling count over all languages, equal counts by hash.

    The terms of higher counts are summed up in two steps; the many terms of one count are placed
    by hash bucket. The result is stored, since every use of it is a lookup that reads it more
    than once.
    """
    terms = dictionary.groupBy("term").agg(F.sum("count").alias("count"))
    terms = materialize(terms, "terms").withColumn("_h", F.md5(F.col("term").cast("binary")))
    placed = position_by_hash(terms, "_h", groups=["count"], name="_at")
    ids = (F.col("rows") + F.col("_at") + FIRST_ID).cast("int")
    return materialize(placed.join(rows_above(terms, "count"), "count").select("term", "count", ids.alias("id")), "vocabulary")


def _padded(ids: Column, max_len: int, filler: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(filler), F.lit(max_len) - F.size(ids)))


def build_examples(pairs: DataFrame, vocab: DataFrame, keys: Sequence[str], max_len: int = MAX_LEN) -> DataFrame:
    """(keys, input_ids, attention_mask, labels), each list `max_len` long.

    A sequence is cut to leave room for the end id, so no text takes part with more than
    `max_len` tokens.
    """
    keys = list(keys)
    prompt = make_prompt("source_lang", "target_lang", "source")

    def cut(text: Column) -> Column:
        return F.slice(word_array(F.coalesce(text, F.lit(""))), 1, max_len - 1)

    sides = F.array(
        F.struct(F.lit(0).alias("_side"), cut(prompt).alias("_words")),
        F.struct(F.lit(1).alias("_side"), cut(F.col("target")).alias("_words")),
    )
    words = pairs.select(*keys, F.inline(sides)).select(
        *keys, "_side", F.posexplode_outer("_words").alias("_at", "_term")
    )
    known = vocab.select(F.col("term").alias("_term"), F.col("id").alias("_id"), F.col("count").alias("_count"))
    found = lookup_join(words, known, ["_term"], [F.desc("_count"), F.col("_term")])
    # A text without words still has its row, with a null position.
    token = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_id", F.lit(UNKNOWN_ID)).alias("id")))

    def side(which: int) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(F.col("_side") == which, token)))
        return F.concat(F.transform(ordered, lambda t: t["id"]), F.array(F.lit(END_ID)))

    lists = found.groupBy(*keys).agg(side(0).alias("_source"), side(1).alias("_target"))
    return lists.select(
        *keys,
        _padded(F.col("_source"), max_len, PAD_ID).alias("input_ids"),
        _padded(F.transform("_source", lambda _: F.lit(1)), max_len, 0).alias("attention_mask"),
        _padded(F.col("_target"), max_len, IGNORED).alias("labels"),
    )
