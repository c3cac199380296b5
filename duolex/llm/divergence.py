"""How far the sources of a language differ in their words, from exact products of one-hot levels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolex.llm.common import documents, query
from duolex.operators.joins import join_small
from duolex.session import materialize

#: A language keeps the terms that so many of its documents hold.
LEAST_DOCS = 10
#: Terms listed for each source.
TOP_TERMS = 10
#: Probabilities are counted in units of one in so many.
UNIT = 1_000_000_000
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 400_000
#: Terms of a block are about so many; products of blocks are at most so many columns square.
BLOCK_TERMS = 1_024
TILE_COLUMNS = 1_024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The pattern on UTF-8 bytes: ASCII letters and everything beyond ASCII stay, the rest parts terms.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, text) to (lang, source, term, count, docs), added up as far as a task may hold."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pd.DataFrame]:
        for (lang, source), (counts, docs) in held.items():
            terms = sorted(counts)
            yield pd.DataFrame({
                "lang": lang, "source": source, "term": [t.decode("utf-8", "replace") for t in terms],
                "count": [counts[t] for t in terms], "docs": [docs[t] for t in terms],
            })
        held.clear()

    size = 0
    for batch in batches:
        for group, text in zip(zip(batch["lang"], batch["source"]), batch["text"]):
            found = text.translate(TO_TERMS).split()
            if not found:
                continue
            counts, docs = held.setdefault(group, (Counter(), Counter()))
            size -= len(counts)
            counts.update(found)
            docs.update(set(found))
            size += len(counts)
            if size > HELD_COUNTS:
                yield from passed_on()
                size = 0
    yield from passed_on()


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, count, entries): the terms that enough documents of a language hold, with their
    count in each source that has them. Stored."""
    texts = docs.select("lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInPandas(_counts, "lang string, source string, term string, count long, docs long")
    # Tasks have added up already. One shuffle serves both sums: a term's rows of all sources lie together.
    counted = counted.repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("count"), F.collect_list(F.struct("source", "count")).alias("entries")
    )
    return materialize(by_term.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")


def level_products(levels: list[tuple[np.ndarray, np.ndarray]], prices: list[np.ndarray]) -> np.ndarray:
    """For every two groups the summed divergence over the rows of a block.

    `levels` has for each group its distinct levels and each row's index into them, `prices` the
    probability of each level. A group's level is an indicator column; the product of the columns
    with their transpose has in each cell how many rows have one level in one group and another
    in the other, which is exact in single precision as long as rows are fewer than 2^24. Columns
    are multiplied in tiles of whole groups.
    """
    groups = len(levels)
    out = np.zeros((groups, groups), dtype=np.int64)
    tiles, begin, held = [], 0, 0
    for g, (values, _) in enumerate(levels):
        if g > begin and held + len(values) > TILE_COLUMNS:
            tiles.append(range(begin, g))
            begin, held = g, 0
        held += len(values)
    tiles.append(range(begin, groups))

    def indicators(tile: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        widths = [len(levels[g][0]) for g in tile]
        starts = np.concatenate([[0], np.cumsum(widths)])
        x = np.zeros((len(levels[0][1]), starts[-1]), dtype=np.float32)
        for i, g in enumerate(tile):
            x[np.arange(len(x)), starts[i] + levels[g][1]] = 1
        return x, np.concatenate([prices[g] for g in tile]), np.repeat(np.asarray(tile), widths)

    for i, one in enumerate(tiles):
        x, p, owner = indicators(one)
        for two in tiles[i:]:
            y, q, other = (x, p, owner) if two is one else indicators(two)
            joint = x.T @ y
            a, b = np.nonzero(joint)
            times = joint[a, b].astype(np.int64)
            np.add.at(out, (owner[a], other[b]), times * ((p[a] - q[b]) ** 2 // (p[a] + q[b])))
            if two is not one:
                out[two.start : two.stop, one.start : one.stop] = out[one.start : one.stop, two.start : two.stop].T
    return out


def _pricer(groups: dict[str, tuple[list[str], list[int]]]):
    """Blocks of terms (lang, block, entries) to (lang, source, item, value); `groups` has each
    language's sources and the divisors of their probabilities."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        lang = block["lang"].iloc[0]
        sources, divisors = groups[lang]
        at = {s: i for i, s in enumerate(sources)}
        counts = np.zeros((len(sources), len(block)), dtype=np.int64)
        for row, entries in enumerate(block["entries"]):
            for entry in entries:
                counts[at[entry["source"]], row] = entry["count"]
        levels = [np.unique(c, return_inverse=True) for c in counts]
        # Whole numbers of any size, as a count times the unit may pass 64 bits.
        prices = [
            np.asarray([1 + UNIT * (int(v) + 2) // d for v in values], dtype=np.int64) for (values, _), d in zip(levels, divisors)
        ]
        values = level_products(levels, prices)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = np.asarray(sources, dtype=object)
        return pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": values[a, b]})

    return run


def _price(count: str, n: str, v: str) -> Column:
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({n} + 2 * {v} as decimal(20, 0))")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source beside every other of its language, and
    the terms it uses most beyond the language as a whole.

    Terms are counted by tasks, then by (language, term), so that a source or language with most of
    the rows is as many keys as any other. Terms of like frequency form blocks, whose levels are
    few; each block's joint tables are priced where they are made and only their sums move. The
    sources of a language are a dimension that tasks get whole: the result has a row for any two.

    Null text, language and source count as ''. A document is a row, so repeated rows count each.
    Long texts are read whole. Sources without a term, and languages that keep none, still give
    pairs (value 0 where no term is kept) but no terms. Equal values are ranked by UTF-8 item. A
    language with one source gives no pair, an empty table no rows; other columns are not read.
    """
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(named, least_docs)
    spread = kept.select("lang", "term", F.col("count").alias("lang_count"), F.inline("entries"))
    in_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("count").alias("lang_n"))
    in_source = spread.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = named.select("lang", "source").distinct().join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = materialize(groups.na.fill(0, ["n", "v", "lang_n"]), "groups")

    size = F.floor(F.log2(F.col("count"))).cast("int")
    sized = kept.select("lang", "term", "entries", size.alias("size"))
    blocks = sized.groupBy("lang", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TERMS).alias("blocks"))
    placed = join_small(sized, blocks, ["lang", "size"])
    placed = placed.select("lang", "size", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "entries")
    by_lang: dict[str, tuple[list[str], list[int]]] = {}
    for row in groups.filter("v > 0").toLocalIterator():
        sources, divisors = by_lang.setdefault(row.lang, ([], []))
        sources.append(row.source)
        divisors.append(row.n + 2 * row.v)
    priced = placed.groupBy("lang", "size", "block").applyInPandas(_pricer(by_lang), "lang string, source string, item string, value long")
    sums = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("part", F.lit("pair"))

    p, q = _price("count", "n", "v"), _price("lang_count", "lang_n", "v")
    terms = join_small(spread, groups, ["lang", "source"]).withColumns({"p": p, "q": q}).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


DIVERGENCE_SQL = rf"""
WITH said AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS words FROM documents),
words AS (SELECT r, lang, source, unnest(words) AS term FROM said),
kept AS (SELECT lang, term, count(*)::BIGINT AS count FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
in_lang AS (SELECT lang, count(*)::BIGINT AS v, sum(count)::BIGINT AS lang_n FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*)::BIGINT AS count FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
all_groups AS (SELECT DISTINCT lang, source FROM said),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.count), 0)::BIGINT AS n FROM all_groups g LEFT JOIN counted c USING (lang, source) GROUP BY g.lang, g.source),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.count, 0) AS count, k.count AS lang_count, n, v, lang_n
  FROM groups g JOIN kept k USING (lang) JOIN in_lang USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (SELECT *, 1 + (1000000000::HUGEINT * (count + 2)) // (n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lang_count + 2)) // (lang_n + 2 * v) AS q FROM full_counts),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM priced WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12_source_divergence(spark, sf_dir):
    return source_divergence(documents(spark, sf_dir))
