"""Ranked lexical search: short posting lists are summed first, long ones are skipped through."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolex.llm.common import documents, query, read
from duolex.session import materialize, scratch_path

TOP = 10
#: A block of the index ends after so many documents or bytes of text, whichever comes first.
BLOCK_DOCS = 16_384
BLOCK_BYTES = 16_000_000
#: Items, and terms of items, that one pass over the documents answers; more items take more passes.
PASS_ITEMS = 2_048
PASS_TERMS = 1_000_000
#: Blocks that are searched first: their tenth scores are bounds that every other block starts with.
FIRST_BLOCKS = 8
#: Lists of at most this share of a block's documents are summed, the others skipped through.
SHORT_SHARE = 1 / 16
#: Documents that are scored together between two looks at the tenth score.
STEP = 512

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The pattern on UTF-8 bytes: letters and digits of ASCII and all else stay, the rest parts terms.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = (
    "first boolean, ids array<long>, named array<boolean>, lengths array<int>, terms array<int>, "
    "starts array<int>, docs array<int>, counts array<int>"
)


def index_block(ids: list, lengths: list[int], codes: list[np.ndarray]) -> dict:
    """The inverted index of some documents: for each term its documents, ascending, and occurrences."""
    n = max(len(ids), 1)
    sizes = [len(c) for c in codes]
    owner = np.repeat(np.arange(len(codes), dtype=np.int64), sizes)
    pairs, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]) * n + owner, return_counts=True)
    terms, starts = np.unique(pairs // n, return_index=True)
    return {
        "ids": [0 if i is None else i for i in ids],
        "named": [i is not None for i in ids],
        "lengths": lengths,
        "terms": terms.astype(np.int32),
        "starts": np.append(starts, len(pairs)).astype(np.int32),
        "docs": (pairs % n).astype(np.int32),
        "counts": counts.astype(np.int32),
    }


def _indexer(vocabulary: dict[bytes, int], stride: int):
    """Batches of (id, text) to rows of the index; only terms of the vocabulary have lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, codes, held = [], [], [], 0

        def done() -> pd.DataFrame:
            return pd.DataFrame([{"first": made == 0 and part % stride == 0, **index_block(ids, lengths, codes)}])

        for batch in batches:
            for key, text in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["text"]):
                found = text.translate(TO_TERMS).split()
                coded = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))
                ids.append(None if key is None else int(key))
                lengths.append(len(found))
                codes.append(coded[coded >= 0])
                held += len(text)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield done()
                    ids, lengths, codes, held, made = [], [], [], 0, made + 1
        if ids:
            yield done()

    return run


class Best:
    """The best documents of one item so far, by falling score, then rising id, null ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document below this score is not among the best; one of equal score may be."""
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        scores, ids, named = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.named, named)))
        kept = np.lexsort((ids, ~named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[kept], ids[kept], named[kept]


class Block:
    """An index block with every occurrence's share of a score worked out."""

    def __init__(self, row, n_docs: int, n_terms: int, vocabulary: int):
        self.ids, self.named = np.asarray(row.ids, np.int64), np.asarray(row.named, bool)
        self.docs, self.starts = np.asarray(row.docs, np.int64), np.asarray(row.starts, np.int64)
        lengths, tf = np.asarray(row.lengths, np.int64), np.asarray(row.counts, np.int64)
        m = 25 + (75 * lengths * n_docs) // n_terms
        self.share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        terms = np.asarray(row.terms, np.int64)
        self.place = np.full(vocabulary, -1, np.int64)
        self.place[terms] = np.arange(len(terms))
        self.most = np.maximum.reduceat(self.share, self.starts[:-1]) if len(terms) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Add this block's best documents for the weighted terms.

        The accumulators of the short lists count as one list with the largest of them as bound.
        Lists that together can't reach the least score open no document; a document is given up
        as soon as the lists it has yet to be looked up in can't lift it to that score.
        """
        at = self.place[terms]
        at, weights = at[there := (at >= 0) & (weights > 0)], weights[there]
        if not len(at):
            return
        begins, ends = self.starts[at], self.starts[at + 1]
        short = ends - begins <= max(1, int(len(self.ids) * SHORT_SHARE))
        sums = np.zeros(len(self.ids), np.int64)
        if short.any():
            spans = [slice(a, z) for a, z in zip(begins[short], ends[short])]
            shares = np.concatenate([self.share[s] for s in spans]) * np.repeat(weights[short], (ends - begins)[short])
            np.add.at(sums, np.concatenate([self.docs[s] for s in spans]), shares)
        bounds = (weights * self.most[at])[~short]
        falling = np.argsort(-bounds, kind="stable")
        long = [(slice(begins[~short][i], ends[~short][i]), int(weights[~short][i])) for i in falling]
        bounds = bounds[falling]
        # What the long lists from each on can still add.
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        least, top = best.least, int(sums.max())
        if top + rest[0] < least:
            return
        opens = np.zeros(len(self.ids), bool)
        # Lists by rising bound; those whose bounds together stay below the least score open nothing.
        closed = 0
        for bound, which in sorted([(top, -1), *((int(b), i) for i, b in enumerate(bounds))]):
            closed += bound
            if closed >= least:
                if which < 0:
                    opens |= sums > 0
                else:
                    opens[self.docs[long[which][0]]] = True
        found = np.flatnonzero(opens)
        for step in range(0, len(found), STEP):
            least = best.least
            docs = found[step : step + STEP]
            score = sums[docs]
            for i, (span, weight) in enumerate(long):
                able = score + rest[i] >= least
                docs, score = docs[able], score[able]
                if not len(docs):
                    break
                held = self.docs[span]
                to = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                score = score + np.where(held[to] == docs, self.share[span][to] * weight, 0)
            able = score >= least
            if able.any():
                best.add(score[able], self.ids[docs[able]], self.named[docs[able]])


def _searcher(asked: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, floors: dict, k: int):
    """Index rows to (item, doc_id, score): each task's best documents for every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k, floors.get(i, 0)) for i in range(len(asked))]
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row, n_docs, n_terms, len(weights))
                for (terms, times), top in zip(asked, best):
                    block.search(terms, weights[terms] * times, top)
        for item, top in enumerate(best):
            if len(top.scores):
                ids = pd.Series(top.ids).astype("Int64").where(pd.Series(top.named), pd.NA)
                yield pd.DataFrame({"item": item, "doc_id": ids, "score": top.scores})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_pass(docs: DataFrame, asked: list, k: int, item_type: T.DataType) -> DataFrame:
    """The ranks of some items, given as rows (item_id, term, times) in order of the item."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    items: list = []
    by_item: list[tuple[list, list]] = []
    for row in asked:
        if not items or items[-1] != row.item_id:
            items.append(row.item_id)
            by_item.append(([], []))
        by_item[-1][0].append(vocabulary.setdefault(row.term.encode(), len(vocabulary)))
        by_item[-1][1].append(row.times)
    queries = [(np.asarray(terms, np.int64), np.asarray(times, np.int64)) for terms, times in by_item]

    stride = max(1, docs.rdd.getNumPartitions() // FIRST_BLOCKS)
    path = scratch_path(spark, "inverted")
    docs.mapInPandas(_indexer(vocabulary, stride), INDEX).write.partitionBy("first").parquet(path)
    index = spark.read.schema(INDEX).parquet(path)
    n_docs, n_terms = index.select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l")
    ).agg(F.sum("n"), F.sum("l")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    # One row for each term of the items in this pass.
    lists = F.zip_with("terms", F.sequence(F.lit(0), F.size("terms") - 1), lambda t, i: F.struct(
        t.alias("term"), (F.col("starts")[i + 1] - F.col("starts")[i]).cast("long").alias("df")))
    held = index.filter(F.size("terms") > 0).select(F.inline(lists)).groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in held.collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def search(part: DataFrame, floors: dict) -> DataFrame:
        run = _searcher(queries, weights, n_docs, n_terms, floors, k)
        return part.drop("first").mapInPandas(run, "item int, doc_id long, score long")

    first = _ranked(search(index.filter("first"), {}), k).filter(F.col("rank") == k)
    floors = {row.item: row.score for row in first.collect()} if n_terms else {}
    named = spark.createDataFrame(
        [(i, item) for i, item in enumerate(items)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)])
    )
    found = _ranked(search(index, floors) if n_terms else search(index.limit(0), {}), k)
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k best documents of all, by summed term weights.

    Documents become blocks of an inverted index over the terms that items ask for, one row a
    block; document frequencies and lengths are taken over all of them. Every task searches its
    blocks for every item and keeps k documents of each. Bounds come from a few blocks searched
    first, so they only spare work and change no result. Items beyond 2,048 take further passes.

    A document with null, empty or termless text is never found and not counted. Repeated
    documents are ranked as rows of their own, null ids after all others of their score. Rows of
    one item id, null included, are one item: equal texts count once, different ones together.
    Items without a term, and tables without a document, give no rows. Long texts are read
    whole. Other columns are not read.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    named = items.select(F.col(item_key).alias("item_id"), "text").distinct()
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    asked = named.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(asked, "asked")
    n_items, n_asked = asked.agg(F.count_distinct(F.struct("item_id")), F.count(F.lit(1))).first()
    passes = max(-(-n_items // PASS_ITEMS), -(-n_asked // PASS_TERMS), 1)
    asked = asked.withColumn("_pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    item_type = asked.schema["item_id"].dataType
    out = None
    for number in range(passes):
        rows = asked.filter(F.col("_pass") == number).orderBy("item_id", "term").collect()
        found = _one_pass(texts, rows, k, item_type)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"item_id": item_key, "doc_id": key} if item_key != key else {"item_id": item_key})


SEARCH_SQL = rf"""
WITH said AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}') AS words FROM documents),
held AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM said WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM held),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM held) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11_lexical_search(spark, sf_dir):
    return lexical_search(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
