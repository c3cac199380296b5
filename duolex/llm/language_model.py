"""Scores texts by a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class after the words before it, times that of its leaf within
the class after them, times its share of the leaf. The first two are softmaxes over hashed n-gram
and skip features, the last one over the words' own counts. Words fall into classes by a hash of
their last two bytes and into leaves by one of their last four, so words with like endings are
together; words seen once and unseen ones share a class of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolex.llm.common import documents, query
from duolex.session import materialize

#: A block of coded documents ends after so many bytes of text.
BLOCK_BYTES = 16_000_000
#: Leaves of a class, and classes; one more class is for words seen once or never, so that both
#: tables of weights have rows of the same width.
LEAVES = 16
CLASSES = LEAVES - 1
RARE = CLASSES
#: Rows of the two hashed tables of weights: the model's size, which no input changes.
CLASS_ROWS = 1 << 17
LEAF_ROWS = 1 << 16
#: Every training token is learned from once, in so many rounds between which weights are averaged.
ROUNDS = 2
#: Tokens that a training task has about, and that are learned from or scored together.
TASK_TOKENS = 16_000_000
BATCH = 32_768
RATE = 0.3
#: Squared gradient that a row starts with, and that a past token counts for.
START, PAST = 1.0, 0.03

#: The end of a text; no word holds white space.
END = " "
#: Stands before the first word of a text, and for every rare word.
BEFORE, SELDOM = 0x9E3779B1, 0x85EBCA77

CODED = (
    "block long, ids array<long>, named array<boolean>, held_out array<boolean>, sizes array<int>, "
    "codes binary, wide binary, hashes array<long>, leaves binary, trained array<long>"
)
#: Codes from this on, those of a block's rarest words, are stored apart with four bytes each.
WIDE = (1 << 16) - 1


def leaf_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES * LEAVES + zlib.crc32(word[-4:]) % LEAVES


def _coder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, held_out, text) to blocks of documents, coded by the words of the block, most frequent first.

    Words leave the block as 64-bit hashes: two of n words share one with probability n^2 / 2^65.
    """
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 33
    end = END.encode()

    def fresh():
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        return place, [], [], [], [], 0

    place, ids, held_out, sizes, codes, held = fresh()

    def done() -> pd.DataFrame:
        coded = np.concatenate(codes)
        order = np.argsort(-np.bincount(coded, minlength=len(place)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        coded = rank[coded]
        learned = np.repeat(~np.asarray(held_out, bool), sizes)
        words = list(place)
        words = [words[i] for i in order]
        return pd.DataFrame([{
            "block": block, "ids": [0 if i is None else i for i in ids], "named": [i is not None for i in ids],
            "held_out": held_out, "sizes": sizes, "codes": np.minimum(coded, WIDE).astype(np.uint16).tobytes(),
            "wide": coded[coded >= WIDE].astype(np.uint32).tobytes(),
            "hashes": np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64),
            "leaves": bytes(map(leaf_of, words)), "trained": np.bincount(coded[learned], minlength=len(words)),
        }])

    for batch in batches:
        keys = batch["id"].astype(object).where(batch["id"].notna(), None)
        for key, out, text in zip(keys, batch["held_out"], batch["text"]):
            found = text.lower().split()
            found.append(end)
            ids.append(None if key is None else int(key))
            held_out.append(bool(out))
            sizes.append(len(found))
            codes.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
            held += len(text)
            if held >= BLOCK_BYTES:
                yield done()
                block += 1
                place, ids, held_out, sizes, codes, held = fresh()
    if ids:
        yield done()


class Shares:
    """What is known of all training tokens: counts of counts and of leaves."""

    def __init__(self, tokens: int, distinct: int, once: int, twice: int, leaves: dict[int, int]):
        self.tokens, self.distinct, self.once = tokens, distinct, once
        self.leaves = np.asarray([leaves.get(i, 0) for i in range(CLASSES * LEAVES)], dtype=np.float64)
        # What words seen once and twice say of unseen ones: the rare class is split between them.
        unseen = (once + 1) / (once + 2 * twice + 2)
        self.unseen, self.single = np.log(unseen), np.log1p(-unseen) - np.log(max(once, 1))

    def within(self, counts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Log probability of words within their leaf or the rare class, from their counts."""
        often = np.log(np.maximum(counts, 1)) - np.log(np.maximum(self.leaves[np.maximum(leaves, 0)], 1))
        return np.where(counts > 1, often, np.where(counts == 1, self.single, self.unseen))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights without a feature: log shares of the classes, and of the leaves within each."""
        leaves = self.leaves.reshape(CLASSES, LEAVES) + 0.5
        classes = np.append(leaves.sum(1), self.once + 0.5)
        return np.log(classes / classes.sum()).astype(np.float32), np.log(leaves / leaves.sum(1, keepdims=True)).astype(np.float32)


def _mixed(a: np.ndarray, salt: int, rows: int, b: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of one or two 32-bit values under a salt, below a power of two."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15)
        x ^= (np.asarray(b).astype(np.uint64) + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(40)).astype(np.uint32) & np.uint32(rows - 1)


class Tokens:
    """The tokens of a block in order: what each is, and the hashed features before it."""

    def __init__(self, row):
        sizes = np.asarray(row.sizes, np.int64)
        code = np.frombuffer(row.codes, np.uint16).astype(np.int32)
        code[code == WIDE] = np.frombuffer(row.wide, np.uint32)
        leaves = np.frombuffer(row.leaves, np.uint8).astype(np.int16)
        counts = np.zeros(len(leaves), np.int64)
        counts[np.asarray(row.at, np.int64)] = np.asarray(row.known, np.int64) >> 1
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.held_out = np.repeat(np.asarray(row.held_out, bool), sizes)
        self.counts, self.leaves = counts[code], np.where(counts > 1, leaves, np.int16(-1))[code]
        self.hashes = np.where(counts > 1, np.asarray(row.marks), SELDOM).astype(np.uint32)[code]

    def before(self, by: int) -> np.ndarray:
        """Hash of the word so many places before each token of the same text."""
        out = np.empty(len(self.hashes), np.uint64)
        out[by:] = self.hashes[:-by]
        for i in range(by):
            out[self.starts[self.sizes > i] + i] = BEFORE
        return out


class Model:
    """The two softmaxes: rows of weights by hashed feature, beside priors without a feature."""

    def __init__(self, shares: Shares, by_class: np.ndarray | None = None, by_leaf: np.ndarray | None = None):
        self.class_prior, self.leaf_prior = shares.priors()
        self.by_class = np.zeros((CLASS_ROWS, CLASSES + 1), np.float32) if by_class is None else by_class.copy()
        self.by_leaf = np.zeros((LEAF_ROWS, LEAVES), np.float32) if by_leaf is None else by_leaf.copy()

    @staticmethod
    def class_features(one, two) -> list[np.ndarray]:
        """The word before, the two before, and the one before that by itself."""
        return [_mixed(h, salt, CLASS_ROWS, other) for h, salt, other in ((one, 1, 0), (one, 2, two), (two, 3, 0))]

    @staticmethod
    def leaf_features(one, which) -> list[np.ndarray]:
        """The word before, for each class by itself."""
        return [_mixed(one, 4, LEAF_ROWS, which)]

    @staticmethod
    def _summed(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
        out = weights.take(features[0], axis=0)
        for f in features[1:]:
            out += weights.take(f, axis=0)
        return out

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def classes(self, features: list[np.ndarray]) -> np.ndarray:
        scores = self._summed(self.by_class, features)
        scores += self.class_prior
        return self._softmax(scores)

    def leaves(self, features: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        scores = self._summed(self.by_leaf, features)
        scores += self.leaf_prior.take(which, axis=0)
        return self._softmax(scores)

    def log_scores(self, tokens: Tokens, shares: Shares) -> np.ndarray:
        """Natural log probability of every token."""
        out = shares.within(tokens.counts, tokens.leaves)
        contexts = [tokens.before(i) for i in (1, 2)]
        for a in range(0, len(out), BATCH):
            one, two = (c[a : a + BATCH] for c in contexts)
            leaf = tokens.leaves[a : a + BATCH]
            which = np.where(leaf < 0, RARE, leaf // LEAVES).astype(np.int64)
            p = self.classes(self.class_features(one, two))
            out[a : a + BATCH] += np.log(p[np.arange(len(leaf)), which].astype(np.float64))
            some = np.flatnonzero(leaf >= 0)
            p = self.leaves(self.leaf_features(one[some], which[some]), which[some])
            out[a + some] += np.log(p[np.arange(len(some)), leaf[some] % LEAVES].astype(np.float64))
        return out


class Learner:
    """Gradient steps from given weights, with the tokens that each row of weights has learned from."""

    def __init__(self, model: Model, past_class: np.ndarray, past_leaf: np.ndarray):
        self.model = model
        self.squares = [(START + PAST * past).astype(np.float32) for past in (past_class, past_leaf)]
        self.seen = [np.zeros(CLASS_ROWS, np.int64), np.zeros(LEAF_ROWS, np.int64)]

    def _step(self, table: int, features: list[np.ndarray], gradient: np.ndarray) -> None:
        weights, squares = (self.model.by_class, self.model.by_leaf)[table], self.squares[table]
        for f in features:
            # Row and place in one number, whose plain sort is much faster than sorting places.
            ordered = np.sort(f.astype(np.uint64) * np.uint64(BATCH) + np.arange(len(f), dtype=np.uint64))
            order, ordered = (ordered % np.uint64(BATCH)).astype(np.int64), (ordered // np.uint64(BATCH)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            rows, sums = ordered[starts], np.add.reduceat(gradient.take(order, axis=0), starts, axis=0)
            grown = squares[rows] + np.einsum("ij,ij->i", sums, sums) / np.float32(sums.shape[1])
            squares[rows] = grown
            sums *= (RATE / np.sqrt(grown))[:, None]
            weights[rows] -= sums
            self.seen[table][rows] += np.diff(np.append(starts, len(f)))

    def learn(self, tokens: Tokens) -> None:
        contexts = [tokens.before(i) for i in (1, 2)]
        kept = np.flatnonzero(~tokens.held_out)
        for a in range(0, len(kept), BATCH):
            at = kept[a : a + BATCH]
            one, two = (c[at] for c in contexts)
            leaf = tokens.leaves[at]
            which = np.where(leaf < 0, RARE, leaf // LEAVES).astype(np.int64)
            features = self.model.class_features(one, two)
            gradient = self.model.classes(features)
            gradient[np.arange(len(at)), which] -= 1
            self._step(0, features, gradient)
            some = np.flatnonzero(leaf >= 0)
            if len(some):
                features = self.model.leaf_features(one[some], which[some])
                gradient = self.model.leaves(features, which[some])
                gradient[np.arange(len(some)), leaf[some] % LEAVES] -= 1
                self._step(1, features, gradient)


WIDTH = LEAVES
WEIGHTS = ", ".join(["row int", "seen long", *[f"w{i} double" for i in range(WIDTH)]])


def _trainer(shares: Shares, by_class: np.ndarray, by_leaf: np.ndarray, past: np.ndarray):
    """Blocks to the rows of weights a task changed, each times the tokens it learned from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner = Learner(Model(shares, by_class, by_leaf), past[:CLASS_ROWS], past[CLASS_ROWS:])
        for batch in batches:
            for row in batch.itertuples(index=False):
                learner.learn(Tokens(row))
        for table, (weights, first) in enumerate(((learner.model.by_class, 0), (learner.model.by_leaf, CLASS_ROWS))):
            changed = np.flatnonzero(learner.seen[table])
            for begin in range(0, len(changed), BATCH):
                rows = changed[begin : begin + BATCH]
                seen = learner.seen[table][rows]
                values = weights[rows] * seen[:, None].astype(np.float64)
                yield pd.DataFrame({"row": rows + first, "seen": seen, **{f"w{i}": values[:, i] for i in range(WIDTH)}})

    return run


def _scorer(shares: Shares, by_class: np.ndarray, by_leaf: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shares, by_class, by_leaf)
        for batch in batches:
            for row in batch.itertuples(index=False):
                tokens = Tokens(row)

                def summed(x: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(x, tokens.starts)

                ids = pd.Series(np.asarray(row.ids, np.int64)).astype("Int64").where(pd.Series(np.asarray(row.named, bool)), pd.NA)
                yield pd.DataFrame({
                    "doc_id": ids, "held_out": np.asarray(row.held_out, bool), "n_tokens": tokens.sizes,
                    "n_known": summed((tokens.counts > 0).astype(np.int64)), "train_tokens": shares.tokens,
                    "base_score": summed(shares.base(tokens.counts)),
                    "score": summed(model.log_scores(tokens, shares)) / np.log(10),
                })

    return run


@contextmanager
def a_block_a_batch(spark: SparkSession):
    """Within, tasks hand Python one row at a time: a block is a row, and many at once would be too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block and leaf (rare words apart as -1): tokens, words, and words seen once and twice."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            known, at = np.asarray(row.known, np.int64), np.asarray(row.at, np.int64)
            # Each word is counted in one of the blocks that hold it.
            here = (known & 1 == 1) & (known > 1)
            count = known[here] >> 1
            leaf = np.where(count > 1, np.frombuffer(row.leaves, np.uint8)[at[here]].astype(np.int64), -1)
            sums = [np.bincount(leaf + 1, weights=w, minlength=CLASSES * LEAVES + 1).astype(np.int64) for w in (count, count > 0, count == 1, count == 2)]
            yield pd.DataFrame({"leaf": np.arange(-1, CLASSES * LEAVES), **dict(zip(("tokens", "distinct", "once", "twice"), sums))})


def coded_blocks(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Shares]:
    """Stored blocks of coded documents with the counts of their words, and what is known of all training tokens."""
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))
    texts = docs.select(
        F.col(key).cast("long").alias("id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    coded = materialize(texts.mapInPandas(_coder, CODED), "coded")
    # Each block sends every word once and gets its count over all of them back, so that no task needs
    # the whole vocabulary. The lowest bit marks one of the blocks that hold a word.
    pairs = F.arrays_zip(F.col("hashes").alias("hash"), F.col("trained").alias("n"))
    each = coded.select("block", F.posexplode(pairs).alias("at", "word")).select("block", "at", "word.hash", "word.n")
    word = Window.partitionBy("hash")
    known = F.sum("n").over(word) * 2 + (F.row_number().over(word.orderBy("block")) == 1).cast("long")
    lists = each.select("block", F.struct("at", known.alias("known")).alias("known"))
    lists = lists.groupBy("block").agg(F.collect_list("known").alias("known")).select("block", "known.at", "known.known")
    marks = F.transform("hashes", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("marks")
    blocks = coded.select("block", "ids", "named", "held_out", "sizes", "codes", "wide", "leaves", marks).join(lists, "block")
    blocks = materialize(blocks, "blocks")
    tallied = blocks.select("leaves", "at", "known").mapInPandas(_tallies, "leaf int, tokens long, distinct long, once long, twice long")
    tallied = tallied.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in ("tokens", "distinct", "once", "twice")])
    # A row for each leaf.
    with a_block_a_batch(docs.sparkSession):
        by_leaf = {r.leaf: r for r in tallied.collect()}
    sums = [sum(r[c] for r in by_leaf.values()) for c in ("tokens", "distinct", "once", "twice")]
    return blocks, Shares(*sums, {leaf: r.tokens for leaf, r in by_leaf.items() if leaf >= 0})


def train(blocks: DataFrame, shares: Shares) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the two softmaxes, learned from every training token once.

    In each round tasks start from the same weights and step through their blocks; a row's new
    weights are the tasks' mean, weighed by how many tokens taught it. Rows are added up by their
    number, so no task or group holds more than a share of the fixed-size tables.
    """
    by_class, by_leaf = np.zeros((CLASS_ROWS, CLASSES + 1), np.float32), np.zeros((LEAF_ROWS, LEAVES), np.float32)
    past = np.zeros(CLASS_ROWS + LEAF_ROWS)
    columns = ["sizes", "held_out", "codes", "wide", "leaves", "marks", "at", "known"]
    for number in range(ROUNDS):
        part = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == number).select(*columns)
        part = part.coalesce(max(1, -(-shares.tokens // (ROUNDS * TASK_TOKENS))))
        changed = part.mapInPandas(_trainer(shares, by_class, by_leaf, past), WEIGHTS)
        summed = changed.groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(WIDTH)])
        # As many rows as the tables have, at most; by Arrow, as they would be many objects one by one.
        with a_block_a_batch(blocks.sparkSession):
            summed = materialize(summed, "weights")
        new = summed.toArrow()
        rows, seen = (np.asarray(new[c]) for c in ("row", "seen"))
        mean = np.empty((len(rows), WIDTH), np.float32)
        for i in range(WIDTH):
            mean[:, i] = np.asarray(new[f"w{i}"]) / np.maximum(seen, 1)
        leaf = rows >= CLASS_ROWS
        by_class[rows[~leaf]] = mean[~leaf, : CLASSES + 1]
        by_leaf[rows[leaf] - CLASS_ROWS] = mean[leaf, :LEAVES]
        past[rows] += seen
    return by_class, by_leaf


def language_scores(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole text.

    Counts, classes and weights come from all rows whose checksum allows it (null ids included);
    `score` is the model's, `base_score` that of add-a-half unigrams. A null or empty text is its
    end alone, and one of any length is read whole. Repeated rows are learned from and scored each.
    Without a training row nothing is known and the model knows its priors only. An empty table
    gives no rows; other columns are not read.
    """
    blocks, shares = coded_blocks(docs, key)
    by_class, by_leaf = train(blocks, shares)
    scored = blocks.mapInPandas(
        _scorer(shares, by_class, by_leaf),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    with a_block_a_batch(docs.sparkSession):
        scored = materialize(scored, "scores")
    return scored.withColumnRenamed("doc_id", key)


@query("op13_language_model")
def op13_language_model(spark, sf_dir):
    return language_scores(documents(spark, sf_dir))
