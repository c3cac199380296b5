"""Toxicity by bags of character n-grams: embeddings averaged per word into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.llm.common import documents, held_out, query, read, text_blocks

#: Documents of each label in the training sample on average; distinct words of one of them.
SAMPLE_DOCS, SAMPLE_WORDS = 1000, 1000
#: Lengths of the n-grams, the rows their hashes share, numbers of an embedding.
SHORTEST, LONGEST, ROWS, WIDTH = 3, 5, 1 << 17, 4
#: A row takes part in training if the sample's documents hold it so often.
SEEN = 4
#: A row's slope is measured against its own size plus this share of the largest one's.
FLOOR = 0.1
THRESHOLD = 0.7
#: How closely the pooling of word logits follows their maximum.
SHARPNESS = 4.0
#: Distinct words whose logits a task keeps at hand, and those worked out together.
KEPT_WORDS, TOGETHER = 500_000, 1 << 14


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all `<word>`, one after the other, and the bounds of each word.

    A word is taken in lower case without the marks at its ends; what has no letter or digit
    keeps its marks. Words sharing a stem, or misspelled in one place, share most n-grams.
    """
    codes, bounds = [], [0]
    for word in words:
        core = strip_marks(word.lower())
        codes.append(f"<{core}>")
        bounds.append(bounds[-1] + len(core) + 2)
    points = np.frombuffer("".join(codes).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    bounds = np.asarray(bounds)
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    left = bounds[1:][owner] - np.arange(len(points))  # characters up to the word's end
    rolling = np.zeros(len(points), dtype=np.uint64)
    grams, owners = [], []
    for n in range(1, LONGEST + 1):
        rolling[: len(points) - n + 1] = rolling[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
        if n >= SHORTEST:
            at = np.flatnonzero(left >= n)
            mixed = rolling[at] ^ (rolling[at] >> np.uint64(29))
            grams.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.int64))
            owners.append(owner[at])
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def strip_marks(word: str) -> str:
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b] or word


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of values, 0 for an empty run."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Model:
    """Embeddings of n-gram rows and a softmax of two classes over their mean.

    The softmax is linear, so a word's logit (toxic against clean) is the mean over its n-grams
    of a number per row; `rows` holds these once the model is trained.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((ROWS, WIDTH)) * 0.1).astype(np.float32)
        self.out = (rng.standard_normal((WIDTH, 2)) * 0.5).astype(np.float32)
        self.bias = np.asarray([1.0, -1.0], dtype=np.float32)
        self.scale, self.shift = 1.0, 0.0

    def rows(self) -> tuple[np.ndarray, float]:
        return (self.embedding @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])

    def logits(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        by_row, shift = self.rows()
        return summed(by_row[grams], bounds) / np.maximum(np.diff(bounds), 1) + shift

    def train(self, docs: list[list[str]], toxic: np.ndarray, steps: int = 90, rate: float = 0.05) -> None:
        """Adam on all documents at once; a document's logit is the softened maximum of its words'."""
        words = sorted({w for d in docs for w in d})
        number = {w: i for i, w in enumerate(words)}
        flat = np.asarray([number[w] for d in docs for w in d], dtype=np.int64)
        ends = np.cumsum([0] + [len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), np.diff(ends))
        all_grams, bounds = word_grams(words)
        ends_of_words = bounds
        word_of_gram = np.repeat(np.arange(len(words)), np.diff(bounds))
        seen = np.bincount(all_grams, np.bincount(flat, minlength=len(words))[word_of_gram], minlength=ROWS)
        often = seen[all_grams] >= SEEN
        used, grams = np.unique(all_grams[often], return_inverse=True)
        per_word, word_of_gram = np.diff(bounds), word_of_gram[often]
        bounds = np.searchsorted(word_of_gram, np.arange(len(words) + 1))
        weight = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
        table = self.embedding[used]
        weights = [table, self.out, self.bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, steps + 1):
            mean = np.stack([summed(table[grams, k], bounds) for k in range(WIDTH)], axis=1) / per_word[:, None]
            logit = mean @ (self.out[:, 1] - self.out[:, 0]) + self.bias[1] - self.bias[0]
            sharp = SHARPNESS * min(1.0, step / (steps / 2))
            x = sharp * logit[flat]
            top = np.maximum.reduceat(x, ends[:-1])
            e = np.exp(x - top[owner])
            total = summed(e, ends)
            pooled = (np.log(total) + top) / sharp
            d_doc = (sigmoid(pooled) - toxic) * weight
            d_logit = np.bincount(flat, d_doc[owner] * e / total[owner], minlength=len(words))
            out = self.out[:, 1] - self.out[:, 0]
            d_out = mean.T @ d_logit
            d_gram = (d_logit / per_word)[word_of_gram]
            d_row = np.bincount(grams, d_gram, minlength=len(used))
            slopes = [
                np.outer(d_row, out) + 1e-6 * table,
                np.stack([-d_out, d_out], axis=1),
                np.asarray([-d_logit.sum(), d_logit.sum()]),
            ]
            for w, (m, v), g in zip(weights, moments, slopes):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                size = np.sqrt(v / (1 - 0.99**step))
                # Rows of rare n-grams move less: what few documents say is weak evidence.
                w -= rate * (m / (1 - 0.9**step)) / (size + FLOOR * size.max() + 1e-12)
        # Rows that no sampled word has carry no evidence either way.
        self.embedding[:] = 0
        self.embedding[used] = table
        best = np.maximum.reduceat(self.logits(all_grams, ends_of_words)[flat], ends[:-1])
        self.calibrate(best, toxic)

    def calibrate(self, best: np.ndarray, toxic: np.ndarray) -> None:
        """Fits score = sigmoid(scale * logit + shift) to the sample, both labels counting alike."""
        weight = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
        a, b = 1.0, 0.0
        for _ in range(300):
            d = (sigmoid(a * best + b) - toxic) * weight
            a, b = max(a - 0.2 * float((d * best).sum()), 1e-3), b - 0.5 * float(d.sum())
        self.scale, self.shift = a, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, key: str) -> tuple[list[list[str]], np.ndarray]:
    """Distinct words and labels of a sample of the rows whose labels may be learned.

    Each label gives about SAMPLE_DOCS documents (all if it has fewer), chosen by a hash of the
    key; of a document with more than SAMPLE_WORDS distinct words, those of the smallest hash.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col(key)) & F.col(key).isNotNull())
    # A key labelled twice counts as toxic if either row says so.
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("_toxic"))
    counts = dict(known.groupBy("_toxic").count().collect())
    draw = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("_toxic") == 1, SAMPLE_DOCS / max(counts.get(1, 0), 1)).otherwise(SAMPLE_DOCS / max(counts.get(0, 0), 1))
    chosen = known.filter(draw < share)  # about 2 * SAMPLE_DOCS rows at any size
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    words = F.slice(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, SAMPLE_WORDS)
    rows = (
        docs.select(F.col(key).alias("_key"), "text")
        .filter(F.col("text").rlike(r"\S"))
        .join(F.broadcast(chosen), "_key")
        .select("_key", "_toxic", F.array_join(words["w"], " ").alias("_words"))
        .distinct()
        .orderBy("_key", "_words")
        .toPandas()
    )
    # A word is kept once, however many documents have it.
    once: dict[str, str] = {}
    return [[once.setdefault(w, w) for w in words.split()] for words in rows["_words"]], rows["_toxic"].to_numpy(dtype=np.int64)


def train(docs: list[list[str]], toxic: np.ndarray) -> Model | None:
    keep = [i for i, d in enumerate(docs) if d]
    docs, toxic = [docs[i] for i in keep], toxic[keep] if len(docs) else toxic
    if len(set(toxic.tolist())) < 2:
        return None
    model = Model()
    model.train(docs, toxic)
    return model


def toxicity_of(docs: DataFrame, labels: DataFrame, key: str = "doc_id"):
    """A function from a text column to a score, learned from the labelled rows that allow it."""
    model = train(*sample(docs, labels, key))
    state = None if model is None else (model.rows(), model.scale, model.shift)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, float] = {}
        for texts in batches:
            scores = np.zeros(len(texts))
            for a, b in text_blocks(texts, 2_000_000) if state is not None else ():
                (by_row, base), scale, shift = state
                bags = [set(t.split()) for t in texts.iloc[a:b]]
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                fresh = list(set().union(*bags).difference(kept))
                for i in range(0, len(fresh), TOGETHER):
                    words = fresh[i : i + TOGETHER]
                    grams, bounds = word_grams(words)
                    logit = summed(by_row[grams], bounds) / np.maximum(np.diff(bounds), 1) + base
                    kept.update(zip(words, logit.tolist()))
                best = np.asarray([max(map(kept.__getitem__, bag), default=-np.inf) for bag in bags])
                some = np.isfinite(best)
                scores[a:b] = np.where(some, sigmoid(scale * np.where(some, best, 0.0) + shift), 0.0)
            yield pd.Series(scores)

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted): toxicity of every whole text, 0 to 1.

    A document's score is that of its most toxic word, by a model trained on the labelled rows
    whose checksum allows it. A null text, and one of white space only, scores 0; so does every
    text if fewer than two labels occur. Rows, also repeated ones, stay; other columns of either
    table are not read.
    """
    score = toxicity_of(docs, labels, key)(F.col("text"))
    rows = docs.select(key, held_out(F.col(key)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
