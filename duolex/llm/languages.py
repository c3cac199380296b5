"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.llm.common import documents, held_out, joined_bytes, query, text_blocks
from duolex.operators.joins import join_small

UNKNOWN = "und"
#: Documents a language gives to the training sample on average, pieces of each, characters of a piece.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE = 400, 4, 64
#: Documents of the whole sample; with more than 64 languages each gives an equal part of them.
SAMPLE_ALL = 64 * SAMPLE_DOCS
HIDDEN = 8
#: Bytes that one run of the network covers; a text is cut into as many runs as it needs.
RUN = 256
#: Bytes labelled together by a task.
BLOCK = 1 << 19


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated recurrent layer; its inputs are bytes, so input weights are a table of rows."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)  # row 256: past the end
        self.inner = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """States after each byte of x (time, batch); `keep`: also what backward() needs."""
        steps, batch = x.shape
        n = self.inner.shape[0]
        h = np.zeros((batch, n), dtype=np.float32)
        states = np.empty((steps, batch, n), dtype=np.float32)
        kept = []
        for t in range(steps):
            given, own = self.table[x[t]], h @ self.inner
            gates = sigmoid(given[:, : 2 * n] + own[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(given[:, 2 * n :] + r * own[:, 2 * n :])
            if keep:
                kept.append((h, z, r, c, own[:, 2 * n :]))
            h = h + z * (c - h)
            states[t] = h
        return states, kept

    def backward(self, x: np.ndarray, kept, d_states: np.ndarray) -> list[np.ndarray]:
        n = self.inner.shape[0]
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        dh = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, own = kept[t]
            dh = dh + d_states[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * own * r * (1 - r)
            d_given = np.concatenate([dz, dr, dc], axis=1)
            d_own = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(d_table, x[t], d_given)
            d_inner += h.T @ d_own
            dh = dh * (1 - z) + d_own @ self.inner.T
        return [d_table, d_inner]


class Network:
    """Both directions and a softmax over languages at every byte."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, classes)) * 0.3).astype(np.float32)
        self.bias = np.zeros(classes, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.inner, self.back.table, self.back.inner, self.out, self.bias]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, class) for x (time, batch)."""
        states = np.concatenate([self.ahead.forward(x)[0], self.back.forward(x[::-1])[0][::-1]], axis=2)
        return softmax(states @ self.out + self.bias)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all bytes but the filler, y being the class of each column."""
        first, kept_first = self.ahead.forward(x, True)
        second, kept_second = self.back.forward(x[::-1], True)
        states = np.concatenate([first, second[::-1]], axis=2)
        d = softmax(states @ self.out + self.bias)
        d[:, np.arange(x.shape[1]), y] -= 1
        d *= (x < 256)[:, :, None] / np.float32(max((x < 256).sum(), 1))
        n = first.shape[2]
        d_states = d @ self.out.T
        return [
            *self.ahead.backward(x, kept_first, d_states[:, :, :n]),
            *self.back.backward(x[::-1], kept_second, d_states[::-1, :, n:]),
            np.einsum("tbi,tbj->ij", states, d),
            d.sum(axis=(0, 1)),
        ]


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    p /= p.sum(axis=-1, keepdims=True)
    return p


def runs(bounds: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of each run of at most `run` bytes."""
    sizes = np.diff(bounds)
    count = -(-sizes // run)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = bounds[:-1][owner] + number * run
    return owner, begin, np.minimum(begin + run, bounds[1:][owner])


def columns(data: np.ndarray, begin: np.ndarray, end: np.ndarray, run: int) -> np.ndarray:
    """Runs of bytes as columns (time, batch), filled up with 256."""
    at = begin[None, :] + np.arange(run)[:, None]
    x = np.full(at.shape, 256, dtype=np.int16)
    inside = at < end[None, :]
    x[inside] = data[at[inside]]
    return x


def train(pieces: list[str], labels: np.ndarray, classes: int, steps: int = 500, batch: int = 128) -> Network:
    """Backpropagation through time with Adam over pieces of text; the same sample gives the same network."""
    net = Network(classes)
    weights = net.weights()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    order = np.random.default_rng(11)
    data, bounds = joined_bytes(pieces)
    sizes = np.diff(bounds)
    members = [np.flatnonzero((labels == c) & (sizes > 0)) for c in range(classes)]
    members = [m for m in members if len(m)]
    for step in range(1, steps + 1):
        # As many of each language, so that rare ones are learned too.
        chosen = np.concatenate([order.choice(m, max(1, batch // len(members))) for m in members])
        x = np.full((PIECE, len(chosen)), 256, dtype=np.int16)
        for column, i in enumerate(chosen):
            size = min(PIECE, sizes[i])
            x[:size, column] = data[bounds[i] : bounds[i] + size]
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, (m, v), g in zip(weights, moments, net.gradients(x, labels[chosen])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """Mean over all bytes of each text of the class probabilities; zeros for a text without bytes."""
    data, bounds = joined_bytes(texts)
    classes = len(net.bias)
    total = np.zeros((len(texts), classes))
    owner, begin, end = runs(bounds, RUN)
    width = max(1, BLOCK // RUN)
    for a in range(0, len(owner), width):
        part = columns(data, begin[a : a + width], end[a : a + width], RUN)
        p = net.probabilities(part) * (part < 256)[:, :, None]
        by_run = p.sum(axis=0)
        for c in range(classes):
            total[:, c] += np.bincount(owner[a : a + width], by_run[:, c], minlength=len(texts))
    return total / np.maximum(np.diff(bounds), 1)[:, None]


def sample_pieces(docs: DataFrame, key: str) -> tuple[list[str], np.ndarray, list[str]]:
    """Pieces of a sample of the labelled rows that may be learned from, their labels, the languages.

    Every language gives about SAMPLE_DOCS documents (all if it has fewer, and an equal part of
    SAMPLE_ALL if there are many languages), chosen by a hash of the key and at least the one of
    smallest hash, and each of them pieces from hashed places of its text.
    """
    known = docs.filter(~held_out(F.col(key)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select(F.col(key).alias("_key"), "lang", "text")
    draw = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(draw).alias("least"))
    each = min(SAMPLE_DOCS, SAMPLE_ALL / max(counts.count(), 1))
    chosen = join_small(known, counts, "lang").filter((draw < F.lit(float(each)) / F.col("count")) | (draw == F.col("least")))
    span = F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    places = [F.substring("text", (F.pmod(F.xxhash64("_key", F.lit(i)), span) + 1).cast("int"), F.lit(PIECE)) for i in range(SAMPLE_PIECES)]
    rows = chosen.select("lang", F.explode(F.array(*places)).alias("piece")).distinct().orderBy("lang", "piece").toPandas()
    languages = sorted(set(rows["lang"]))
    return list(rows["piece"]), rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), languages


def language_of(docs: DataFrame, key: str = "doc_id"):
    """A function from a text column to (lang_pred, score), learned from the rows of `docs` that allow it."""
    pieces, labels, languages = sample_pieces(docs, key)
    net = train(pieces, labels, len(languages)) if languages else None

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, letters in batches:
            said, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for a, b in text_blocks(texts, BLOCK) if net is not None else ():
                p = pooled(net, texts.iloc[a:b])
                some = letters.iloc[a:b].to_numpy()
                said[a:b] = np.where(some, np.asarray(languages, dtype=object)[p.argmax(axis=1)], UNKNOWN)
                score[a:b] = np.where(some, p.max(axis=1), 0.0)
            yield pd.DataFrame({"lang_pred": said, "score": score})

    def column(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return label(text, text.rlike(r"\p{L}"))

    column.languages = languages
    return column


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score): the language of every whole text.

    Learned from the labelled rows whose checksum allows it; a prediction sees the text alone.
    The score is the mean probability, over all bytes, of the language with the highest mean.
    Null texts and such without a letter are `und` with score 0, and so is every text if there is
    nothing to learn from. Rows, also repeated ones, stay; other columns are not read.
    """
    said = language_of(docs, key)(F.col("text"))
    rows = docs.select(key, held_out(F.col(key)).alias("held_out"), said.alias("said"))
    return rows.select(key, "held_out", "said.lang_pred", "said.score")


@query("op10_language")
def op10_language(spark, sf_dir):
    return identify(documents(spark, sf_dir))
