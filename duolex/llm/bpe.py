"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse."""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.llm.common import documents, query, text_blocks

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how the vocabulary splits a text before merging, with its notion of white space spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct pieces whose ids a task keeps at hand, pieces handled together, and bytes read beyond the lookahead.
KEPT_PIECES, PIECES, STEP = 800_000, 1 << 16, 4096
#: Pieces of up to so many bytes are merged without a heap.
SHORT = 32
#: Characters of a text whose pieces are listed at once.
LONG = 1 << 20
NEVER = (1 << 60, -1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printing else next(others)) for b in range(256)]


class Merges:
    """Ranked merges of byte strings. Ids are positions in `tokens`; `pairs` maps two ids to (rank, id)."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int]]):
        self.tokens = tokens
        by_bytes = {b: i for i, b in tokens.items()}
        self.single = [by_bytes.get(bytes([b])) for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((a, b), (rank, by_bytes[tokens[a] + tokens[b]]))
        self.lookahead = self._sufficient_lookahead(merges)
        self.step = max(STEP, *map(len, tokens.values()))

    def _sufficient_lookahead(self, merges: list[tuple[int, int]]) -> int:
        """Bytes beyond the end of a token after which nothing can change it any more.

        Whether (a, b) is merged depends on what follows b only if a merge of earlier rank takes b
        away, (b, c), or the last part of b from it while b is made; whether that one is done depends
        on what follows c in the same way. Ranks fall along such a chain, so one pass in rank order
        finds the longest one.
        """
        length = {i: len(t) for i, t in self.tokens.items()}
        inside: dict[int, int] = {}  # what a token's own making can depend on beyond its end
        taken: dict[int, int] = {}  # the same for merges that have the token on their left
        longest = 0
        for a, b in merges:
            beyond = max(inside.get(b, 0), taken.get(b, 0))
            made = self.pairs[a, b][1]
            inside[made] = max(inside.get(made, 0), beyond)
            taken[a] = max(taken.get(a, 0), length[b] + beyond)
            longest = max(longest, length[b] + beyond)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Ids of a whole byte string: the merge of lowest rank first, the leftmost of equals."""
        ids = [self.single[b] for b in data]
        if len(ids) <= SHORT:
            return self._merge_short(ids)
        n, pairs = len(ids), self.pairs
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heap = [(rank, i, made, p) for rank, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, (a, b) = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in pairs:
                    rank, new = pairs[p]
                    heapq.heappush(heap, (rank, x, new, p))
        return [t for t, here in zip(ids, alive) if here]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same by looking at all pairs again after each merge, quicker for a few bytes."""
        ranked = [self.pairs.get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranked and (best := min(ranked)) is not NEVER:
            i = ranked.index(best)
            ids[i : i + 2] = [best[1]]
            del ranked[i]
            if i < len(ranked):
                ranked[i] = self.pairs.get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranked[i - 1] = self.pairs.get((ids[i - 1], ids[i]), NEVER)
        return ids

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """The same ids in runs: no more than a step and the lookahead is held at a time.

        A token is passed on once the lookahead lies behind it. What follows a token's end is
        merged as if it stood alone, so the next window starts there.
        """
        at = 0
        while at < len(data):
            end = at + self.step + self.lookahead
            ids = self.merge(data[at:end])
            if end >= len(data):
                yield ids
                return
            stable, upto = [], at
            for token in ids:
                if upto + len(self.tokens[token]) > end - self.lookahead:
                    break
                stable.append(token)
                upto += len(self.tokens[token])
            yield stable
            at = upto


class Encoder:
    """Text to ids: split at special tokens, then into pieces, each piece through the transducer."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            stored = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab = stored["model"]["vocab"]
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.merges = Merges(tokens, [(vocab[a], vocab[b]) for a, b in stored["model"]["merges"]])
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.tokens = tokens | {i: t.encode() for t, i in self.special.items()}
        self.pieces = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        runs = self.merges.stream(data) if len(data) > SHORT else [self.merges.merge(data)]
        return b"".join(pack(f"<{len(run)}i", *run) for run in runs)

    def _segment(self, text: str) -> Iterator[bytes]:
        # One by one for a long text, so that its pieces are never held together.
        found = iter(self.pieces.findall(text)) if len(text) <= LONG else (m.group() for m in self.pieces.finditer(text))
        kept = self.kept
        while pieces := list(islice(found, PIECES)):
            if len(kept) > KEPT_PIECES:
                kept.clear()
            for piece in set(pieces).difference(kept):
                kept[piece] = self._piece(piece)
            yield b"".join(map(kept.__getitem__, pieces))

    def __call__(self, text: str) -> np.ndarray:
        parts = []
        for segment in self.cut.split(text) if any(s in text for s in self.special) else [text]:
            if segment in self.special:
                parts.append(np.asarray([self.special[segment]], dtype="<i4").tobytes())
            else:
                parts.extend(self._segment(segment))
        return np.frombuffer(b"".join(parts), dtype="<i4")


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(vocabulary)


class Decoder:
    """Ids to text: bytes enter a machine that gives out characters as they become complete.

    Bytes that are no UTF-8 give one replacement character for each broken run.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]

    def __call__(self, ids: np.ndarray) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        parts = []
        for i in range(0, len(ids), PIECES):
            parts.append(machine.decode(b"".join(map(self.tokens.__getitem__, ids[i : i + PIECES].tolist()))))
        return "".join(parts) + machine.decode(b"", True)


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids): token ids of each whole text; `decoded` adds `text`, what these ids decode to.

    A null or empty text has no ids; rows, also repeated ones, stay; other columns are not read.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(vocabulary)
        decoder = Decoder(encoder.tokens)
        for frame in frames:
            for a, b in text_blocks(frame["text"], 2_000_000):
                ids = [encoder(t) for t in frame["text"].iloc[a:b]]
                out = pd.DataFrame({key: frame[key].iloc[a:b], "ids": ids})
                yield out.assign(text=[decoder(i) for i in ids]) if decoded else out

    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(encode, f"`{key}` {kind}, ids array<int>" + ", text string" * decoded)


def decode_ids(rows: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, ids, text): the text of each row's ids, special tokens included; null ids count as none."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(worker_encoder(vocabulary).tokens)
        for frame in frames:
            for a in range(0, len(frame), 512):
                part = frame.iloc[a : a + 512]
                yield part.assign(text=[decoder(np.asarray(ids)) for ids in part["ids"]])

    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInPandas(decode, f"`{key}` {kind}, ids array<int>, text string")


@query("op8_bpe")
def op8_bpe(spark, sf_dir):
    rows = encode_texts(documents(spark, sf_dir), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
