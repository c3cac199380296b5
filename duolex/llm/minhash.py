"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.llm.common import documents, query, text_blocks
from duolex.llm.components import components
from duolex.session import materialize

#: Two sets of similarity 0.8 share no band with a probability of (1 - 0.8^5)^36 < 1e-6.
BANDS, WIDTH = 36, 5
COORDINATES = BANDS * WIDTH
#: Where a bucket holds several components, its members are compared by sketches of so many
#: coordinates, a byte each; a pair is verified if its similarity can be reached within five deviations.
FINE, DEVIATIONS = 1024, 5
#: The first so many of these are compared first.
FIRST = 128
#: Members of a bucket that are compared with as many others in one go.
CHUNK = 256
#: Bytes of text that are hashed together.
BLOCK = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

_bytes = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[32, *range(9, 14)]] = True
_seeds = np.random.default_rng(21).integers(0, 2**63, 2 * max(COORDINATES, FINE), dtype=np.uint64)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=32)
def powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of some bytes, in order."""
    space = _space[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = 1 << max(12, int(len(data)).bit_length())
    terms = _bytes[_lower[data]] * powers(BASE, size)[: len(data)]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix((total[end] - total[begin]) * powers(INVERSE, size)[begin] + (end - begin).astype(np.uint64))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text; one of all words if it has fewer."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    parts, at = [], 0
    while len(data) - at > BLOCK:
        # Long texts are hashed in parts that end at white space.
        cut = np.flatnonzero(_space[data[at : at + BLOCK]])
        upto = at + (int(cut[-1]) if len(cut) and cut[-1] else min(len(data) - at, int(np.append(np.flatnonzero(_space[data[at + BLOCK :]]), len(data))[0]) + BLOCK))
        parts.append(word_hashes(data[at:upto]))
        at = upto
    parts.append(word_hashes(data[at:]))
    hashes = np.concatenate(parts)
    if not len(hashes):
        return hashes
    span = min(words, len(hashes))
    run = np.full(len(hashes) - span + 1, np.uint64(span), dtype=np.uint64)
    for i in range(span):
        run = mix(run * np.uint64(BASE) + hashes[i : len(hashes) - span + 1 + i])
    return np.unique(run)


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One value for each coordinate, equal between two sets with the probability of their similarity.

    Round after round deals all elements to random coordinates, later ones to one coordinate each,
    so that after as many rounds again every coordinate is filled. A coordinate takes the smallest
    value of the first round that reaches it. Rounds are run in groups large enough to fill all
    coordinates at once nearly always; the number of a round leads its values, so that groups and
    single rounds give the same.
    """
    best = np.full(t, np.uint64(2**64 - 1))
    at, group = 0, max(1, -(-8 * t // len(elements)))
    while at < 2 * t:
        rounds = np.arange(at, min(at + group, 2 * t))
        values = mix(elements[None, :] ^ _seeds[rounds][:, None])
        places = np.where(rounds[:, None] < t, values % np.uint64(t), (rounds[:, None] - t) % t).astype(np.int64)
        keys = (rounds.astype(np.uint64)[:, None] << np.uint64(52)) | (values >> np.uint64(12))
        np.minimum.at(best, places.ravel(), keys.ravel())
        at += group
        if (best != np.uint64(2**64 - 1)).all():
            break
    return best


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_digest, n_shingles, digest, bands): band keys of each whole text; nulls where it has no word."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in text_blocks(frame["text"], 4_000_000):
                rows = []
                for text in frame["text"].iloc[a:b]:
                    found = shingles(text, words)
                    if not len(found):
                        rows.append((0, None, None))
                        continue
                    keys = np.arange(1, BANDS + 1, dtype=np.uint64)  # so that bands don't meet each other
                    for column in mix(sketch(found)).reshape(BANDS, WIDTH).T:
                        keys = mix(keys * np.uint64(BASE) + column)
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    rows.append((len(found), digest, keys.view(np.int64)))
                out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands"])
                yield out.assign(**{c: frame[c].iloc[a:b].to_numpy() for c in ("doc_id", "text_digest")})

    rows = identified(docs)
    return rows.mapInPandas(work, "n_shingles long, digest binary, bands array<long>, doc_id long, text_digest binary")


def identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text.cast("binary"))).alias("text_digest"), text.alias("text"))


@lru_cache(maxsize=256)
def exact_set(text: str, words: int) -> frozenset:
    found = WORD.findall(text.translate(UPPER))
    span = min(words, len(found))
    return frozenset(zip(*(found[i:] for i in range(span))))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets of word runs are similar enough."""

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for one, two in zip(frame["text_a"], frame["text_b"]):
                x, y = exact_set(one, words), exact_set(two, words)
                common = len(x & y)
                kept.append(100 * common >= percent * (len(x) + len(y) - common))
            yield frame.loc[kept, ["a", "b"]]

    first = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    # Stored texts are several times smaller than what a join would send.
    pairs = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(confirm, "a long, b long")


def fine_marks(texts: DataFrame, words: int) -> DataFrame:
    """(class, marks): a byte of each coordinate of a longer sketch."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = [mix(sketch(shingles(t, words), FINE)).astype(np.uint8).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"class": frame["class"], "marks": marks})

    return texts.select("class", "text").mapInPandas(work, "class long, marks binary")


def unlike_parts(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a bucket that lie in different components and whose sketches agree enough.

    `members`: (key, class, root, bands, marks, size). A bucket of more than CHUNK members is cut
    into chunks, and each two of them meet in a unit of their own; no unit holds more than about
    two chunks, and only likely pairs leave it, each from the first bucket that holds both.
    """
    share = percent / 100
    # Bytes of unlike coordinates agree by chance, too, which only adds pairs.
    least, least_first = (n * (share - DEVIATIONS * (share * (1 - share) / n) ** 0.5) for n in (FINE, FIRST))
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("class", "key"), chunks).cast("int")
    dealt = members.withColumn("_n", chunks).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    dealt = dealt.withColumn("_other", other).select(
        "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "class", "root", "bands", "marks"
    )
    unit = ["key", "i", "j"]

    def compare(group: pd.DataFrame) -> list[tuple[int, int]]:
        marks = np.frombuffer(b"".join(group["marks"]), dtype=np.uint8).reshape(len(group), FINE)
        root, name, own = (group[c].to_numpy() for c in ("root", "class", "_own"))
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        head = np.ascontiguousarray(marks[right, :FIRST])
        bands, key = np.stack(group["bands"].to_list()), group["key"].iloc[0]
        found = []
        for x in left:
            likely = np.count_nonzero(head == marks[x, :FIRST], axis=1) >= least_first
            rest = right[likely & (root[right] != root[x]) & ((right > x) | (i != j))]
            alike = rest[np.count_nonzero(marks[rest] == marks[x], axis=1) >= least] if len(rest) else rest
            first = (bands[alike] == bands[x]).argmax(axis=1)
            found.extend((min(name[x], name[y]), max(name[x], name[y])) for y in alike[bands[x][first] == key])
        return found

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last unit of a batch may go on in the next
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (frame[unit] == frame[unit].iloc[-1]).all(axis=1).to_numpy()
            held, frame = frame[last], frame[~last]
            found = [p for _, group in frame.groupby(unit, sort=False) for p in compare(group)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if held is not None:
            yield pd.DataFrame(compare(held), columns=["a", "b"], dtype="int64")

    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(work, "a long, b long")


def shared_bands(classes: DataFrame) -> DataFrame:
    """(key, class, size): the bands of every class that others have too, and how many have them.

    Spark takes a row's bands for one and would send all of them; either side is far larger.
    """
    members = classes.select("class", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.hint("merge").join(buckets.hint("merge"), "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by similar sets of word runs.

    Texts with equal sets are one class, and only classes are compared. In each bucket of a band
    first all members meet the one that shares most buckets with others; members that this leaves
    in different components then meet each other, by longer sketches. Every link is confirmed on
    the full sets of the texts. Texts without words link with nothing; null doc_ids take part and
    can't be the smallest; repeated rows stay and share their component; other columns are not read.
    """
    rows = materialize(sketched(docs, words), "sketches")
    # One text stands for a class: the one of the smallest id and digest.
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_digest")).alias("row"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = materialize(shared_bands(classes), "members")
    degree = members.groupBy("class").agg(F.sum("size").alias("degree"))
    middle = members.join(degree, "class").groupBy("key").agg(F.max_by("class", F.struct("degree", "class")).alias("middle"))
    stars = members.join(middle, "key").filter("class <> middle")
    stars = stars.select(F.least("class", "middle").alias("a"), F.greatest("class", "middle").alias("b")).distinct()
    stars = materialize(stars, "stars")

    named = stars.select(F.col("a").alias("class")).union(stars.select("b")).distinct()
    wanted = classes.join(named, "class", "left_semi").select("class", "row.*")
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("text_digest") == F.col("_digest"))
    texts = identified(docs).join(wanted.select("class", F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest")), same)
    # Rows repeated as a whole give their text as often.
    texts = materialize(texts.select("class", "text").dropDuplicates(["class"]), "class-texts")
    links = materialize(verified(stars, texts, words, percent), "star-links")
    roots = components(links)

    parted = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    parted = materialize(parted, "parted")
    mixed = parted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high")
    rest = materialize(parted.join(mixed.select("key"), "key", "left_semi"), "rest")
    marks = fine_marks(texts.join(rest.select("class").distinct(), "class", "left_semi"), words)
    marks = materialize(marks.join(classes.select("class", "bands"), "class"), "marks")
    rest = rest.join(marks, "class")
    pairs = unlike_parts(rest, percent).join(stars, ["a", "b"], "left_anti")
    more = verified(materialize(pairs, "rest-pairs"), texts, words, percent)
    whole = components(links.unionByName(more))

    ids = classes.join(whole.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = materialize(ids.select("digest", "doc_id", "root"), "class-roots")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(least, "root").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


@query("op4_minhash")
def op4_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=4)
