"""Repeated byte windows by a depth-limited radix sort of suffixes, and texts without them.

Suffixes count up to the threshold length only, so two of them are equal exactly if a window of
that length repeats. The first digit is not the first bytes of a suffix but the gram in it whose
hash is smallest (its anchor), wherever that lies: equal windows have equal anchors at equal
places, neighbouring windows mostly share one, and so neighbours enter the sort as one block. The
further digits are the bytes all windows of a block share; a block whose digit nobody else has
leaves the sort, one that is equal to another as a whole is settled, and the others are cut into
smaller blocks for the next pass, down to single windows. Equality is that of 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.llm.common import documents, joined_bytes, query, text_blocks
from duolex.llm.minhash import mix, powers
from duolex.session import materialize

THRESHOLD = 400
#: Bytes of an anchor; a shorter one for thresholds near it.
GRAM = 48
#: Windows of a block in the passes after the first.
CELLS = (32, 4, 1)
#: Rows from which on a digit is matched by broadcast, and how many such digits there are at most.
HOT_ROWS, HOT_DIGITS = 100_000, 100_000
#: Words of the shortest passage that `without_passages` cuts.
PASSAGE_WORDS = 51
#: Fixed value: scripts without spaces between words, in which every letter counts as a word.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = rf"(?V1)[{UNSPACED}]|[[\p{{L}}\p{{M}}\p{{N}}_]--[{UNSPACED}]]+(?:['’-][[\p{{L}}\p{{M}}\p{{N}}_]--[{UNSPACED}]]+)*"
#: In texts of these characters alone, which hold neither marks nor such scripts, words are simpler to find.
PLAIN_TEXT = re.compile("[\\u0000-\\u02ff\\u2000-\\u206f\\u20a0-\\u20bf]*")
PLAIN_WORD = r"\w+(?:['’-]\w+)*"
#: Links of words in an anchor, windows of a block of links in the passes after the first.
LINK_GRAM, LINK_CELLS = 6, (8, 1)
#: Characters of short texts, or windows of a long one, that are worked on together.
BLOCK = 1 << 18

_rng = np.random.default_rng(40)
_tables = [_rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
NONE = np.uint64(2**64 - 1)


class Rolling:
    """Hashes of any stretch of some bytes, or 64-bit symbols, from running sums."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(12, len(data).bit_length())
        values = _tables[which][data] if data.dtype == np.uint8 else mix(data ^ _tables[which][0])
        terms = values * powers(BASES[which], size)[: len(data)]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = powers(INVERSES[which], size)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.back[begin]


def blocks(data: np.ndarray, ends: np.ndarray, threshold: int, gram: int = GRAM):
    """(text, first, last, anchor, digit, whole) of all runs of windows with one anchor.

    first and last are the starts of the run's windows in `data`, anchor the place of the anchor,
    digit its hash, and `whole` another one of all bytes the run covers and its place in them.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < threshold:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = min(gram, threshold)
    width = threshold - gram + 1
    one, two = Rolling(data, 0), Rolling(data, 1)
    places = np.arange(len(data) - gram + 1)
    hashes = mix(one(places, places + gram))
    # The smallest hash of every window, from minima that run to and from multiples of the width;
    # the low bits carry the place, the leftmost of equals wins.
    bits = np.uint64((1 << (2 * width).bit_length()) - 1)
    padded = np.full(-(-len(hashes) // width) * width, NONE)
    padded[: len(hashes)] = hashes
    padded = padded.reshape(-1, width) & ~bits
    offset = np.arange(width, dtype=np.uint64)
    from_here = np.minimum.accumulate((padded | offset)[:, ::-1], axis=1)[:, ::-1].ravel()
    up_to = np.minimum.accumulate(padded | (offset + np.uint64(width)), axis=1).ravel()
    start = np.arange(len(data) - threshold + 1)
    best = np.where(start % width == 0, from_here[start], np.minimum(from_here[start], up_to[start + width - 1]))
    anchor = start // width * width + (best & bits).astype(np.int64)
    text = np.searchsorted(ends, start, side="right") - 1
    inside = start + threshold <= ends[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return blocks(data[:0], ends, threshold, gram)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    begin = np.concatenate([[0], new])
    first, last = start[begin], start[np.append(new, len(start)) - 1]
    anchor, text = anchor[begin], text[begin]
    place = (anchor - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)
    whole = mix(two(first, last + threshold) ^ mix(place))
    return text, first, last, anchor, hashes[anchor], whole


def first_pass(texts: DataFrame, threshold: int, gram: int, symbols: Callable) -> DataFrame:
    """(digest, first, place, digit, whole) of every block of every text of (digest, text, ...).

    `place` packs how many windows follow the first and how far on the anchor lies.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in text_blocks(frame["text"], BLOCK):
                data, ends = symbols(frame["text"].iloc[a:b])
                digest = frame["digest"].iloc[a:b].to_numpy()
                # A text of more windows comes alone and goes through in parts; a block may be cut in two there.
                parts = [(0, data, ends)]
                if b == a + 1:
                    cuts = range(0, max(1, len(data) - threshold + 1), BLOCK)
                    parts = [(c, data[c : c + BLOCK + threshold - 1], None) for c in cuts]
                for shift, part, bounds in parts:
                    bounds = np.asarray([0, len(part)]) if bounds is None else bounds
                    text, first, last, anchor, digit, whole = blocks(part, bounds, threshold, gram)
                    yield pd.DataFrame(
                        {
                            "digest": digest[text],
                            "first": first - bounds[text] + shift,
                            "place": (last - first) << 16 | (anchor - first),
                            "digit": digit.view(np.int64),
                            "whole": whole.view(np.int64),
                        }
                    )

    return texts.select("digest", "text").mapInPandas(work, "digest binary, first long, place long, digit long, whole long")


def cells_of(first: int, last: int, anchor: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(number, first, last) of the cells of `size` windows, counted from the anchor, that a block meets."""
    for number in range((anchor - last) // size, (anchor - first) // size + 1):
        yield number, max(first, anchor - number * size - size + 1), min(last, anchor - number * size)


def cell_pass(stored: DataFrame, size: int, threshold: int, unit: int) -> DataFrame:
    """(digest, first, last, anchor, weight, digit, whole) of the cells of every block.

    The digit is a hash of the anchor's, the cell's number and the bytes all its windows share;
    `whole` also covers all bytes of the cell's windows that the block has. A symbol takes `unit` bytes.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                data, at = r.bytes, r.first
                for number, first, last in cells_of(r.first, r.last, r.anchor, size):
                    shared = r.anchor - number * size
                    core = data[(shared - at) * unit : (shared - size + 1 + threshold - at) * unit]
                    digit = hashlib.blake2b(core, digest_size=16, salt=number.to_bytes(16, "little"), key=r.digit).digest()
                    place = (r.anchor - first).to_bytes(8, "little") + (last - first).to_bytes(8, "little")
                    whole = hashlib.blake2b(data[(first - at) * unit : (last + threshold - at) * unit], digest_size=16, salt=place, key=digit).digest()
                    rows.append((r.digest, first, last, r.anchor, r.weight, digit, whole))
            yield pd.DataFrame(rows, columns=["digest", "first", "last", "anchor", "weight", "digit", "whole"])

    schema = "digest binary, first long, last long, anchor long, weight double, digit binary, whole binary"
    return stored.select("digest", "first", "last", "anchor", "weight", "digit", "bytes").mapInPandas(work, schema)


def contested(kinds: DataFrame) -> DataFrame:
    """Of (digit, whole, ...), one row for each distinct content: those whose digit others have too."""
    shared = kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1").select("digit")
    return kinds.join(shared, "digit")


def matched(rows: DataFrame, keys: DataFrame, on: list[str], n: str, hot: int) -> DataFrame:
    """`rows` joined with `keys`, of which those with `hot` rows or more are sent to the rows instead of gathering them."""
    often = keys.filter(F.col(n) >= hot)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(keys.filter(F.col(n) < hot), on)
    return rows.join(F.broadcast(often), on).unionByName(rest).drop(n)


def block_bytes(wanted: DataFrame, threshold: int, symbols: Callable) -> DataFrame:
    """(digest, alike, first, last, anchor, weight, digit, bytes) of every block in `cut` of a text, its symbols as bytes."""
    names = ["digest", "alike", "first", "last", "anchor", "weight", "digit", "bytes"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                data, _ = symbols([r.text])
                for i in range(0, len(r.cut), 10_000):
                    rows = [
                        (r.digest, r.alike, c["first"], c["last"], c["anchor"], c["weight"] / r.alike, c["digit"], data[c["first"] : c["last"] + threshold].tobytes())
                        for c in r.cut[i : i + 10_000]
                    ]
                    yield pd.DataFrame(rows, columns=names)

    schema = "digest binary, alike long, first long, last long, anchor long, weight double, digit binary, bytes binary"
    return wanted.select("digest", "alike", "text", "cut").mapInPandas(work, schema)


def repeated_spans(
    texts: DataFrame, threshold: int, gram: int = GRAM, cells: tuple[int, ...] = CELLS, symbols: Callable = joined_bytes, unit: int = 1
) -> DataFrame:
    """(digest, spans): for every text with any, the stretches (begin, end) of symbols that repeated windows cover.

    `texts`: (digest, id, text) of all documents. `symbols` turns texts into one array, of `unit`
    bytes for each symbol, and the bounds of each text in it; by default symbols are bytes.
    """
    rows = materialize(first_pass(texts, threshold, gram, symbols), "blocks")
    hot = max(HOT_ROWS, rows.count() // HOT_DIGITS)
    digits = rows.groupBy("digit").agg(
        F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")
    )
    digits = digits.filter("n > 1").select("digit", "n", (F.col("low") != F.col("high")).alias("differ"))
    last = F.col("first") + F.shiftright("place", 16)
    anchor = F.col("first") + F.col("place").bitwiseAND(0xFFFF)
    shared = matched(rows, digits, ["digit"], "n", hot).select("digest", "first", last.alias("last"), anchor.alias("anchor"), "digit", "whole", "differ")
    shared = materialize(shared, "shared-blocks")
    # Where all blocks of a digit are equal, all are settled at once.
    spans = [shared.filter("NOT differ").select("digest", "first", "last")]

    unlike = shared.filter("differ")
    kinds = unlike.groupBy("digit", "whole").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("digest", "first", "last", "anchor")).alias("at"))
    kinds = materialize(kinds, "block-kinds")
    equal = kinds.filter("weight > 1").select("digit", "whole", "weight")
    spans.append(matched(unlike, equal, ["digit", "whole"], "weight", hot).select("digest", "first", "last"))

    # Of each kind of block one is looked at more closely, in one of the rows with its text; if
    # several rows are equal as a whole, each of them brings its share of the block's weight.
    cut = kinds.select("at.*", "weight", F.unhex(F.hex("digit")).alias("digit"))
    cut = cut.groupBy("digest").agg(F.collect_list(F.struct("first", "last", "anchor", "weight", "digit")).alias("cut"))
    alike = texts.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("alike"))
    alike = alike.groupBy("digest").agg(F.min(F.struct("id", "alike")).alias("row"))
    wanted = cut.join(alike, "digest").select("digest", "row.*", "cut").join(texts, ["digest", "id"])
    stored = block_bytes(wanted, threshold, symbols)
    stored = materialize(stored, "open-blocks")
    for size in cells:
        found = materialize(cell_pass(stored, size, threshold, unit), f"cells-{size}")
        kinds = found.groupBy("digit", "whole").agg(
            F.sum("weight").alias("total"), F.count(F.lit(1)).alias("blocks"), F.min(F.struct("digest", "anchor", "first", "last")).alias("at")
        )
        kinds = materialize(kinds, f"cell-kinds-{size}")
        # Shares of a weight add up to whole numbers, but for rounding.
        equal = kinds.filter("total > 1.5").select("digit", "whole")
        spans.append(found.filter("weight < 1.5").join(equal, ["digit", "whole"]).select("digest", "first", "last"))
        if size > 1:
            rest = contested(kinds).select("at.*", "total", "digit")
            whole = stored.select("digest", "anchor", "alike", F.col("first").alias("_first"), "bytes")
            piece = F.expr(f"substring(bytes, int(first - _first) * {unit} + 1, (int(last - first) + {threshold}) * {unit})")
            stored = materialize(
                rest.join(whole, ["digest", "anchor"])
                .filter(F.expr(f"first >= _first AND last + {threshold} <= _first + length(bytes) / {unit}"))
                .select("digest", "alike", "first", "last", "anchor", (F.col("total") / F.col("alike")).alias("weight"), "digit", piece.alias("bytes")),
                f"open-cells-{size}",
            )
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    span = F.struct(F.col("first").alias("begin"), (F.col("last") + threshold).alias("end"))
    return every.groupBy("digest").agg(F.collect_set(span).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of some stretches; adjacent ones are one."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(s) for s in out]


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(all columns of docs, kept, removed): each text's remaining bytes and the stretches cut from it.

    A byte goes if it lies in a window of `threshold` bytes that also starts anywhere else in the
    table, the same text included; equal texts repeat each other. Windows never cross texts. A null
    text counts as empty; texts shorter than the threshold stay whole; repeated rows stay.
    `removed` holds maximal (begin, end) in order. Columns of docs named like these are replaced.
    """
    names = [c for c in docs.columns if c not in ("kept", "removed")]
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(text.cast("binary")))
    hashed = docs.select(digest.alias("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("text"))
    # Only texts of the threshold's length have windows at all.
    long = hashed.filter(F.octet_length("text") >= threshold)
    spans = repeated_spans(long, threshold)
    # The columns of docs travel as one, so that none of their names can meet those in use here.
    whole = docs.select(F.struct(*names).alias("row"), text.alias("text"), digest.alias("digest")).join(spans, "digest", "left")
    whole = whole.select("row", cut_spans(F.col("text"), "spans").alias("cut"))
    return whole.select("row.*", "cut.kept", "cut.removed")


@lru_cache(maxsize=1)
def word_patterns():
    import regex

    return re.compile(PLAIN_WORD).finditer, regex.compile(WORD).finditer


def words_of(text: str) -> Iterator:
    """Matches of the words of a text; both patterns find the same ones in a plain text."""
    plain, any_script = word_patterns()
    return plain(text) if text.isascii() or PLAIN_TEXT.fullmatch(text) else any_script(text)


_parts: dict[str, int] = {}


def word_links(texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, what follows it and the next word, for all texts, and the bounds of each.

    A text of n words has n - 1 links, and equal runs of links are equal runs of words with equal
    gaps. What precedes the first word and follows the last one belongs to no link.
    """
    links, sizes = [], [0]
    for text in texts:
        parts, at = [], None
        for m in words_of(text):
            begin, end = m.span()
            if at is not None:
                parts.append(text[at:begin])
            parts.append(text[begin:end])
            at = end
        fresh = set(parts).difference(_parts)
        if len(_parts) + len(fresh) > 500_000:
            _parts.clear()
            fresh = set(parts)
        for part in fresh:
            _parts[part] = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        codes = np.fromiter(map(_parts.__getitem__, parts), dtype=np.uint64, count=len(parts))
        if len(parts) > 1:
            links.append(mix(mix(mix(codes[:-2:2]) + codes[1::2]) + codes[2::2]))
        sizes.append(len(parts) // 2)
    return np.concatenate(links) if links else np.zeros(0, dtype=np.uint64), np.cumsum(sizes)


def without_passages(docs: DataFrame, words: int = PASSAGE_WORDS, into: str = "left") -> DataFrame:
    """(all columns of docs, left): each text without the passages that also occur elsewhere.

    A word goes if it lies in a run of `words` words, with all that lies between them, that also
    starts anywhere else in the table, however few bytes that is; so does what lies between two
    words that go. A run of words is a window of so many links (a word, the gap, the next word),
    less one, and links are compared by 64-bit hashes. Very long texts go through in parts; equal
    and repeated rows repeat each other and stay, without their passages; a null text stays null,
    an empty table empty. `into` names the column of the results, which may be `text` itself; a
    column of docs of that name is replaced.
    """
    threshold = words - 1
    names = [c for c in docs.columns if c != into or c == "text"]
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    keyed = docs.select(key.alias("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    # A word and what follows it have a byte at least, except in scripts without spaces, where a word has three.
    spans = repeated_spans(keyed.filter(F.octet_length("text") >= 2 * words - 1), threshold, LINK_GRAM, LINK_CELLS, word_links, 8)
    # A link ends with the word after it.
    spans = spans.select("digest", F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), (s["end"] + 1).alias("end"))).alias("spans"))
    # The columns of docs travel as one, so that none of their names can meet those in use here.
    whole = docs.select(key.alias("digest"), F.struct(*names).alias("row")).join(spans, "digest", "left")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            left = []
            for text, spans in zip(texts, lists):
                gone = merged(spans) if text is not None else []
                if gone:
                    at = [m.span() for m in words_of(text)]
                    bounds = [0, *(x for a, b in gone for x in (at[a][0], at[b - 1][1])), len(text)]
                    text = "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                left.append(text)
            yield pd.Series(left, dtype=object)

    text = F.col("row.text")
    # Texts that nothing is cut from don't pass through Python.
    left = F.coalesce(cut(F.when(F.col("spans").isNotNull(), text), F.col("spans")), text)
    return whole.select("row", left.alias("cut")).select(*[F.col("row")[c].alias(c) for c in names if c != into], F.col("cut").alias(into))


def cut_spans(text: Column, spans: str) -> Column:
    @F.pandas_udf("kept binary, removed array<struct<begin:long,end:long>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            kept, removed = [], []
            for whole, spans in zip(texts, lists):
                data = whole.encode("utf-8", "surrogatepass")
                gone = merged(spans) if spans is not None else []
                at = [0, *(x for s in gone for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2])))
                removed.append([{"begin": a, "end": b} for a, b in gone])
            yield pd.DataFrame({"kept": kept, "removed": removed})

    return cut(text, spans)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    rows = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(
        "doc_id",
        (F.length("kept") + gone).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
