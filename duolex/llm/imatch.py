"""Document fingerprints by I-Match over a hashed lexicon, with randomised subsets of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolex.llm.common import documents, query, ranged
from duolex.session import materialize

#: Words are terms by a hash of so many bits, so that the lexicon is a bitmap of fixed size.
LEXICON_BITS = 20
#: Terms kept have an inverse document frequency within this part of the largest possible one.
BAND = (0.1, 0.9)
#: Levels of lexicon subsets, each of half the density of the one before; subsets of a level; hex digits of a hash.
LEVELS, SUBSETS, DIGITS = 10, 16, 4  # 16: two steps of a quarter
#: Likeness is read from the sparsest level at which so many subsets hold a term of either text.
READ_FROM = 8
EMPTY = "0" * DIGITS


def term_array(text: Column) -> Column:
    """Distinct hashed terms of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND((1 << LEXICON_BITS) - 1).cast("int")))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Column:
    """Bitmap of the terms within the band, counted over all of `docs`, as a constant column.

    What reaches the driver has a fixed size: a number for each 64 terms.
    """
    rows = docs.select(term_array(F.col("text")).alias("terms"))
    n = float(max(docs.count(), 1))
    low, high = n ** (1 - band[1]), n ** (1 - band[0])
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    inside = counts.filter((F.col("count") >= low) & (F.col("count") <= high))
    words = inside.groupBy(F.shiftright("term", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, term & 63)")).alias("bits"))
    bits = [0] * (1 << (LEXICON_BITS - 6))
    for place, value in words.collect():
        bits[place] = value
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def with_bits(shift: int, mask: int, value: int):
    return lambda draw: F.shiftrightunsigned(draw, shift).bitwiseAND(mask) == value


def up_to(level: int):
    """A draw stays up to the level of its low zero bits."""
    return with_bits(0, (1 << level) - 1, 0)


def level_hashes(number: int) -> Column:
    """Hashes of the draws of one subset that stay at each level, each level taken out of a sparser one before it."""
    every, half, eighth = f"_subset{number}", f"_half{number}", f"_eighth{number}"
    rest = [F.filter(eighth, up_to(level)) for level in range(4, LEVELS)]
    left = F.array(F.col(every), F.col(half), F.filter(half, up_to(2)), F.col(eighth), *rest)
    most = F.lit(16**DIGITS - 1)
    # A leading digit more keeps the zeros.
    digits = lambda p: F.hex(F.pmod(F.xxhash64(p), most) + 1 + 16**DIGITS).substr(2, DIGITS)
    return F.transform(left, lambda p: F.when(F.size(p) == 0, EMPTY).otherwise(digits(p)))


def with_fingerprint(rows: DataFrame, text: str, name: str, bitmap: Column) -> DataFrame:
    """Adds hashes of the text's sorted terms in every subset of the lexicon, EMPTY where it has none.

    A text without a term of the lexicon is taken by all its terms, one without any by a digest.
    Each step is a column of its own, so that none is computed again for every subset.
    """
    known = F.filter("_every", lambda t: F.call_function("shiftright", F.get(bitmap, F.shiftright(t, 6)), t.bitwiseAND(63)).bitwiseAND(1) == 1)
    rows = rows.withColumn("_every", term_array(F.col(text))).withColumn("_known", known)
    # A term's draw, sorted: its low bits say up to which level it stays, its high ones in which subset.
    draws = F.transform(F.when(F.size("_known") > 0, F.col("_known")).otherwise(F.col("_every")), lambda t: F.xxhash64(t))
    rows = rows.withColumn("_draws", F.array_sort(draws))
    # Subsets in two steps of a quarter each, then the levels of each: few looks at every draw.
    rows = rows.withColumns({f"_quarter{q}": F.filter("_draws", with_bits(34, 3, q)) for q in range(4)})
    rows = rows.withColumns({f"_subset{j}": F.filter(f"_quarter{j // 4}", with_bits(32, 3, j % 4)) for j in range(SUBSETS)})
    rows = rows.withColumns({f"_half{j}": F.filter(f"_subset{j}", up_to(1)) for j in range(SUBSETS)})
    rows = rows.withColumns({f"_eighth{j}": F.filter(f"_half{j}", up_to(3)) for j in range(SUBSETS)})
    rows = rows.withColumns({f"_hashes{j}": level_hashes(j) for j in range(SUBSETS)})
    by_level = F.array(*[F.get(f"_hashes{j}", F.lit(i)) for i in range(LEVELS) for j in range(SUBSETS)])
    nothing = F.concat(F.lit("#"), F.sha2(F.col(text).cast("binary"), 256))
    rows = rows.withColumn(name, F.when(F.size("_every") == 0, nothing).otherwise(F.lower(F.array_join(by_level, ""))))
    steps = [f"{step}{j}" for step in ("_subset", "_half", "_eighth", "_hashes") for j in range(SUBSETS)]
    return rows.drop("_every", "_known", "_draws", *steps, *[f"_quarter{q}" for q in range(4)])


def packed(name: str) -> Column:
    """A fingerprint in half the bytes; the digest of a text without terms stays as it is."""
    return F.when(F.col(name).startswith("#"), F.col(name).cast("binary")).otherwise(F.unhex(name))


def unpacked(name: str) -> Column:
    size = LEVELS * SUBSETS * DIGITS // 2
    return F.when(F.octet_length(name) == size, F.lower(F.hex(name))).otherwise(F.col(name).cast("string"))


def likeness(a: str, b: str) -> Column:
    """The share of lexicon subsets with equal hashes, of those in which either text has a term.

    Each step binds what it reads, so that nothing is worked out twice.
    """

    def bound(value: Column, step) -> Column:
        return F.transform(F.array(value), step)[0]

    # Bytes are reached by their place; in a string every letter before them would be passed.
    width = DIGITS // 2
    empty = F.unhex(F.lit(EMPTY))

    def pairs(both: Column, number: int) -> Column:
        at = F.sequence(F.lit(number * SUBSETS * width + 1), F.lit((number + 1) * SUBSETS * width), F.lit(width))
        return F.filter(
            F.transform(at, lambda i: F.struct(both["x"].substr(i, F.lit(width)).alias("a"), both["y"].substr(i, F.lit(width)).alias("b"))),
            lambda p: (p["a"] != empty) | (p["b"] != empty),
        )

    def read(levels: Column) -> Column:
        enough = F.filter(levels, lambda held: F.size(held) >= READ_FROM)
        return F.coalesce(F.try_element_at(enough, F.lit(-1)), F.get(levels, F.lit(0)))

    def like(both: Column) -> Column:
        levels = bound(F.array(*[pairs(both, i) for i in range(LEVELS)]), read)
        same = bound(levels, lambda held: F.size(F.filter(held, lambda p: p["a"] == p["b"])) / F.greatest(F.size(held), F.lit(1)))
        apart = both["a"].startswith("#") | both["b"].startswith("#")
        return F.when(both["a"] == both["b"], 1.0).when(apart, 0.0).otherwise(same)

    # Digests of texts without terms are no hex numbers and have no bytes.
    return bound(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.unhex(a).alias("x"), F.unhex(b).alias("y")), like)


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, digest, n, next_id, next_digest): each document and the next one by descending id.

    After the last comes the first. Rows equal in id and text are one document; those of equal
    id alone are ordered by a digest of the text; null ids come last.
    """
    keys = docs.select("id", "digest", F.length("text").cast("long").alias("n")).distinct()
    stored = ranged(keys, "id", "digest", name="order")
    row = F.struct("id", "digest")
    ends = stored.groupBy("part").agg(F.max(row).alias("end"))
    # One row for each range; the predecessor of the first is the end of the last.
    parts = Window.orderBy("part")
    before = F.coalesce(F.lag("end").over(parts), F.max("end").over(Window.partitionBy()))
    ends = ends.select("part", before.alias("before"))
    inside = Window.partitionBy("part").orderBy("id", "digest")
    found = stored.withColumn("_next", F.lag(row).over(inside)).join(F.broadcast(ends), "part")
    following = F.coalesce("_next", "before")
    return found.select("id", "digest", "n", following["id"].alias("next_id"), following["digest"].alias("next_digest"))


def compared(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, next_print) of every row.

    The edited text has the last third of its code points replaced by as many first ones (or all)
    of the next document. A null text counts as empty; repeated rows get equal results; a table of
    one document is its own next; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    bitmap = lexicon(rows)
    order = materialize(neighbours(rows), "neighbours")
    # Each text's own fingerprint is made once and moves with it; both joins read the same shuffle.
    rows = with_fingerprint(rows, "text", "_print", bitmap).withColumn("_print", packed("_print"))
    third = F.floor(F.col("n") / 3).cast("int")

    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    gives = order.select(
        F.col("next_id").alias("_id"), F.col("next_digest").alias("_digest"), F.col("id").alias("to_id"), F.col("digest").alias("to_digest"), third.alias("_third")
    )
    start = F.col("text").substr(F.lit(1), F.col("_third")).alias("start")
    given = rows.join(gives, same).select("to_id", "to_digest", start, F.col("_print").alias("_next"))
    # Rows repeated as a whole give the same start again.
    given = given.dropDuplicates(["to_id", "to_digest"])
    taken = rows.join(given, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("digest") == F.col("to_digest")))
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("start"))
    prints = [unpacked("_print").alias("fingerprint"), unpacked("_next").alias("next_print")]
    taken = taken.select(F.col("id").alias(key), n.cast("long").alias("n_chars"), edited.alias("edited"), *prints)
    return with_fingerprint(taken, "edited", "edited_fingerprint", bitmap)


@query("op7_imatch")
def op7_imatch(spark, sf_dir):
    rows = compared(documents(spark, sf_dir))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    near = {"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_print")}
    return rows.withColumns(near).drop("next_print")
