"""Nearest dictionary terms by edit distance, over an index that is stored once and then probed.

The index is four tables bucketed by (language, key): `near` has every term of up to 14 letters
under what is left of it without at most one letter, `far` without two, `grams` every longer term
under its letter grams, `weights` how many terms hold each gram. A probe moves only the keys of the
words asked for; the index stays where it is.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolex.functions import text as tx
from duolex.functions.distance import osa_distance
from duolex.session import materialize, scratch_path

MAX_EDIT_DISTANCE = 2
OPTIONS_PER_TOKEN = 3

# Length classes of a pair of words, by the longer of the two, and the gram length each uses.
# A gram of q letters survives d edits in a word of n letters if n - q + 1 > d * (q + 1).
DELETE_MAX = 14
GRAMS = {1: 3, 2: 8}
LONG_MIN = 28
# Rows of a bucket that are aimed at.
BUCKET_ROWS = 2_000_000
# Up to this many keys of 14 letters and their words are sent to the index; more are shuffled into its buckets.
# The driver holds several such tables at a time, at some 200 bytes a row and more while it builds them.
BROADCAST_KEYS = 50_000

# A task has one bucket's rows, seldom a few; beyond so many open files it sorts the rest by bucket.
OPEN_FILES_KEY, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 8

ENTRY = "iso string, key string, term string, count long"
TABLES = {"near": ENTRY, "far": ENTRY, "grams": ENTRY, "weights": "iso string, key string, weight long"}


def _pair_class(length: Column) -> Column:
    return F.when(length <= DELETE_MAX, 0).when(length < LONG_MIN, 1).otherwise(2)


def delete_keys(words: DataFrame, word: str, distance: int) -> DataFrame:
    """Add `key`, the word without any up to `distance` of its letters, and `edits`, how many.

    Letters are taken out from left to right: each step either stops or removes one letter at
    or after the place of the last one, so every choice of places comes up once. Of a run of
    equal letters only the first is taken, as any other leaves the same key.
    """
    out = words.withColumns({"key": F.col(word), "edits": F.lit(0), "_from": F.lit(1), "_done": F.lit(False)})
    for _ in range(distance):
        key = F.col("key")
        more = ~F.col("_done") & (F.length(key) >= F.col("_from"))
        places = F.when(more, F.concat(F.array(F.lit(0)), F.sequence(F.col("_from"), F.length(key))))
        out = out.withColumn("_i", F.explode(F.coalesce(places, F.array(F.lit(0)))))
        i = F.col("_i")
        out = out.filter((i <= F.col("_from")) | (key.substr(i, F.lit(1)) != key.substr(i - 1, F.lit(1))))
        cut = F.concat(key.substr(F.lit(1), i - 1), key.substr(i + 1, F.length(key)))
        out = out.withColumns({
            "key": F.when(i > 0, cut).otherwise(key), "edits": F.col("edits") + (i > 0).cast("int"),
            "_from": F.greatest("_from", "_i"), "_done": i == 0,
        })
    return out.drop("_from", "_done", "_i")


def key_sets(words: DataFrame, word: str, distance: int) -> DataFrame:
    """Add `keys0` to `keys{distance}`: the distinct strings left of the word without so many letters, none empty.

    The word's own row tells its keys apart; as rows of their own they would have to be grouped first.
    """

    def shorter(key: Column) -> Column:
        cut = lambda i: F.concat(key.substr(F.lit(1), i - 1), key.substr(i + 1, F.length(key)))
        return F.transform(F.sequence(F.lit(1), F.length(key)), cut)

    out = words.withColumn("keys0", F.array_remove(F.array(word), ""))
    for n in range(1, distance + 1):
        fewer = F.array_distinct(F.flatten(F.transform(f"keys{n - 1}", shorter)))
        out = out.withColumn(f"keys{n}", F.array_remove(fewer, ""))
    return out


def gram_keys(words: DataFrame, word: str, distance: int) -> DataFrame:
    """Rows (words..., class, need, all, key) for every class a long word can meet a partner in.

    `all` is how many grams the word has in the class, `need` how many of them a partner shares one of.

    A repeated gram is numbered from its second occurrence on, so each is a distinct element.
    Grams of the two classes differ in length or, numbered, in their sign, so they share a column.
    """
    length = F.length(word)
    classes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda d: _pair_class(length + d)))
    out = words.withColumn("class", F.explode(F.filter(classes, lambda c: c > 0)))
    q = F.when(F.col("class") == 1, GRAMS[1]).otherwise(GRAMS[2])
    out = out.withColumn("_q", q).withColumn("need", F.lit(distance) * (q + 1) + 1)
    at = F.sequence(F.lit(1), F.length(word) - F.col("_q") + 1)
    out = out.withColumn("_all", F.transform(at, lambda i: F.col(word).substr(i, F.col("_q"))))

    def numbered(gram: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice("_all", F.lit(1), i), lambda h: h == gram))
        sign = F.when(F.col("class") == 1, "#").otherwise("##")
        return F.when(earlier == 0, gram).otherwise(F.concat(gram, sign, earlier.cast("string")))

    repeats = F.size(F.array_distinct("_all")) < F.size("_all")
    grams = F.when(repeats, F.transform("_all", numbered)).otherwise(F.col("_all"))
    return out.select(*words.columns, "class", "need", F.size("_all").alias("all"), F.explode(grams).alias("key"))


class FuzzyIndex:
    """A dictionary's stored index. `terms` is the dictionary itself, for exact matches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        self.terms = spark.read.schema("iso string, term string, count long").parquet(os.path.join(path, "terms"))
        for name, columns in TABLES.items():
            table = f"fuzzy_{uuid.uuid4().hex}"
            place = os.path.join(path, name)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (iso, key) SORTED BY (key, iso) "
                f"INTO {buckets} BUCKETS LOCATION '{place}'"
            )
            setattr(self, name, spark.table(table))

    def keys(self) -> DataFrame:
        """(iso, key, term, count, kind): every stored key of every term."""
        kinds = [getattr(self, n).withColumn("kind", F.lit(n)) for n in ("near", "far", "grams")]
        return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def _stored(rows: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """Rows in the files of their buckets, one file each if they are dealt as buckets are.

    The writer's own sort would hash both rows for their bucket at every comparison. Rows are sorted
    here, by what tells most of them apart, and go to files kept open side by side.
    """
    spark = rows.sparkSession
    table = f"fuzzy_{uuid.uuid4().hex}"
    writer = rows.sortWithinPartitions("key", "iso").write.bucketBy(buckets, "iso", "key").format("parquet")
    before = spark.conf.get(OPEN_FILES_KEY, "0")
    spark.conf.set(OPEN_FILES_KEY, str(OPEN_FILES))
    try:
        writer.option("path", os.path.join(path, name)).mode("overwrite").saveAsTable(table)
    finally:
        spark.conf.set(OPEN_FILES_KEY, before)
    return spark.table(table)


def write_index(dictionary: DataFrame, path: str, distance: int = MAX_EDIT_DISTANCE) -> None:
    """Store the index of (iso, term, count) below `path`, whatever the length of the terms."""
    spark = dictionary.sparkSession
    terms = dictionary.select("iso", "term", "count").filter(F.length("term") > 0)
    terms.write.mode("overwrite").parquet(os.path.join(path, "terms"))
    terms = spark.read.schema("iso string, term string, count long").parquet(os.path.join(path, "terms"))
    n = F.least(F.length("term"), F.lit(DELETE_MAX)).cast("long")
    rows = terms.agg(F.coalesce(F.sum(1 + n + (n * (n - 1) / 2).cast("long")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    # A term that comes more than once has its keys once.
    short = key_sets(terms.filter(F.length("term") <= DELETE_MAX).dropDuplicates(["iso", "term"]), "term", distance)
    for name, edits in (("near", range(min(distance, 1) + 1)), ("far", range(2, distance + 1))):
        keys = F.concat(F.array().cast("array<string>"), *[f"keys{n}" for n in edits])
        rows = short.select("iso", F.explode(keys).alias("key"), "term", "count")
        _stored(rows.repartition(buckets, "iso", "key"), path, name, buckets)
    least = DELETE_MAX + 1 - distance
    grams = gram_keys(terms.filter(F.length("term") >= least), "term", distance).select("iso", "key", "term", "count")
    grams = _stored(grams.repartition(buckets, "iso", "key"), path, "grams", buckets)
    # Terms of a gram lie in one bucket already.
    _stored(grams.groupBy("iso", "key").agg(F.count(F.lit(1)).alias("weight")), path, "weights", buckets)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(os.path.join(path, "layout"))


def open_index(spark: SparkSession, path: str) -> FuzzyIndex:
    """The index stored below `path`, by this session or any other."""
    return FuzzyIndex(spark, path, spark.read.schema("buckets int").json(os.path.join(path, "layout")).first().buckets)


def index_of(dictionary: DataFrame) -> FuzzyIndex:
    """Index a dictionary for the lookups of this session, in the shared folder."""
    path = scratch_path(dictionary.sparkSession, "fuzzy")
    write_index(dictionary, path)
    return open_index(dictionary.sparkSession, path)


def _sizes(queries: DataFrame, distance: int) -> tuple[int, int]:
    """How many delete keys and how many grams the stored queries have at most."""
    n = F.length("query")
    keys = 1 + n + (F.when(n > 1, n * (n - 1) / 2).otherwise(0) if distance > 1 else 0)
    short, long = n <= DELETE_MAX, n > DELETE_MAX - distance
    sums = [F.sum(F.when(which, size).cast("long")) for which, size in ((short, keys), (long, 2 * n))]
    return tuple(queries.agg(*[F.coalesce(s, F.lit(0)) for s in sums]).first())


def _sent(keys: DataFrame, count: int) -> DataFrame:
    """Keys, sent to the index if they are known to be few, and else never.

    Spark sizes keys by the stored words they are made of, as if each word had one.
    """
    return F.broadcast(keys) if count <= BROADCAST_KEYS else keys.hint("merge")


def _long_pairs(queries: DataFrame, index: FuzzyIndex, distance: int, grams: int) -> DataFrame:
    """Pairs whose longer word has over 14 letters, by a shared gram.

    `distance` edits cannot touch all of `need` grams of a query, so a near term holds one of
    any so many. The ones taken are those the fewest terms hold, first of all those none does.
    """
    asked = gram_keys(queries.filter(F.length("query") > DELETE_MAX - distance), "query", distance)
    held = index.weights.join(_sent(asked, grams), ["iso", "key"])
    by_query = Window.partitionBy("iso", "query", "class")
    unheld = F.col("all") - F.count(F.lit(1)).over(by_query)
    nth = F.row_number().over(by_query.orderBy("weight", "key"))
    rarest = held.withColumns({"_nth": nth, "_unheld": unheld}).filter(F.col("_nth") <= F.col("need") - F.col("_unheld"))
    return index.grams.join(_sent(rarest.select("iso", "query", "key"), grams), ["iso", "key"])


def candidate_pairs(queries: DataFrame, index: FuzzyIndex, distance: int, k: int) -> DataFrame:
    """(iso, query, term, count): every pair within `distance`, and some that are not.

    Short pairs meet on a delete key, pairs with a longer word on a rare gram. `queries` is stored.
    """
    keys, grams = _sizes(queries, distance)
    # Words that vanish entirely are all exactly `distance` apart unless another key pairs them
    # closer, and only the k most frequent of those can be among the nearest k.
    in_order = Window.partitionBy("iso").orderBy(F.desc("count"), "term")
    gone = index.terms.filter(F.length("term") <= distance).withColumn("_nth", F.row_number().over(in_order))
    pairs = queries.filter(F.length("query") <= distance).join(gone.filter(F.col("_nth") <= k).drop("_nth"), "iso")
    if keys:
        asked = delete_keys(queries.filter(F.length("query") <= DELETE_MAX), "query", distance)
        asked = _sent(asked.select("iso", "query", "key").filter("key <> ''"), keys)
        for table in (index.near, index.far)[:distance]:
            pairs = pairs.unionByName(table.join(asked, ["iso", "key"]).drop("key"))
    if grams:
        pairs = pairs.unionByName(_long_pairs(queries, index, distance, grams).drop("key"))
    near = F.abs(F.length("query") - F.length("term")) <= distance
    return pairs.filter(near).select("iso", "query", "term", "count").distinct()


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("iso", "query").orderBy(F.desc("count"), "term")
    return pairs.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def fuzzy_lookup(
    tokens: DataFrame,
    index: DataFrame | FuzzyIndex,
    max_distance: int = MAX_EDIT_DISTANCE,
    k: int = OPTIONS_PER_TOKEN,
) -> DataFrame:
    """(iso, token, rank, term, count, distance, suggestion): the k best terms per token among
    those at its smallest distance, by falling count, then term.

    Takes an opened index, or a dictionary that is then indexed first. Distances are tried in
    rising order, and a token that has found a term is out of the next try. Where words lie close
    together nearly every token is settled before the widest one.
    """
    if max_distance > MAX_EDIT_DISTANCE:
        raise ValueError(f"the index holds distances up to {MAX_EDIT_DISTANCE}")
    if isinstance(index, DataFrame):
        index = index_of(index)
    queries = tokens.select("iso", F.lower("token").alias("query")).distinct()
    # Distinct unknown words, one short column: written once per round, read for every key kind.
    queries = materialize(queries, "queries")
    rounds = []
    for distance in range(max_distance + 1):
        if distance == 0:
            terms = index.terms.select("iso", F.col("term").alias("query"), "term", "count")
            # Stored words are several times smaller than what a join would send.
            pairs = queries.hint("merge").join(terms.hint("merge"), ["iso", "query"]).withColumn("distance", F.lit(0))
        else:
            pairs = candidate_pairs(queries, index, distance, k)
            measured = osa_distance("query", "term", distance, at_least=distance)
            pairs = pairs.withColumn("distance", measured).filter(F.col("distance").isNotNull())
        # Few rows per token. Written once, since both the result and the next round read it.
        found = materialize(_nearest(pairs, k), f"distance{distance}")
        rounds.append(found)
        if distance < max_distance:
            queries = queries.join(found.select("iso", "query").hint("merge"), ["iso", "query"], "left_anti")
            queries = materialize(queries, "queries")
    nearest = rounds[0]
    for found in rounds[1:]:
        nearest = nearest.unionByName(found)
    cased = tokens.select("iso", "token", F.lower("token").alias("query")).distinct()
    out = cased.hint("merge").join(nearest.hint("merge"), ["iso", "query"])
    return out.select(
        "iso", "token", "rank", "term", "count", "distance", tx.transfer_casing("token", "term").alias("suggestion")
    )
