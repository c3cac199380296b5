"""Queries over sources, sinks, positional joins, budgets, splits and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolex.functions import text as tx
from duolex.operators import datasets as ds
from duolex.operators import frequency as fq
from duolex.operators import indexing as ix
from duolex.operators import joins as jn
from duolex.operators import ordering as od
from duolex.operators import reports as rp
from duolex.operators.meteor import meteor_corpus, meteor_row
from duolex.plans import corpus
from duolex.session import scratch_path
from duolex.sources import lines as ln
from duolex.sources import pairs as pr
from duolex.sources import tables as tb
from duolex.suite import base as b
from duolex.suite.base import query, table

FLAT = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"


def _write_lines(frame, path, order="doc_id", text="text"):
    """Texts as lines in id order, over several files."""
    flat = frame.select(order, F.regexp_replace(text, r"[\r\n]+", " ").alias("value"))
    flat.orderBy(order).select("value").write.text(path)


@query(
    "read_lines",
    f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, {b.sql_strip(FLAT)} AS text FROM documents",
)
def read_lines(spark, d):
    path = scratch_path(spark, "lines")
    _write_lines(b.documents(spark, d), path)
    return ln.read_lines(spark, path)


def _write_sides(spark, d, folder):
    """One single-column data set per language, rows in id order, without positions."""
    docs = b.documents(spark, d)
    for lang in b.LANGUAGES:
        side = docs.filter(F.col("lang") == lang).orderBy("doc_id").select(F.col("text").alias(lang))
        for a, z in b.PAIRED:
            if lang in (a, z):
                side.write.parquet(pr.side_path(f"{folder}/{a}{z}", f"{a}{z}", lang))


@query(
    "read_parquet_pair",
    f"WITH {b.SIDES} SELECT row_index, source, target FROM pairs WHERE dataset = 'en-de'",
)
def read_parquet_pair(spark, d):
    folder = scratch_path(spark, "sides")
    _write_sides(spark, d, folder)
    base = f"{folder}/ende"
    return pr.read_parquet_pair(spark, pr.side_path(base, "ende", "en"), pr.side_path(base, "ende", "de"))


NUMBERED = """numbered AS (SELECT doc_id, source AS dataset,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM documents)"""


def _numbered(spark, d):
    docs = b.documents(spark, d).select("doc_id", F.col("source").alias("dataset"))
    return ix.position_by_id(docs, "doc_id", ["dataset"])


@query(
    "sparse_positions",
    """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
        ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) - 1 AS row_index FROM documents""",
)
def sparse_positions(spark, d):
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    far = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    docs = b.documents(spark, d).select("doc_id", "lang", far.alias("far_id"))
    return ix.position_by_range(docs, "far_id", ["lang"]).drop("far_id")


@query(
    "slice_rows",
    f"WITH {NUMBERED} SELECT dataset, doc_id, row_index FROM numbered WHERE row_index >= 5 AND row_index < 5 + 30",
)
def slice_rows(spark, d):
    return ds.slice_rows(_numbered(spark, d), 5, 30)


TAGGED = "source, target, source_lang, target_lang"


@query(
    "read_dir",
    f"""WITH {b.PAIRS} SELECT {TAGGED} FROM pairs
        UNION ALL SELECT text, NULL, role, NULL FROM conversations""",
)
def read_dir(spark, d):
    folder = scratch_path(spark, "mixed")
    tagged = tb.TAGGED_SCHEMA.fieldNames()
    b.pairs_once(spark, d).select(*tagged).write.parquet(f"{folder}/train.parquet")
    turns = table(spark, d, "conversations").select(F.col("text").alias("source"), F.col("role").alias("source_lang"))
    turns.write.parquet(f"{folder}/turns.parquet")
    # An unrelated table, and a text that only claims to be Parquet.
    table(spark, d, "nation").write.parquet(f"{folder}/nation.parquet")
    table(spark, d, "region").select("r_name").write.text(f"{folder}/broken.parquet")
    return tb.read_dir(spark, folder, tagged)


HISTORY = """SELECT a.text AS source_text, b.text AS target_text,
    strftime(make_timestamp(2024, 1, 1, 0, 0, 0) + to_seconds(a.conv_id * 100 + a.turn), '%Y-%m-%d %H:%M:%S') AS timestamp,
    'en->' || substr(a.role, 1, 2) AS direction
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def history(spark, d):
    """Log records: every turn as source, the next as its translation, a second per turn."""
    turns = table(spark, d, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    second = F.col("conv_id") * 100 + F.col("turn")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=second.cast("decimal(18,6)"))
    return turns.join(answers, ["conv_id", "turn"]).select(
        F.col("text").alias("source_text"),
        "target_text",
        tx.format_ts(at).alias("timestamp"),
        tx.make_direction(F.lit("en"), F.substring("role", 1, 2)).alias("direction"),
        second.alias("seq"),
    )


@query("read_json_array", HISTORY)
def read_json_array(spark, d):
    path = scratch_path(spark, "json")
    # A file is one array, so the records become many files: one for each run of 16,384 seconds.
    record = F.struct(*tb.HISTORY_SCHEMA.fieldNames())
    arrays = history(spark, d).groupBy(F.shiftright("seq", 14).alias("run")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("run").text(path)
    return tb.read_json_array(spark, path, tb.HISTORY_SCHEMA)


@query("latest_n", f"{HISTORY} ORDER BY timestamp DESC LIMIT 100")
def latest_n(spark, d):
    return od.latest_n(history(spark, d), "timestamp", ["seq"]).drop("seq")


@query(
    "write_pair",
    f"""WITH {b.PAIRS} SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, source, target FROM pairs
        WHERE source <> target""",
)
def write_pair(spark, d):
    folder = scratch_path(spark, "pair")
    # Positions with gaps, as filters leave them.
    some = b.pairs_once(spark, d).filter(F.col("source") != F.col("target"))
    return pr.read_parquet_pair(spark, *pr.write_pair(some, folder, "set", "es", "fr"))


SEED = "'|42'"
SPLIT = f"""{b.PAIRS},
clean AS (SELECT dataset, row_index, source_lang, target_lang, {b.sql_normalize('source')} AS source,
                 {b.sql_normalize('target')} AS target FROM pairs),
kept AS (SELECT * FROM clean WHERE length(source) > 0 AND length(target) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_lang ORDER BY md5(dataset || '|' || row_index || {SEED})) AS rnk,
                  count(*) OVER (PARTITION BY source_lang) AS n FROM kept),
split AS (SELECT dataset, row_index, source_lang, target_lang, source, target,
                 CASE WHEN rnk <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ranked)"""
MIRRORED = f"""{SPLIT},
both_ways AS (SELECT dataset, row_index, source, target, source_lang, target_lang, 0 AS direction, split FROM split
  UNION ALL SELECT dataset, row_index, target, source, target_lang, source_lang, 1, split FROM split)"""


POSITION = f"row_number() OVER (ORDER BY md5(dataset || '|' || row_index || '|' || direction || {SEED})) - 1 AS position"


@query("stratified_split", f"WITH {SPLIT} SELECT dataset, row_index, source_lang, split FROM split")
def stratified_split(spark, d):
    from duolex.operators.filters import normalize_pairs

    clean = normalize_pairs(b.pairs(spark, d)).select("dataset", "row_index", "source_lang")
    return od.stratified_split(clean, ["dataset", "row_index"]).select("dataset", "row_index", "source_lang", "split")


@query("strata_counts", f"WITH {b.PAIRS} SELECT source_lang, count(*) AS n FROM pairs GROUP BY source_lang")
def strata_counts(spark, d):
    return od.strata_counts(b.pairs_once(spark, d))


@query(
    "hash_split",
    f"""WITH {b.PAIRS}, both_ways AS (SELECT *, 0 AS direction FROM pairs UNION ALL SELECT *, 1 FROM pairs)
        SELECT dataset, row_index, direction,
        CASE WHEN substr(md5(dataset || '|' || row_index || {SEED}), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split
        FROM both_ways""",
)
def hash_split(spark, d):
    from duolex.operators.filters import mirror

    marked = od.hash_split(mirror(b.pairs_once(spark, d)), ["dataset", "row_index"])
    return marked.select("dataset", "row_index", "direction", "split")


@query(
    "write_splits",
    f"WITH {MIRRORED} SELECT {TAGGED}, split, {POSITION} FROM both_ways",
)
def write_splits(spark, d):
    path = scratch_path(spark, "splits")
    prepared = corpus.prepare_pairs(b.pairs_once(spark, d))
    tb.write_splits(prepared, path, in_order=True)
    return tb.read_splits(spark, path).select(*tb.TAGGED_SCHEMA.fieldNames(), "split", "position")


@query(
    "shuffle",
    f"""SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id || {SEED}), doc_id) - 1 AS position FROM documents""",
)
def shuffle(spark, d):
    return od.shuffle_positions(b.documents(spark, d).select("doc_id", "lang"), ["doc_id"])


@query("sample_n", f"SELECT doc_id, text FROM documents ORDER BY md5(doc_id || {SEED}), doc_id LIMIT 2000")
def sample_n(spark, d):
    return od.sample_n(b.documents(spark, d).select("doc_id", "text"), ["doc_id"], od.SAMPLE_ROWS)


@query(
    "alignment_check",
    """SELECT count(*) FILTER (lang = 'en') AS left_rows, count(*) FILTER (lang = 'de') AS right_rows,
       count(*) FILTER (lang = 'en') = count(*) FILTER (lang = 'de') AS aligned FROM documents""",
)
def alignment_check(spark, d):
    docs = b.documents(spark, d)
    return jn.alignment_check(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"))


@query("zip_rows", f"WITH {b.PAIRS} SELECT dataset, row_index, source, target FROM pairs")
def zip_rows(spark, d):
    return b.pairs_once(spark, d).select("dataset", "row_index", "source", "target")


@query("union_datasets", f"WITH {b.PAIRS} SELECT dataset, source, target, {TAGGED[16:]} FROM pairs")
def union_datasets(spark, d):
    return b.pairs_once(spark, d).select("dataset", *tb.TAGGED_SCHEMA.fieldNames())


BUDGET = f"""WITH {NUMBERED},
sizes AS (SELECT dataset, ordinal, greatest(coalesce(n, 0) - 3, 0) AS usable
          FROM (SELECT 'src' || i AS dataset, i AS ordinal FROM range(20) t(i))
          LEFT JOIN (SELECT dataset, count(*) AS n FROM numbered GROUP BY 1) USING (dataset)),
quota AS (SELECT *, coalesce(sum(usable) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM sizes)
SELECT n.dataset, n.doc_id, n.row_index, q.ordinal FROM numbered n JOIN quota q USING (dataset)
WHERE n.row_index >= 3 AND n.row_index - 3 < CASE WHEN {{first}} THEN usable ELSE least(usable, {{rows}} - ahead) END"""
SOURCES = [f"src{i}" for i in range(20)]


@query("row_budget", BUDGET.format(first="FALSE", rows=310))
def row_budget(spark, d):
    return ds.row_budget(_numbered(spark, d), SOURCES, 310, start=3)


@query("row_budget_first_complete", BUDGET.format(first="ordinal = 0", rows=20))
def row_budget_first(spark, d):
    return ds.row_budget(_numbered(spark, d), SOURCES, 20, start=3, first_complete=True)


@query(
    "retention_report",
    f"""SELECT dataset, count(*) AS rows_in, count(*) FILTER (kept) AS rows_kept FROM (
          SELECT source AS dataset, {b.sql_strip('text')} IS DISTINCT FROM {b.sql_normalize('text')} AS kept FROM documents)
        GROUP BY ROLLUP (dataset)""",
)
def retention_report(spark, d):
    kept = ~tx.strip("text").eqNullSafe(tx.normalize_text("text"))
    return rp.retention_report(b.documents(spark, d).withColumnRenamed("source", "dataset"), kept)


@query(
    "dynamic_max_len",
    f"""WITH {b.PAIRS}, pooled AS (
          SELECT dataset, row_index, 0 AS side, source AS text FROM pairs
          UNION ALL SELECT dataset, row_index, 1, target FROM pairs),
        picked AS (SELECT text FROM pooled ORDER BY md5(dataset || '|' || row_index || '|' || side || {SEED}) LIMIT 2000)
        SELECT CAST(trunc(least(greatest(quantile_cont(len({b.sql_words('text')}), 0.93), 32), 4096)) AS INT) AS max_len
        FROM picked""",
)
def dynamic_max_len(spark, d):
    picked = rp.sample_texts(b.pairs(spark, d), ["dataset", "row_index"])
    # The texts are long, so the usual upper bound of 256 would hide the percentile.
    return rp.dynamic_max_len(picked.select(F.size(tx.word_array("text")).alias("length")), high=4096)


@query(
    "epoch_means",
    """SELECT strftime(ts, '%Y-%m-%d') AS epoch, event_type AS phase, round(avg(value), 6) AS mean_loss
       FROM events GROUP BY 1, 2""",
)
def epoch_means(spark, d):
    steps = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("epoch"), F.col("event_type").alias("phase"), F.col("value").alias("loss")
    )
    return rp.epoch_means(steps).withColumn("mean_loss", F.round("mean_loss", 6))


def languages(spark):
    return spark.createDataFrame([(n, n, i) for n, i in b.NAMED.items()], tb.LANGUAGE_SCHEMA)


NAMES = "(VALUES ('English', 'en'), ('German', 'de'), ('Spanish', 'es')) AS dim(name, iso)"
NAME_OF = "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE 'French' END"


def _named(spark, d):
    name = F.create_map(*[F.lit(x) for n, i in b.NAMED.items() for x in (i, n)])
    docs = b.documents(spark, d)
    return docs.withColumn("name", F.coalesce(name[F.col("lang")], F.lit("French")))


@query(
    "to_iso",
    f"""SELECT doc_id, iso, text FROM (SELECT doc_id, text, {NAME_OF} AS name FROM documents) JOIN {NAMES} USING (name)""",
)
def to_iso(spark, d):
    return fq.to_iso(_named(spark, d).select("doc_id", "name", "text"), languages(spark)).select("doc_id", "iso", "text")


WORD_ROWS = f"SELECT lang AS iso, unnest({b.sql_words('text')}) AS term FROM documents"
DICTIONARY = f"dictionary AS (SELECT iso, term, count(*) AS count FROM ({WORD_ROWS}) GROUP BY iso, term)"


def dictionary(spark, d):
    return fq.count_words(b.documents(spark, d).select(F.col("lang").alias("iso"), "text"))


@query("top_words", f"WITH {DICTIONARY} SELECT iso, term, count FROM dictionary")
def top_words(spark, d):
    return fq.most_common(dictionary(spark, d))


@query(
    "word_frequency",
    f"""WITH {b.PAIRS}, stacked AS (SELECT source_lang AS iso, source AS text FROM pairs
             UNION ALL SELECT target_lang, target FROM pairs)
        SELECT iso, term, count(*) AS count FROM (SELECT iso, unnest({b.sql_words('text')}) AS term FROM stacked)
        WHERE iso <> 'fr' GROUP BY iso, term HAVING count(*) >= 2""",
)
def word_frequency(spark, d):
    listed = spark.createDataFrame([(i, i, i) for i in b.NAMED.values()], tb.LANGUAGE_SCHEMA)
    return fq.word_frequency(b.pairs_once(spark, d), listed, min_count=2)


@query("most_common", f"WITH {DICTIONARY} SELECT iso, term, count FROM dictionary WHERE count >= 3")
def most_common(spark, d):
    return fq.most_common(fq.count_words(b.documents(spark, d).select(F.col("lang").alias("iso"), "text"), 3))


@query("write_dictionary", f"WITH {DICTIONARY} SELECT iso, term, count FROM dictionary")
def write_dictionary(spark, d):
    path = scratch_path(spark, "dictionary")
    tb.write_dictionary(dictionary(spark, d), path)
    return tb.read_dictionary(spark, path)
