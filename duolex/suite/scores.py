"""Queries over vectors, models, METEOR and training examples."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions.vectors import pair_cosine
from duolex.operators import examples as ex
from duolex.operators import filters as fl
from duolex.operators import inference as inf
from duolex.operators import meteor as mt
from duolex.plans import corpus, language
from duolex.session import scratch_path
from duolex.sources import pairs as pr
from duolex.sources import tables as tb
from duolex.suite import base as b
from duolex.suite import tables as st
from duolex.suite.base import query, table

VECTOR_PAIRS = """SELECT a.vec_id // 2 AS pair_id, round(coalesce(CASE
    WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0 ELSE list_cosine_similarity(x, y) END, 0), 6) AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a
  JOIN (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings) z ON a.vec_id + 1 = z.vec_id AND a.vec_id % 2 = 0"""


def vector_pairs(spark, d):
    """Neighbouring vectors as the two sides of a pair, scored."""
    vectors = table(spark, d, "embeddings").select(F.expr("vec_id div 2").alias("pair_id"), F.col("vec_id") % 2 == 0, "embedding")
    vectors = vectors.toDF("pair_id", "first", "embedding")
    left = vectors.filter("first").select("pair_id", F.col("embedding").alias("a"))
    right = vectors.filter("not first").select("pair_id", F.col("embedding").alias("z"))
    return left.join(right, "pair_id").select("pair_id", F.round(pair_cosine("a", "z"), 6).alias("score"))


@query("pair_cosine", VECTOR_PAIRS)
def cosine(spark, d):
    return vector_pairs(spark, d)


@query("similarity_filter", f"SELECT * FROM ({VECTOR_PAIRS}) WHERE score >= 0.1")
def similarity_filter(spark, d):
    # No pair of these vectors reaches the usual 0.7.
    return fl.similarity_filter(vector_pairs(spark, d), threshold=0.1)


@query("encode", f"""SELECT doc_id, 64 AS dim, len(list_filter(string_split_regex(text, '[{b.W}]+'), lambda w: w <> ''))::DOUBLE AS total
                     FROM documents""")
def encode(spark, d):
    vectors = b.documents(spark, d).select("doc_id", inf.encode("text", inf.hashing_encoder).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return vectors.select("doc_id", F.size("v").alias("dim"), total.alias("total"))


@query("translate", f"WITH {b.PAIRS} SELECT dataset, row_index, source AS prediction FROM pairs")
def translate(spark, d):
    made = inf.translate(b.pairs_once(spark, d), inf.identity_translator)
    return made.select("dataset", "row_index", "prediction")


TURNS = """turns AS (SELECT a.conv_id || '-' || a.turn AS row_id, a.text AS prediction, z.text AS reference,
    'user' AS source_lang, 'assistant' AS target_lang
  FROM conversations a JOIN conversations z ON a.conv_id = z.conv_id AND z.turn = a.turn + 1
  WHERE a.role = 'user' AND z.role = 'assistant')"""


def meteor_sql(rows: str, carry: str = "") -> str:
    """CTEs ending in `scored` (row_id, carry, matches, chunks, meteor) for a CTE named `rows`."""

    def side(column: str) -> str:
        tokens = rf"regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{b.W}]')"
        return f"""SELECT row_id, token, pos, row_number() OVER (PARTITION BY row_id, token ORDER BY pos DESC) AS k FROM (
            SELECT row_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM (SELECT row_id, {tokens} AS toks FROM {rows}))"""

    return f"""hyp AS ({side('prediction')}), ref AS ({side('reference')}),
    matched AS (SELECT h.row_id, h.pos AS hp, r.pos AS rp FROM hyp h JOIN ref r USING (row_id, token, k)),
    steps AS (SELECT row_id, CASE WHEN hp - lag(hp) OVER w = 1 AND rp - lag(rp) OVER w = 1 THEN 0 ELSE 1 END AS starts
              FROM matched WINDOW w AS (PARTITION BY row_id ORDER BY hp)),
    chunked AS (SELECT row_id, count(*) AS m, sum(starts) AS c FROM steps GROUP BY row_id),
    sized AS (SELECT row_id, (SELECT 1) AS one FROM {rows}),
    np AS (SELECT row_id, count(*) AS n FROM hyp GROUP BY row_id), nr AS (SELECT row_id, count(*) AS n FROM ref GROUP BY row_id),
    scored AS (SELECT t.row_id, {carry} coalesce(m, 0) AS matches, coalesce(c, 0)::BIGINT AS chunks,
        CASE WHEN m > 0 THEN (1 - 0.5 * pow(c::DOUBLE / m, 3)) * (m::DOUBLE / np.n) * (m::DOUBLE / nr.n)
             / (0.9::DOUBLE * (m::DOUBLE / np.n) + 0.1::DOUBLE * (m::DOUBLE / nr.n)) ELSE 0 END AS meteor
      FROM {rows} t LEFT JOIN chunked USING (row_id) LEFT JOIN np USING (row_id) LEFT JOIN nr USING (row_id))"""


def turn_pairs(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    asked = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"])
    return asked.select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), F.col("text").alias("prediction"), "reference")


@query("meteor_row", f"WITH {TURNS}, {meteor_sql('turns')} SELECT row_id, matches, chunks, round(meteor, 6) AS meteor FROM scored")
def meteor_row(spark, d):
    return mt.meteor_row(turn_pairs(spark, d)).withColumn("meteor", F.round("meteor", 6))


@query("meteor_corpus", f"WITH {TURNS}, {meteor_sql('turns')} SELECT round(avg(meteor), 6) AS meteor, count(*) AS n_rows FROM scored")
def meteor_corpus(spark, d):
    return mt.meteor_corpus(mt.meteor_row(turn_pairs(spark, d))).withColumn("meteor", F.round("meteor", 6))


@query("write_metrics", f"WITH {TURNS}, {meteor_sql('turns')} SELECT round(avg(meteor), 6) AS meteor FROM scored")
def write_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    tb.write_metrics(meteor_corpus(spark, d).select("meteor"), path)
    return spark.read.schema("meteor double").json(path)


EVALUATED = """keyed AS (SELECT dataset || '-' || row_index AS row_id, source AS prediction, target AS reference,
    source_lang, target_lang FROM pairs)"""


@query(
    "evaluate_translations",
    f"""WITH {b.PAIRS}, {EVALUATED}, {meteor_sql('keyed', 'source_lang, target_lang,')}
        SELECT source_lang, target_lang, round(avg(meteor), 6) AS meteor, count(*) AS n_rows
        FROM scored GROUP BY ROLLUP (source_lang, target_lang)""",
)
def evaluate(spark, d):
    keyed = b.pairs_once(spark, d).withColumn("row_id", F.concat_ws("-", "dataset", "row_index"))
    scores = language.evaluate_translations(keyed, inf.identity_translator, "row_id", ["source_lang", "target_lang"])
    return scores.withColumn("meteor", F.round("meteor", 6))


@query(
    "evaluate_output",
    f"""WITH {b.PAIRS}, {EVALUATED}, {meteor_sql('keyed', 'source_lang, target_lang,')}
        SELECT round(avg(meteor), 6) AS meteor FROM scored""",
)
def evaluate_output(spark, d):
    path = scratch_path(spark, "scores")
    keyed = b.pairs_once(spark, d).withColumn("row_id", F.concat_ws("-", "dataset", "row_index"))
    language.evaluate_translations(keyed, inf.identity_translator, "row_id", output=path)
    return spark.read.schema("meteor double").json(path).withColumn("meteor", F.round("meteor", 6))


WIDE_KEY = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 9007199254740992 + doc_id END"


@query(
    "translate_nullable",
    f"""SELECT doc_id, {WIDE_KEY} AS wide, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS source, lang AS source_lang,
               'xx' AS target_lang, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS prediction FROM documents""",
)
def translate_nullable(spark, d):
    docs = b.documents(spark, d).select(
        "doc_id",
        F.expr(WIDE_KEY).alias("wide"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END").alias("source"),
        F.col("lang").alias("source_lang"),
        F.lit("xx").alias("target_lang"),
    )
    return inf.translate(docs, inf.identity_translator)


def letter_encoder():
    """Counts of the letters a to z; a model plain enough for SQL to repeat."""

    def model(texts):
        return np.array([[t.count(chr(c)) for c in range(97, 123)] for t in texts], dtype=np.float32)

    return model


def _letters(e: str) -> str:
    return "[" + ", ".join(f"(length({e}) - length(replace({e}, '{chr(c)}', '')))::DOUBLE" for c in range(97, 123)) + "]"


# Every document with the next one; a data set for each source language, numbered from 0.
NUMBERED_PAIRS = f"""{b.PAIRS.replace("pairs AS (", "every_pair AS (")},
numbered AS (SELECT dataset, source, target, row_number() OVER (PARTITION BY dataset ORDER BY row_index) - 1 AS row_index FROM every_pair)"""


@query(
    "clean_corpus",
    f"""WITH {NUMBERED_PAIRS},
        lined AS (SELECT dataset, row_index, {b.sql_strip(st.FLAT.replace('text', 'source'))} AS source,
                         {b.sql_strip(st.FLAT.replace('text', 'target'))} AS target FROM numbered),
        differing AS (SELECT *, {_letters('source')} AS x, {_letters('target')} AS y FROM lined WHERE source <> target),
        scored AS (SELECT *, CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0
                                  ELSE list_cosine_similarity(x, y) END AS score FROM differing)
        SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_index) - 1 AS row_index, source, target
        FROM scored WHERE score >= 0.8""",
)
def clean_corpus(spark, d):
    """All documents as two text files for each data set, each cleaned by the plan."""
    folder, output = scratch_path(spark, "text"), scratch_path(spark, "cleaned")
    pairs = b.pairs(spark, d)
    cleaned = []
    for name in b.LANGUAGES:
        for side, column in (("from", "source"), ("to", "target")):
            st._write_lines(pairs.filter(F.col("dataset") == name), f"{folder}/{name}-{side}.txt", "row_index", column)
        corpus.clean_corpus(spark, folder, output, name, "from", "to", letter_encoder, threshold=0.8)
        sides = [pr.side_path(output, name, side) for side in ("from", "to")]
        cleaned.append(pr.read_parquet_pair(spark, *sides).select(F.lit(name).alias("dataset"), "row_index", "source", "target"))
    return functools.reduce(DataFrame.unionByName, cleaned)


VOCABULARY = f"""{st.DICTIONARY},
vocab AS (SELECT term, (row_number() OVER (ORDER BY n DESC, md5(term)) + 2)::INT AS id
          FROM (SELECT term, sum(count) AS n FROM dictionary GROUP BY term))"""


@query("vocabulary", f"WITH {VOCABULARY} SELECT term, id FROM vocab")
def vocabulary(spark, d):
    return ex.vocabulary(st.dictionary(spark, d)).select("term", "id")


def _side_ids(text: str, name: str) -> str:
    return f"""{name} AS (SELECT dataset, row_index, list(id ORDER BY pos) AS ids FROM (
        SELECT dataset, row_index, unnest(words) AS term, unnest(range(len(words))) AS pos
        FROM (SELECT dataset, row_index, list_slice({b.sql_words(text)}, 1, 63) AS words FROM pairs)) w
      JOIN (SELECT term, id FROM vocab) v USING (term) GROUP BY dataset, row_index)"""


def _pad(ids: str, filler: str) -> str:
    return f"array_to_string(list_concat({ids}, list_transform(range(64 - len({ids})), lambda i: {filler})), ' ')"


PROMPT = "'translate ' || source_lang || ' to ' || target_lang || ': ' || source"


@query(
    "build_examples",
    f"""WITH {b.PAIRS}, {VOCABULARY}, {_side_ids(PROMPT, 'prompts').replace('JOIN (SELECT term, id FROM vocab) v', 'LEFT JOIN (SELECT term, id FROM vocab) v').replace('list(id ORDER BY pos)', 'list(coalesce(id, 2) ORDER BY pos)')},
        {_side_ids('target', 'targets')},
        closed AS (SELECT dataset, row_index, list_append(coalesce(p.ids, []), 1) AS s, list_append(coalesce(t.ids, []), 1) AS t
                   FROM pairs LEFT JOIN prompts p USING (dataset, row_index) LEFT JOIN targets t USING (dataset, row_index))
        SELECT dataset, row_index, {_pad('s', '0')} AS input_ids,
               {_pad('list_transform(s, lambda i: 1)', '0')} AS attention_mask, {_pad('t', '-100')} AS labels FROM closed""",
)
def build_examples(spark, d):
    vocab = ex.vocabulary(st.dictionary(spark, d))
    made = ex.build_examples(b.pairs(spark, d), vocab, ["dataset", "row_index"], max_len=64)
    lists = {c: F.concat_ws(" ", F.col(c).cast("array<string>")) for c in ("input_ids", "attention_mask", "labels")}
    return made.withColumns(lists)


@query(
    "prepare_corpus",
    f"""WITH {NUMBERED_PAIRS},
        pairs AS (SELECT dataset, row_index, source, target, 'left' AS source_lang, 'right' AS target_lang FROM numbered WHERE row_index >= 2),
        {st.MIRRORED[len(b.PAIRS) + 2:]}
        SELECT {st.TAGGED}, split, {st.POSITION} FROM both_ways""",
)
def prepare_corpus(spark, d):
    """All documents as the two sides of a data set for each language."""
    base, output = scratch_path(spark, "base"), scratch_path(spark, "prepared")
    pairs = b.pairs(spark, d)
    for name in b.LANGUAGES:
        for side, column in (("left", "source"), ("right", "target")):
            rows = pairs.filter(F.col("dataset") == name).orderBy("row_index").select(F.col(column).alias(side))
            rows.write.parquet(pr.side_path(f"{base}/{name}", name, side))
    corpus.prepare_corpus(spark, base, b.LANGUAGES, "left", "right", output, start=2)
    return tb.read_splits(spark, output).select(*tb.TAGGED_SCHEMA.fieldNames(), "split", "position")


@query(
    "build_dictionary",
    f"""WITH {st.MIRRORED}, stacked AS (SELECT source_lang AS iso, source AS text FROM both_ways
             UNION ALL SELECT target_lang, target FROM both_ways)
        SELECT iso, term, count(*) AS count FROM (SELECT iso, unnest({b.sql_words('text')}) AS term FROM stacked)
        WHERE iso <> 'fr' GROUP BY iso, term""",
)
def build_dictionary(spark, d):
    splits, names, output = (scratch_path(spark, n) for n in ("splits", "names", "dictionaries"))
    tb.write_splits(corpus.prepare_pairs(b.pairs_once(spark, d)), splits, in_order=True)
    listed = spark.createDataFrame([(i, i, i) for i in b.NAMED.values()], tb.LANGUAGE_SCHEMA)
    array = listed.agg(F.to_json(F.collect_list(F.struct(*listed.columns))).alias("value"))
    array.write.text(names)
    return language.build_dictionary(spark, splits, names, output)
