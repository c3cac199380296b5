"""Queries over text expressions, filters and pair shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolex.functions import text as tx
from duolex.functions.repair import fix_text
from duolex.operators import filters as fl
from duolex.suite import base as b
from duolex.suite.base import query, table


@query("strip", f"SELECT doc_id, {b.sql_strip('chr(160) || text || chr(10)')} AS text FROM documents")
def strip(spark, d):
    padded = F.concat(F.lit(" "), F.col("text"), F.lit("\n"))
    return b.documents(spark, d).select("doc_id", tx.strip(padded).alias("text"))


@query("fix_text")
def fix(spark, d):
    return table(spark, d, "pages").select("page_id", fix_text(F.col("html")).alias("html"))


@query(
    "fix_text_misread",
    "SELECT doc_id, text || ' \"x\" AB ' || 'it''s' AS text FROM documents",
)
def fix_misread(spark, d):
    """Texts read as Latin-1 instead of UTF-8, with curly quotes, full-width letters and ligatures."""
    odd = F.concat(F.replace("text", F.lit("fi"), F.lit("\ufb01")), F.lit(" \u201cx\u201d \uff21\uff22 it\u2019s"))
    misread = F.decode(F.encode(odd, "UTF-8"), "ISO-8859-1")
    return b.documents(spark, d).select("doc_id", fix_text(misread).alias("text"))


@query("fix_text_runs", "SELECT doc_id, text || ' 😀 ' || text || ' naïve café 😀 жук' AS text FROM documents")
def fix_runs(spark, d):
    """Texts half misread twice and half as they were, between an emoji as it was and a misread one."""

    def misread(text):
        return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")

    mixed = F.concat(misread(misread(F.col("text"))), F.lit(" 😀 "), "text", F.lit(" naïve "), misread(F.lit("café 😀 жук")))
    return b.documents(spark, d).select("doc_id", fix_text(mixed).alias("text"))


@query("strip_tags", f"SELECT page_id, {b.sql_tags('html')} AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags("html").alias("text"))


LINKED = "html || ' see ' || url || ' now'"


@query("strip_urls", f"SELECT page_id, {b.sql_urls(LINKED)} AS text FROM pages")
def strip_urls(spark, d):
    linked = F.concat("html", F.lit(" see "), "url", F.lit(" now"))
    return table(spark, d, "pages").select("page_id", tx.strip_urls(linked).alias("text"))


@query("collapse_punct", f"SELECT doc_id, {b.sql_punct('text')} AS text FROM documents")
def collapse_punct(spark, d):
    return b.documents(spark, d).select("doc_id", tx.collapse_punct("text").alias("text"))


@query(
    "normalize_text",
    f"""SELECT 'documents' AS origin, doc_id AS id, {b.sql_normalize('text')} AS text FROM documents
        UNION ALL SELECT 'pages', page_id, {b.sql_normalize(LINKED)} FROM pages""",
)
def normalize_text(spark, d):
    linked = F.concat("html", F.lit(" see "), "url", F.lit(" now"))
    docs = b.documents(spark, d).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), linked.alias("text"))
    both = docs.unionByName(pages)
    return both.withColumn("text", tx.normalize_text("text"))


@query(
    "tokenize_words",
    f"""SELECT doc_id, len(words) AS n_words, array_to_string(words, ' ') AS words
        FROM (SELECT doc_id, {b.sql_words('text')} AS words FROM documents)""",
)
def tokenize_words(spark, d):
    words = b.documents(spark, d).select("doc_id", tx.word_array("text").alias("words"))
    return words.select("doc_id", F.size("words").alias("n_words").cast("long"), F.concat_ws(" ", "words").alias("words"))


@query(
    "tokenize_keep",
    f"""SELECT conv_id, turn, len(parts) AS n_parts, array_to_string(parts, '|') AS parts
        FROM (SELECT conv_id, turn, {b.sql_keep('text')} AS parts FROM conversations)""",
)
def tokenize_keep(spark, d):
    parts = table(spark, d, "conversations").select("conv_id", "turn", tx.keep_array("text").alias("parts"))
    return parts.select("conv_id", "turn", F.size("parts").cast("long").alias("n_parts"), F.concat_ws("|", "parts").alias("parts"))


LOWERED = "' ' || lower(substr(text, 1, 1)) || regexp_replace(substr(text, 2), '[.]$', '')"


@query("sentence_case", f"SELECT conv_id, turn, {b.sql_sentence('t')} AS text FROM (SELECT conv_id, turn, {LOWERED} AS t FROM conversations)")
def sentence_case(spark, d):
    rest = F.col("text").substr(F.lit(2), F.length("text"))
    lowered = F.concat(F.lit(" "), F.lower(F.substring("text", 1, 1)), F.regexp_replace(rest, r"[.]\z", ""))
    turns = table(spark, d, "conversations").select("conv_id", "turn", lowered.alias("t"))
    return turns.select("conv_id", "turn", tx.sentence_case("t").alias("text"))


@query(
    "token_kind",
    f"""SELECT doc_id, count(*) AS n_tokens, count(*) FILTER ({b.sql_is_word('part')}) AS n_words
        FROM (SELECT doc_id, unnest({b.sql_keep('text')}) AS part FROM documents) GROUP BY doc_id""",
)
def token_kind(spark, d):
    parts = tx.keep_array("text")
    return b.documents(spark, d).select(
        "doc_id",
        F.size(parts).cast("long").alias("n_tokens"),
        F.size(F.filter(parts, tx.is_word)).cast("long").alias("n_words"),
    )


@query(
    "transfer_casing",
    r"""SELECT DISTINCT lang, token, list_reduce(list_transform(range(1, length(lower(token)) + 2), lambda i:
             CASE WHEN i = 1 THEN '' ELSE
               (CASE WHEN substr(token, least(i, length(token)), 1) = upper(substr(token, least(i, length(token)), 1))
                      AND substr(token, least(i, length(token)), 1) <> lower(substr(token, least(i, length(token)), 1))
                THEN upper(substr(lower(token) || 'x', i, 1)) ELSE substr(lower(token) || 'x', i, 1) END) END),
             lambda a, c: a || c) AS cased
        FROM (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS token FROM documents)""",
)
def transfer_casing(spark, d):
    # The suggestion is the token's own letters from the second on, and one letter more.
    words = b.documents(spark, d).select("lang", F.explode(F.filter(tx.keep_array("text"), lambda t: t.rlike(f"^[{tx.WORD}]"))).alias("token"))
    longer = F.concat(F.lower("token"), F.lit("x"))
    cased = tx.transfer_casing("token", longer)
    return words.distinct().select("lang", "token", cased.substr(F.lit(2), F.length(cased)).alias("cased"))


@query("lang_code", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' ELSE lang END AS code FROM documents")
def lang_code(spark, d):
    return b.documents(spark, d).select("doc_id", tx.lang_code(F.upper("lang"), {"EN": "ENG", "DE": "Ger"}).alias("code"))


@query("format_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def format_ts(spark, d):
    return table(spark, d, "events").select("event_id", tx.format_ts("ts").alias("at"))


@query("clip", "SELECT event_id, least(greatest(value, 5.0), 20.0) AS value FROM events")
def clip(spark, d):
    return table(spark, d, "events").select("event_id", tx.clip("value", 5.0, 20.0).alias("value"))


@query(
    "cap_length",
    "SELECT doc_id, substr(text, 1, 200) AS capped, length(text)::VARCHAR || '/200' AS counter FROM documents",
)
def cap_length(spark, d):
    return b.documents(spark, d).select("doc_id", tx.cap_length("text").alias("capped"), tx.length_counter("text").alias("counter"))


DIRECTIONS = "role || CASE WHEN turn % 3 = 2 THEN ' -> next->' ELSE ' -> ' END || 'turn ' || turn::VARCHAR"


@query(
    "parse_direction",
    f"""SELECT conv_id, turn, source_lang, target_lang, source_lang || '->' || target_lang AS direction
        FROM (SELECT conv_id, turn, CASE WHEN len(p) = 2 THEN trim(p[1]) END AS source_lang,
                     CASE WHEN len(p) = 2 THEN trim(p[2]) END AS target_lang
              FROM (SELECT conv_id, turn, string_split({DIRECTIONS}, '->') AS p FROM conversations))""",
)
def parse_direction(spark, d):
    middle = F.when(F.col("turn") % 3 == 2, " -> next->").otherwise(" -> ")
    text = F.concat("role", middle, F.lit("turn "), F.col("turn").cast("string"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", tx.parse_direction(text).alias("p"))
    return turns.select("conv_id", "turn", "p.*").withColumn("direction", tx.make_direction("source_lang", "target_lang"))


@query(
    "drop_identical",
    f"""SELECT doc_id, source, target FROM (
          SELECT doc_id, {b.sql_strip('text')} AS source, {b.sql_normalize('text')} AS target FROM documents)
        WHERE source IS DISTINCT FROM target""",
)
def drop_identical(spark, d):
    # Texts that normalizing leaves alone are the identical pairs.
    sides = b.documents(spark, d).select("doc_id", tx.strip("text").alias("source"), tx.normalize_text("text").alias("target"))
    return fl.drop_identical(sides)



@query(
    "drop_empty",
    f"""SELECT page_id, source, target FROM (
          SELECT page_id, {b.sql_normalize("regexp_replace(url, '^https://', 'www.')")} AS source, {b.sql_normalize('html')} AS target
          FROM (SELECT page_id, regexp_replace(url, '^http://', '') AS url, html FROM pages))
        WHERE length(source) > 0 AND length(target) > 0""",
)
def drop_empty(spark, d):
    # Addresses that stay links normalize to nothing.
    bare = F.regexp_replace(F.regexp_replace("url", "^http://", ""), "^https://", "www.")
    sides = table(spark, d, "pages").select("page_id", bare.alias("source"), F.col("html").alias("target"))
    return fl.normalize_pairs(sides)


@query("tag_languages", "SELECT doc_id, text, 'English' AS source_lang, 'Turkish' AS target_lang FROM documents")
def tag_languages(spark, d):
    return fl.tag_languages(b.documents(spark, d).select("doc_id", "text"), "English", "Turkish")


@query(
    "mirror",
    f"""WITH {b.PAIRS}
        SELECT dataset, row_index, source, target, source_lang, target_lang, 0 AS direction FROM pairs
        UNION ALL
        SELECT dataset, row_index, target, source, target_lang, source_lang, 1 FROM pairs""",
)
def mirror(spark, d):
    return fl.mirror(b.pairs_once(spark, d).drop("ordinal"))


@query(
    "make_prompt",
    f"""WITH {b.PAIRS} SELECT dataset, row_index,
        'translate ' || source_lang || ' to ' || target_lang || ': ' || source AS prompt FROM pairs""",
)
def make_prompt(spark, d):
    return b.pairs_once(spark, d).select("dataset", "row_index", tx.make_prompt("source_lang", "target_lang", "source").alias("prompt"))


@query(
    "complete_records",
    """SELECT a.conv_id, a.turn, a.text AS source_text, b.text AS target_text, a.role AS direction
       FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def complete_records(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    records = turns.join(answers, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("text").alias("source_text"), "target_text", F.col("role").alias("direction")
    )
    return fl.complete_records(records, ["source_text", "target_text", "direction"])


@query(
    "correction_gate",
    "SELECT doc_id, lang, text FROM documents WHERE lang IN ('en', 'de') AND trim(text) <> '' AND length(text) <= 1000",
)
def correction_gate(spark, d):
    return fl.correction_gate(b.documents(spark, d).select("doc_id", "lang", "text"), ["en", "de"])
