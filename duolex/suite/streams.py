"""Queries that run a stream to its end and return what it left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolex.functions import text as tx
from duolex.operators.filters import drop_empty
from duolex.operators.inference import identity_translator
from duolex.plans.log import translation_log
from duolex.session import scratch_path
from duolex.streaming import debounce as db
from duolex.streaming import frequency as sf
from duolex.streaming import history as hs
from duolex.streaming.run import drain
from duolex.suite import base as b
from duolex.suite.base import query, table
from duolex.suite.tables import DICTIONARY

# Users act about every ten hours, so a shorter gap would never merge two events.
GAP = 6 * 3600
FIRED = f"""SELECT user_id, ts + to_seconds({GAP}) AS fired, event_type FROM (
    SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
  WHERE event_type <> 'error' AND (later IS NULL OR later - ts > to_seconds({GAP}))"""
FIRED_TEXT = f"SELECT user_id, strftime(fired, '%Y-%m-%d %H:%M:%S.%f') AS fired_at, event_type FROM ({FIRED})"


def _shown(fired):
    return fired.withColumn("fired_at", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _stream(spark, path, schema, per_batch=None):
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


@query("debounce", FIRED_TEXT)
def debounce(spark, d):
    return _shown(db.debounce(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id", GAP, empty="error"))


# The events come in so many batches of time, each of so many files or as many as there are cores.
SLICES, FILES = 4, 4


def _keystrokes(spark, d):
    """The events as a stream of batches in order of time, so that open input carries over from one
    to the next; the last is one far later event that closes everything."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = scratch_path(spark, "typed")
    files = max(FILES, spark.sparkContext.defaultParallelism)
    at = F.unix_micros("ts")
    first, last = events.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - first) * SLICES / (last - first + 1))
    for i in range(SLICES):
        events.filter(part == i).repartition(files).write.mode("append").parquet(path)
    later = F.max("ts") + F.make_dt_interval(days=F.lit(2))
    events.agg(
        F.lit(-1).cast("long").alias("event_id"),
        F.lit(-1).cast("long").alias("user_id"),
        later.alias("ts"),
        F.lit("view").alias("event_type"),
    ).write.mode("append").parquet(path)
    return _stream(spark, path, events.schema, files)


@query("debounce_stream", FIRED_TEXT)
def debounce_stream(spark, d):
    output = scratch_path(spark, "fired")
    fired = db.debounce_stream(_keystrokes(spark, d), "user_id", "ts", "event_type", "event_id", GAP, empty="error")
    drain(fired, output=output)
    return _shown(spark.read.schema(fired.schema).parquet(output))


@query(
    "translation_log",
    f"""SELECT event_type AS source_text, event_type AS target_text, strftime(fired, '%Y-%m-%d %H:%M:%S') AS timestamp,
          'English->Turkish' AS direction
        FROM ({FIRED}) ORDER BY timestamp DESC, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT DESC LIMIT 100""",
)
def translated(spark, d):
    path = scratch_path(spark, "log")
    typed = _keystrokes(spark, d).select(
        F.col("user_id").alias("key"), "ts", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("value"),
        F.col("event_id").alias("seq"),
    )
    records, sink = translation_log(typed, identity_translator, "English", "Turkish", path, GAP)
    drain(records, sink)
    return hs.load_history(spark, path).drop("seq")


def _split_files(frame, spark, order, each=None):
    """The table as a stream of several batches, of several files each: as many in all as a shuffle
    has partitions, and a batch no fewer than there are cores, so that no task has a batch alone."""
    path = scratch_path(spark, "files")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = each or max(spark.sparkContext.defaultParallelism, -(-partitions // SLICES))
    frame.repartitionByRange(SLICES * each, order).write.parquet(path)
    return _stream(spark, path, frame.schema, each)


@query(
    "history_sink",
    """SELECT text AS source_text, 'to ' || text AS target_text,
         strftime(make_timestamp(2024, 1, 1, 0, 0, 0) + to_seconds(conv_id * 100 + turn), '%Y-%m-%d %H:%M:%S') AS timestamp,
         'en->' || role AS direction
       FROM conversations ORDER BY conv_id * 100 + turn DESC LIMIT 100""",
)
def history_sink(spark, d):
    turns = table(spark, d, "conversations")
    second = F.col("conv_id") * 100 + F.col("turn")
    live = _split_files(turns, spark, "conv_id", 1).select(
        F.col("text").alias("source"), F.concat(F.lit("to "), "text").alias("target"), F.lit("en").alias("source_lang"),
        F.col("role").alias("target_lang"), second.alias("seq"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=second.cast("decimal(18,6)"))).alias("ts"),
    )
    store = scratch_path(spark, "history")
    drain(hs.history_records(live, "ts", "seq"), hs.history_sink(store))
    return hs.load_history(spark, store).drop("seq")


@query("incremental_frequency", f"WITH {DICTIONARY} SELECT iso, term, count FROM dictionary")
def incremental_frequency(spark, d):
    docs = b.documents(spark, d)
    store = scratch_path(spark, "counts")
    live = _split_files(docs, spark, "doc_id").select(F.col("lang").alias("iso"), "text")
    drain(live, sf.frequency_sink(store))
    return sf.accumulated_frequency(spark, store)


@query("stream_normalize", f"SELECT doc_id, text FROM (SELECT doc_id, {b.sql_normalize('text')} AS text FROM documents) WHERE length(text) > 0")
def stream_normalize(spark, d):
    docs = b.documents(spark, d)
    output = scratch_path(spark, "normal")
    live = _split_files(docs, spark, "doc_id").select("doc_id", tx.normalize_text("text").alias("text"))
    clean = drop_empty(live, "text", "text")
    drain(clean, output=output)
    return spark.read.schema(clean.schema).parquet(output)
