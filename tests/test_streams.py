"""Streams against their batch forms."""

import datetime as dt
import random

from pyspark.sql import functions as F

from duolex.operators.filters import drop_empty
from duolex.session import scratch_path
from duolex.streaming import debounce as db
from duolex.streaming import frequency as sf
from duolex.streaming import history as hs
from duolex.streaming.run import drain

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    stamped = [(k, START + dt.timedelta(seconds=s), v, i) for i, (k, s, v) in enumerate(rows)]
    return spark.createDataFrame(stamped, "key string, ts timestamp, value string, seq long")


def shown(df):
    return sorted((r.key, (r.fired_at - START).total_seconds(), r.value) for r in df.collect())


def test_debounce_rules(spark):
    rows = [("a", 0, "h"), ("a", 0.5, "he"), ("a", 1.5, "hey"), ("b", 0, "x"), ("b", 0.2, ""), ("c", 5, "p"), ("c", 5, "q"), ("c", 6.1, "r")]
    got = shown(db.debounce(events(spark, rows), "key", "ts", "value", "seq", 1))
    # One second apart still cancels; an empty value is silent; of two at once the later counts.
    assert got == [("a", 2.5, "hey"), ("c", 6.0, "q"), ("c", 7.1, "r")]


def test_debounce_hot_key_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(db, "BUCKET_GAPS", 3)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", round(rng.uniform(0, 4000), 3), rng.choice(["", "u", "v"])) for _ in range(3000)]
    got = shown(db.debounce(events(spark, rows), "key", "ts", "value", "seq", 2))
    expected = []
    for key in {k for k, _, _ in rows}:
        mine = sorted((s, i, v) for i, (k, s, v) in enumerate(rows) if k == key)
        for (s, _, v), later in zip(mine, [*mine[1:], (1e9, 0, "")]):
            if v and later[0] - s > 2:
                expected.append((key, s + 2, v))
    assert [(k, round(s, 3), v) for k, s, v in got] == sorted((k, round(s, 3), v) for k, s, v in expected)


def test_stream_debounce_is_batch_debounce(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randint(0, 3)}", rng.randint(0, 500), rng.choice(["", "u", "v"])) for _ in range(400)]
    batch = events(spark, rows)
    path = scratch_path(spark, "in")
    batch.unionByName(events(spark, [("closing", 10_000, "z")])).write.parquet(path)
    live = spark.readStream.schema(batch.schema).parquet(path)
    output = scratch_path(spark, "out")
    fired = db.debounce_stream(live, "key", "ts", "value", "seq", 1)
    drain(fired, output=output)
    assert shown(spark.read.schema(fired.schema).parquet(output)) == shown(db.debounce(batch, "key", "ts", "value", "seq", 1))


def records(spark, lo, hi):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    df = spark.range(lo, hi).select(
        F.concat(F.lit("s"), "id").alias("source"), F.lit("t").alias("target"), F.lit("en").alias("source_lang"),
        F.lit("tr").alias("target_lang"), at.alias("ts"), "id",
    )
    return hs.history_records(df, "ts", "id")


def test_history_is_bounded_and_repeatable(spark):
    path = scratch_path(spark, "history")
    sink = hs.history_sink(path, 10)
    sink(records(spark, 0, 8), 0)
    sink(records(spark, 8, 12), 1)
    want = [f"s{i}" for i in range(11, 1, -1)]
    newest = lambda: [r.source_text for r in hs.load_history(spark, path).orderBy(F.desc("seq")).collect()]
    assert newest() == want
    sink(records(spark, 8, 12), 1)
    assert newest() == want
    assert hs.load_history(spark, scratch_path(spark, "nothing")).count() == 0


def test_frequency_batches_add_up_and_repeat(spark):
    path = scratch_path(spark, "counts")
    sink = sf.frequency_sink(path)
    first = spark.createDataFrame([("en", "a b a")], "iso string, text string")
    second = spark.createDataFrame([("en", "a c"), ("tr", "b")], "iso string, text string")
    sink(first, 0), sink(second, 1), sink(second, 1)
    got = {(r.iso, r.term): r["count"] for r in sf.accumulated_frequency(spark, path).collect()}
    assert got == {("en", "a"): 3, ("en", "b"): 1, ("en", "c"): 1, ("tr", "b"): 1}


def test_state_frequency(spark):
    path = scratch_path(spark, "texts")
    df = spark.createDataFrame([("en", "x y x")], "iso string, text string")
    df.write.parquet(path)
    seen = scratch_path(spark, "seen")
    live = sf.stream_frequency(spark.readStream.schema(df.schema).parquet(path))
    drain(live, lambda batch, i: batch.write.mode("overwrite").parquet(seen), mode="complete")
    assert {(r.term, r["count"]) for r in spark.read.parquet(seen).collect()} == {("x", 2), ("y", 1)}


def test_timers_carry_over_batches(spark):
    """One file a trigger: input stays open over batches, is replaced or cancelled by a later one, and fires in time."""
    batches = [
        [("a", 0, "x"), ("b", 0, "x"), ("c", 0, "x"), ("d", 0, "x"), (None, 0, "n")],
        [("a", 3, "y"), ("b", 3, ""), ("e", 3.5, "late enough")],
        [("d", 5.5, "z"), ("e", 2, "older"), ("f", 30, "w")],
        [("f", 22, "just in time"), ("g", 31, ""), ("g", 31, "same time")],
        [("f", 20, "too late"), ("closing", 100, "q")],
    ]
    path, output = scratch_path(spark, "in"), scratch_path(spark, "out")
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll
    live = spark.readStream.schema(events(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(db.debounce_stream(live, "key", "ts", "value", "seq", 4), output=output)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll)
    got = {(r.key, (r.fired_at - START).total_seconds(), r.value) for r in spark.read.parquet(output).collect()}
    assert got == {
        ("a", 7, "y"), ("c", 4, "x"), ("d", 4, "x"), (None, 4, "n"), ("d", 9.5, "z"), ("e", 7.5, "late enough"),
        ("f", 26, "just in time"), ("f", 34, "w"), ("g", 35, "same time"),
    }


def test_batches_in_any_order_within_the_watermark(spark):
    rng = random.Random(6)
    rows = sorted(((f"k{rng.randint(0, 4)}", round(rng.uniform(0, 300), 3), rng.choice(["", "u", "v"])) for _ in range(500)), key=lambda r: r[1])
    batch = events(spark, rows)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.uniform(0, 15))
    path, output = scratch_path(spark, "in"), scratch_path(spark, "out")
    for a in range(0, 500, 100):
        batch.filter(F.col("seq").isin(order[a : a + 100])).coalesce(1).write.mode("append").parquet(path)
    events(spark, [("closing", 10_000, "z")]).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(db.debounce_stream(live, "key", "ts", "value", "seq", 2, watermark_seconds=20), output=output)
    assert shown(spark.read.parquet(output)) == shown(db.debounce(batch, "key", "ts", "value", "seq", 2))


def test_a_batch_of_a_split_table_is_many_files(spark, monkeypatch):
    from duolex.suite import streams

    made = []
    monkeypatch.setattr(streams, "_stream", lambda spark, path, schema, per_batch=None: made.append((path, per_batch)))
    streams._split_files(spark.range(5000).selectExpr("id", "cast(id AS string) AS text"), spark, "id")
    (path, each), = made
    files = spark.read.parquet(path).inputFiles()
    assert each > 1 and len(files) > each * (streams.SLICES - 1)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(5000))


def test_keys_share_calls_and_stay_themselves(spark, monkeypatch):
    """Two calls' worth of state for many keys, among them a null and such as no double holds."""
    monkeypatch.setattr(db, "KEY_GROUPS", 2)
    first = 2**53
    rows = [(None if i == 7 else first + i, START + dt.timedelta(seconds=i % 3), "x", i) for i in range(40)]
    far = [(-1, START + dt.timedelta(days=1), "z", 99)]
    path, output = scratch_path(spark, "in"), scratch_path(spark, "out")
    batches = [spark.createDataFrame(r, "key long, ts timestamp, value string, seq long") for r in (rows[:20], rows[20:], far)]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    fired = db.debounce_stream(live, "key", "ts", "value", "seq", 2)
    assert fired.schema["key"].dataType == batches[0].schema["key"].dataType
    drain(fired, output=output)
    got = {(r.key, r.fired_at) for r in spark.read.parquet(output).collect()}
    assert got == {(k, at + dt.timedelta(seconds=2)) for k, at, _, _ in rows}


def test_a_call_settles_many_keys():
    class State:
        exists, timer = False, None
        getCurrentWatermarkMs = lambda self: 0

        def update(self, value):
            self.held = value

        def setTimeoutTimestamp(self, at):
            self.timer = at

    import pandas as pd

    state = State()
    batch = pd.DataFrame({"_key": ["a", "b", None], "_at": [1_000_000, 0, 5], "_order": [1.0, float("nan"), 3.0], "v": ["x", None, "y"]})
    assert list(db._timers("v", 1_000_000, "")((0,), iter([batch]), state)) == []
    assert state.timer == 1000 and len(__import__("json").loads(state.held[0])) == 3
