"""Sources, sinks, positions, budgets and splits."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.operators import datasets as ds
from duolex.operators import filters as fl
from duolex.operators import indexing as ix
from duolex.operators import joins as jn
from duolex.operators import ordering as od
from duolex.plans import corpus, language
from duolex.sources import lines as ln
from duolex.sources import pairs as pr
from duolex.sources import tables as tb


def lines_of(df):
    return [tuple(r) for r in df.orderBy("row_index").collect()]


def test_read_lines_over_files_and_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = [" " * rng.randint(0, 3) + "é" * rng.randint(0, 40) + f" {i}\u0085" for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(texts[:2500]) + "\n", encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("\r\n".join(texts[2500:]), encoding="utf-8", newline="")
    expected = [(i, t.strip()) for i, t in enumerate(texts)]
    assert lines_of(ln.read_lines(spark, str(tmp_path))) == expected
    small = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        df = ln.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert lines_of(df) == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_read_lines_empty_file(spark, tmp_path):
    (tmp_path / "e.txt").write_text("")
    assert ln.read_lines(spark, str(tmp_path / "e.txt")).count() == 0


def test_zip_rows_mismatch(spark):
    left = spark.range(5).select(F.col("id").alias("row_index"), F.lit("a").alias("source"))
    right = spark.range(3).select(F.col("id").alias("row_index"), F.lit("b").alias("target"))
    assert jn.zip_rows(left, right).count() == 3
    with pytest.raises(jn.AlignmentError):
        jn.zip_rows(left, right, on_mismatch="error")


def test_missing_pair_is_empty(spark, tmp_path):
    df = pr.read_parquet_pair(spark, str(tmp_path / "no-en.parquet"), str(tmp_path / "no-tr.parquet"))
    assert df.columns == ["row_index", "source", "target"] and df.count() == 0


def test_json_array(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"name": "Turkish", "code": "Turkish", "iso_code": "tr"}, {"name": "X"}]')
    bad.write_text('[{"name": "Turk')
    schema = tb.LANGUAGE_SCHEMA
    assert [r.iso_code for r in tb.read_json_array(spark, str(good), schema).collect()] == ["tr", None]
    assert tb.read_json_array(spark, str(bad), schema).count() == 0
    assert tb.read_json_array(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_history_needs_all_keys(spark, tmp_path):
    path = tmp_path / "history.json"
    path.write_text(
        '[{"source_text": "a", "target_text": "b", "timestamp": "2024-01-01 00:00:00", "direction": "en->tr"},'
        ' {"source_text": "c", "target_text": "d", "timestamp": "2024-01-02 00:00:00"}]'
    )
    assert [r.source_text for r in language.read_history(spark, str(path)).collect()] == ["a"]


def test_null_groups_are_kept(spark):
    rows = [(i, None if i % 3 == 0 else "g") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {r.id: r.row_index for r in ix.position_by_id(df, "id", ["g"]).collect()}
    for group in (None, "g"):
        assert [got[i] for i, g in rows if g == group] == list(range(sum(g == group for _, g in rows)))
    split = od.stratified_split(df, ["id"], by="g").groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in split} == {
        (None, "test"): 20, (None, "train"): 80, ("g", "test"): 40, ("g", "train"): 160
    }


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_by_id(spark, parts):
    # One group holds most of the rows; ids are sparse, some negative, over many buckets.
    rng = random.Random(2)
    ids = rng.sample(range(-(2**40), 2**40), 3000) + list(range(2**41, 2**41 + 3000))
    rows = [(i, "hot" if rng.random() < 0.8 else f"g{rng.randint(0, 3)}") for i in ids]
    df = spark.createDataFrame(rows, "id long, g string").repartition(parts)
    got = {r.id: r.row_index for r in ix.position_by_id(df, "id", ["g"]).collect()}
    for group in {g for _, g in rows}:
        assert [got[i] for i in sorted(i for i, g in rows if g == group)] == list(range(sum(g == group for _, g in rows)))
    whole = {r.id: r.row_index for r in ix.position_by_id(df, "id").collect()}
    assert [whole[i] for i in sorted(ids)] == list(range(len(ids)))


def test_ranges_of_far_ids_are_of_like_size(spark):
    # A million random 64-bit ids.
    df = spark.range(1_000_000).select(F.xxhash64("id").alias("far"))
    got = ix.position_by_range(df, "far").toPandas().sort_values("far")
    assert (got["row_index"].to_numpy() == range(1_000_000)).all()
    bounds = ix.range_bounds(df, "far")
    sizes = np.bincount(np.searchsorted(bounds, got["far"].to_numpy(dtype=float), side="right"))
    assert len(sizes) == 1_000_000 // ix.RANGE_ROWS and sizes.max() < 2 * sizes.mean()


def test_ranges_of_clustered_ids(spark):
    # Neighbours beyond 2^53, where doubles no longer tell them apart, far outliers, a null and groups.
    ids = [*range(2**62, 2**62 + 5000), *range(-3000, 0), -(2**63), 2**63 - 1, None]
    rows = [(i, None if n % 3 == 0 else "g") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    got = {r.id: r.row_index for r in ix.position_by_range(df, "id", ["g"]).collect()}
    for group in (None, "g"):
        mine = sorted((i for i, g in rows if g == group), key=lambda i: (i is not None, i or 0))
        assert [got[i] for i in mine] == list(range(len(mine)))
    assert ix.position_by_range(df.limit(0), "id").count() == 0
    assert ix.position_by_range(df.limit(3), "id").count() == 3


def test_rows_above_a_count(spark):
    rng = random.Random(4)
    counts = [rng.choice([1, 2, 3, rng.randint(1, 5000), rng.randint(1, 2**50)]) for _ in range(3000)]
    df = spark.createDataFrame([(c,) for c in counts], "count long")
    got = {r["count"]: r["rows"] for r in ix.rows_above(df, "count").collect()}
    ordered = np.sort(counts)
    assert got == {c: int((ordered > c).sum()) for c in set(counts)}


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(5000)
    first = [r.id for r in od.shuffle(df.repartition(3), ["id"], 7, 5).collect()]
    again = [r.id for r in od.shuffle(df.repartition(11), ["id"], 7, 2).collect()]
    assert first == again and sorted(first) == list(range(5000)) and first != sorted(first)
    assert first != [r.id for r in od.shuffle(df, ["id"], 8, 5).collect()]
    positions = {r.id: r.position for r in od.shuffle_positions(df, ["id"], 7).collect()}
    assert [positions[i] for i in first] == list(range(5000))


def test_split_sizes(spark):
    rows = [(i, "hot" if i % 10 else f"s{i % 7}") for i in range(3001)] + [(9999, "single")]
    df = spark.createDataFrame(rows, "id long, source_lang string")
    got = od.stratified_split(df, ["id"]).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows)
    import math

    for stratum in {s for _, s in rows}:
        n = sum(s == stratum for _, s in rows)
        test = {r.id for r in got if r.source_lang == stratum and r.split == "test"}
        assert len(test) == math.ceil(n * 0.2)
    again = od.stratified_split(df.repartition(13), ["id"]).collect()
    assert {(r.id, r.split) for r in again} == {(r.id, r.split) for r in got}


def test_mirror_twice_doubles(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, source string, target string")
    once = fl.mirror(fl.tag_languages(df, "en", "tr"))
    sides = [tuple(r) for r in once.orderBy("id", "direction").drop("direction").collect()]
    assert sides == [(1, "a", "b", "en", "tr"), (1, "b", "a", "tr", "en"), (2, "c", "d", "en", "tr"), (2, "d", "c", "tr", "en")]
    twice = fl.mirror(once.drop("direction")).drop("direction")
    assert sorted(map(tuple, twice.collect())) == sorted(sides * 2)


def test_leak_free_split_keeps_directions_together(spark):
    df = spark.range(200).select(
        F.lit("d").alias("dataset"), F.col("id").alias("row_index"),
        F.concat(F.lit("s "), "id").alias("source"), F.concat(F.lit("t "), "id").alias("target"),
    )
    pairs = fl.tag_languages(df, "en", "tr")
    together = corpus.prepare_pairs(pairs).groupBy("row_index").agg(F.countDistinct("split").alias("n"), F.count("*").alias("m"))
    assert [(r.n, r.m) for r in together.distinct().select("n", "m").distinct().collect()] == [(1, 2)]
    apart = corpus.prepare_pairs(pairs, leak_free=False)
    sizes = {(r.source_lang, r.split): r["count"] for r in apart.groupBy("source_lang", "split").count().collect()}
    assert sizes == {("en", "test"): 40, ("en", "train"): 160, ("tr", "test"): 40, ("tr", "train"): 160}
    mixed = apart.groupBy("row_index").agg(F.countDistinct("split").alias("n")).filter("n = 2").count()
    assert mixed > 0


def test_written_splits_keep_the_shuffle(spark, tmp_path):
    rows = [("d", i, f"w{i}", f"v{i}", "en", "de") for i in range(400)]
    pairs = spark.createDataFrame(rows, "dataset string, row_index long, source string, target string, source_lang string, target_lang string")
    path = str(tmp_path / "splits")
    tb.write_splits(corpus.prepare_pairs(pairs, partitions=2), path)
    for split, n in (("train", 640), ("test", 160)):
        for name in sorted(os.listdir(f"{path}/split={split}")):
            if name.endswith(".parquet"):
                places = [r.position for r in spark.read.parquet(f"{path}/split={split}/{name}").coalesce(1).collect()]
                assert places == sorted(places)
        assert tb.read_splits(spark, path).filter(f"split = '{split}'").count() == n
    places = [r.position for r in tb.read_splits(spark, path).select("position").collect()]
    assert sorted(places) == list(range(800))


def test_no_budget_reads_everything(spark, tmp_path):
    for lang in ("en", "de"):
        spark.createDataFrame([(f"{lang}{i}",) for i in range(50)], f"{lang} string").write.parquet(pr.side_path(f"{tmp_path}/a", "a", lang))
    assert corpus.load_datasets(spark, str(tmp_path), ["a"], "en", "de").count() == 50
    assert corpus.load_datasets(spark, str(tmp_path), ["a"], "en", "de", max_rows=20).count() == 20


def test_quotas():
    assert ds.quotas([5, 5, 5], 7) == [5, 2, 0]
    assert ds.quotas([5, 5, 5], 3, first_complete=True) == [5, 0, 0]
    assert ds.quotas([2, 0, 9], 6) == [2, 0, 4]


def test_row_budget_agrees_with_quotas(spark):
    rows = [(d, i) for d, n in (("a", 40), ("b", 3), ("c", 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, row_index long")
    for budget in (0, 10, 45, 500):
        for first in (False, True):
            kept = ds.row_budget(df, ["c", "none", "a", "b"], budget, 2, first)
            got = {r.dataset: r["count"] for r in kept.groupBy("dataset").count().collect()}
            expected = dict(zip("cnab", ds.quotas([23, 0, 38, 1], budget, first)))
            assert got == {k: v for k, v in expected.items() if v}


def test_pair_round_trip_slices_by_position(spark, tmp_path):
    df = spark.range(0, 1000, 3).select(
        F.col("id").alias("row_index"), F.concat(F.lit("s"), "id").alias("source"), F.concat(F.lit("t"), "id").alias("target")
    )
    paths = pr.write_pair(df, str(tmp_path), "set", "en", "tr")
    got = pr.read_parquet_pair(spark, *paths, start=10, num=3).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(i, f"s{3 * i}", f"t{3 * i}") for i in (10, 11, 12)]


def test_dictionary_files_are_in_order(spark, tmp_path):
    rows = [("en", f"t{i}", 1 + i % 7) for i in range(500)] + [("tr", "x", 2)]
    tb.write_dictionary(spark.createDataFrame(rows, "iso string, term string, count long"), str(tmp_path / "d"))
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if p.is_dir()) == ["iso=en", "iso=tr"]
    files = sorted(str(p) for p in (tmp_path / "d" / "iso=en").glob("*.parquet"))
    got = [tuple(r) for f in files for r in spark.read.parquet(f).collect()]
    assert got == sorted(((t, c) for i, t, c in rows if i == "en"), key=lambda r: (-r[1], r[0]))


def test_plain_clean_corpus(spark, tmp_path):
    for lang in ("en", "tr"):
        (tmp_path / f"set-{lang}.txt").write_text("".join(f" {lang} {i} \n" for i in range(50)))
    report = corpus.clean_corpus(spark, str(tmp_path), str(tmp_path / "out"), "set", "en", "tr").first()
    assert (report.rows_in, report.rows_kept) == (50, 50)
    got = pr.read_parquet_pair(spark, *[pr.side_path(str(tmp_path / "out"), "set", x) for x in ("en", "tr")])
    assert [tuple(r) for r in got.orderBy("row_index").collect()] == [(i, f"en {i}", f"tr {i}") for i in range(50)]


@pytest.mark.parametrize("heavy", [10, 10**6])
def test_lookup_join_hot_and_cold(spark, heavy):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string")
    table = spark.createDataFrame([("hot", 1, 1000)] + [(f"k{i}", i, 1) for i in range(0, 50, 2)], "key string, v int, w int")
    got = {r.id: r.v for r in jn.lookup_join(df, table, ["key"], [F.desc("w")], hot_rows=1, heavy_rows=heavy).collect()}
    known = {"hot": 1, **{f"k{i}": i for i in range(0, 50, 2)}}
    assert got == {i: known.get(k) for i, k in rows}


def shuffled_records(spark, run):
    """Rows that all stages of a run wrote to shuffles."""
    sc = spark.sparkContext

    def written() -> int:
        none = sc._gateway.new_array(sc._gateway.jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


@pytest.mark.parametrize("hot_rows, heavy", [(1, 10**6), (0, 1000)])
def test_settled_rows_are_not_shuffled(spark, tmp_path, hot_rows, heavy):
    """One key has nearly all rows: as the heaviest entry, or only found to be heavy; a second one has no entry."""
    rows = spark.range(60_000).withColumn("key", F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "none").otherwise(F.concat(F.lit("k"), F.col("id") % 7)))
    rows = rows if hot_rows == 0 else rows.filter("key <> 'none'")
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    table = spark.createDataFrame([("hot", 1, 1000)] + [(f"k{i}", i, 1) for i in range(5)], "key string, v int, w int")
    joined = lambda: jn.lookup_join(df, table, ["key"], [F.desc("w")], hot_rows=hot_rows, heavy_rows=heavy)
    assert joined().filter("v = 1 AND key = 'hot'").count() == df.filter("key = 'hot'").count()
    written = shuffled_records(spark, lambda: joined().write.format("noop").mode("overwrite").save())
    assert written < 8_000


def exchanged(df, column):
    """How often the plan moves a column between tasks."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    moved = [part for part in plan.split("\n\n") if "Exchange\n" in part and "Broadcast" not in part.split("\n")[0]]
    return sum(f"{column}#" in next(line for line in part.split("\n") if line.startswith("Input")) for part in moved)


def test_numbering_moves_a_row_once(spark):
    df = spark.range(3000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), (F.col("id") % 3).alias("g"), F.lit("x").alias("payload"))
    df = df.withColumn("payload", F.concat("payload", "g"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        placed = ix.position_by_id(df, "id", ["g"])
        assert exchanged(placed, "payload") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r.g, r.row_index) for r in placed.collect()) == [(g, i) for g in range(3) for i in range(1000)]
    assert {r.row_index for r in placed.filter("id is null").collect()} == {0}


def test_prepared_pairs_move_once_after_the_split(spark):
    rows = [("d", i, f"w{i}", f"v{i}", "en", "de") for i in range(400)] * 2
    pairs = spark.createDataFrame(rows, "dataset string, row_index long, source string, target string, source_lang string, target_lang string")
    prepared = corpus.prepare_pairs(pairs, partitions=5)
    assert exchanged(prepared, "source") == 1
    got = [(r.dataset, r.row_index, r.direction, r.position) for r in prepared.collect()]
    assert [g[3] for g in got] == list(range(1600))
    keys = ["dataset", "row_index", "direction"]
    expected = od.shuffle_positions(prepared.drop("position"), keys).collect()
    assert sorted(got) == sorted((r.dataset, r.row_index, r.direction, r.position) for r in expected)


def test_pairs_are_normalized_once(spark):
    pairs = spark.range(10).select(F.concat(F.lit("a<b>  "), "id").alias("source"), F.lit("caf\u0301e").alias("target"))
    plan = fl.normalize_pairs(pairs)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, plan.collect())) == [(f"a {i}", "caf\u0301e") for i in range(10)]


def test_pairs_across_blocks_and_odd_ids(spark, tmp_path, monkeypatch):
    """Every row meets the next one, over gaps in the ids, blocks too large and rows without an id; texts move once."""
    from duolex.suite import base

    monkeypatch.setattr(base, "BLOCK_ROWS", 300)
    ids = [*range(0, 700), *range(5000, 5003), 10**9, -4, *[2000] * 400, *[None] * 3]
    rows = [(i, "en" if (i or 0) % 2 else "de", f"t{i}") for i in ids]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    made = base.pairs_once(spark, str(tmp_path))
    got = sorted((r.row_index, r.source, r.target, r.source_lang, r.target_lang, r.dataset) for r in made.collect())
    placed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    following = [*placed[1:], placed[0]]
    assert got == [(i, a[2], z[2], a[1], z[1], a[1]) for i, (a, z) in enumerate(zip(placed, following))]


def test_stored_blocks_meet_without_a_shuffle(spark, tmp_path):
    from duolex.suite import base

    rows = [(i, "en", f"t{i}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = base.pairs_once(spark, str(tmp_path))
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # What is dealt anew are the few rows at the ends of blocks, which have a file of their own.
    dealt = plan.split("Exchange")[1:]
    assert all("ends-" in part.split("FileScan")[1].split("ReadSchema")[0] for part in dealt)
    assert made.count() == 3000


def test_position_in_place(spark):
    """Stored rows are numbered where they lie: before, every text was shuffled to be numbered."""
    import random

    ids = random.Random(3).sample(range(-3000, 3000), 900) + [1 << 40, (1 << 40) + 63, -(1 << 62), 63, 3063, 3127]
    ids = sorted(set(ids))
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string").repartition(3)
    placed = ix.position_in_place(df, "id")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert {r.id: r.row_index for r in placed.collect()} == {i: n for n, i in enumerate(ids)}
    assert placed.schema == ix.position_by_id(df, "id").schema
    for other in (ix.position_in_place(df, "id", words=5), ix.position_in_place(df.union(df.limit(1)), "id")):
        assert sorted(r.row_index for r in other.collect()) == list(range(other.count()))
    odd = ix.position_in_place(df.union(spark.createDataFrame([(None, "a"), (None, "b")], df.schema)), "id").collect()
    assert {r.row_index for r in odd if r.id is None} == {0, 1} and len(odd) == len(ids) + 2
    assert ix.position_in_place(df.filter("id > 1e18"), "id").count() == 0


def test_splits_in_order_are_not_sorted_again(spark, tmp_path):
    """Rows that come in order of their position are written so, without another sort of whole rows."""
    rows = [(i, i % 3, "text " * (i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, lang int, text string").repartition(4)
    marked = od.shuffle(od.hash_split(df, ["id"]), ["id"], partitions=3, name="position")
    before = spark.conf.get(tb.OPEN_FILES_KEY, "0")
    tb.write_splits(marked, str(tmp_path / "one"), in_order=True)
    assert spark.conf.get(tb.OPEN_FILES_KEY, "0") == before
    tb.write_splits(marked, str(tmp_path / "two"))
    read = lambda name: tb.read_splits(spark, str(tmp_path / name))
    assert sorted(read("one").collect()) == sorted(read("two").collect()) and read("one").count() == 500
    files = read("one").withColumn("file", F.input_file_name()).collect()
    for file in {r.file for r in files}:
        own = [r for r in files if r.file == file]
        assert [r.position for r in own] == sorted(r.position for r in own) and len({r.split for r in own}) == 1
