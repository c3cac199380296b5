"""The pipeline's stages against plain statements of what each must keep."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duolex.llm import languages, packing, toxicity

SMALL = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """A copy of the small tables with planted documents."""
    path = str(tmp_path_factory.mktemp("planted"))
    first = small.orderBy("doc_id").filter("n_chars > 300").first()
    rude = [(9000 + i, f"Then the {w} went home and nobody spoke of it again.", "en", "p", 0) for i, w in enumerate(["idiot", "moron", "scum"])]
    copy = [(9100, first["text"] + " end", "en", "p", 0), (9101, "!!! 123 ???", "en", "p", 0), (9102, None, "en", "p", 0)]
    small.unionByName(spark.createDataFrame(rude + copy, small.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.1/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, small):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    said = {r["doc_id"]: r for r in languages.identify(docs).collect()}
    kept = corpus_pipeline.keep_languages(spark, docs, folder)
    assert ids(kept) == sorted(i for i, r in said.items() if r["lang_pred"] != "und" and r["score"] >= 0.25 + corpus_pipeline.LEAST_LANGUAGE * 0.75)
    assert not {9101, 9102} & set(ids(kept)) and len(ids(kept)) > 0.97 * small.count()
    near = corpus_pipeline.drop_near_duplicates(spark, kept, folder)
    assert 9100 not in ids(near)
    cut = corpus_pipeline.cut_repeats(spark, near, folder)
    assert ids(cut) == ids(near) and cut.columns == near.columns == docs.columns
    lengths = cut.selectExpr("doc_id", "n_chars = length(text) AS same").collect()
    assert all(r["same"] for r in lengths)


def test_short_passages_of_over_50_words_go(spark):
    """51 words of about two letters are cut from otherwise different documents, 50 words stay."""
    random.seed(6)

    def words(n, letters):
        return " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters)) for _ in range(n))

    passage, short, glued = words(51, 2), words(50, 2), words(51, 1)
    shared = {1: passage, 2: passage, 3: short, 4: short, 5: "(" + glued, 6: "'" + glued}
    around = {i: (words(80, 6), words(70, 6)) for i in shared}
    docs = [(i, f"{around[i][0]} {shared[i]} {around[i][1]}", "en", "p", 0) for i in shared] + [(7, None, "en", "p", 0), (8, "", "en", "p", 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    want = {i: f"{a} {'' if i < 3 else shared[i] if i < 5 else shared[i][0]} {b}" for i, (a, b) in around.items()}
    assert got == want | {7: None, 8: ""}


def test_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    said = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert ids(kept) == ids(said.filter("predicted = 0"))


def test_large_tables_are_packed_by_what_every_window_asks(spark, monkeypatch):
    """No table is so large that only some texts ask all documents."""
    monkeypatch.setattr(packing, "pack_stretches", None)
    text = F.concat(*[F.concat(F.lit("word"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(500)), F.lit(" ")) for i in range(6)])
    docs = spark.range(16_500).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = corpus_pipeline.pack_documents(spark, docs, "").select("doc_id", "length", "doc_tokens", "sequence_id").toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all() and got.doc_id.nunique() == 16_500
    sizes = got.groupby("sequence_id").length.sum()
    assert ((sizes == packing.WINDOW) | (sizes & (sizes - 1) == 0)).all() and (sizes != packing.WINDOW).sum() <= 11


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    sizes = pieces.groupBy("sequence_id").sum("length").collect()
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for _, n in sizes)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, folder, odd, empty, stage):
    out = stage(spark, odd, folder)
    assert out.count() > 0
    if stage is not corpus_pipeline.pack_documents:
        assert out.columns == odd.columns
    assert stage(spark, empty, folder).count() == 0
