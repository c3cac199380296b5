"""Models, METEOR and examples."""

import pytest

from duolex.operators import examples as ex
from duolex.operators import inference as inf
from duolex.operators import meteor as mt


@pytest.mark.parametrize("on_error, value", [("empty", ""), ("message", "Hata: no")])
def test_failed_batches_keep_their_rows(spark, on_error, value):
    def failing():
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return model

    rows = [(i, "bad" if i == 9 else f"s{i}", "en", "tr") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, source string, source_lang string, target_lang string").coalesce(1)
    got = {r.id: r.prediction for r in inf.translate(df, failing, batch_size=8, on_error=on_error).collect()}
    assert got == {i: value if 8 <= i < 16 else f"TRANSLATE EN TO TR: S{i}" for i in range(20)}


def test_translate_leaves_other_columns_alone(spark):
    wide = 9007199254740993
    rows = [(wide + i if i % 3 else None, None if i == 4 else f"s{i}", "en", None if i == 5 else "tr") for i in range(16)]
    df = spark.createDataFrame(rows, "wide long, source string, source_lang string, target_lang string").coalesce(1)
    got = inf.translate(df, inf.identity_translator, on_error="message").collect()
    assert [(r.wide, r.source, r.source_lang, r.target_lang) for r in got] == rows
    assert [r.prediction for r in got] == [r[1] or "" for r in rows]


def test_encode_chunks(spark):
    df = spark.createDataFrame([(i, "a b " * i) for i in range(30)], "id int, t string")
    got = df.select("id", inf.encode("t", inf.hashing_encoder, chunk=7).alias("v")).collect()
    assert all(sum(r.v) == 2 * r.id and len(r.v) == 64 for r in got)


def test_meteor_values(spark):
    rows = [
        (1, "the cat sat", "the cat sat"),
        (2, "", "the cat"),
        (3, None, "the cat"),
        (4, "a b", "c d"),
        (5, "the the cat", "cat the"),
        (6, "", ""),
    ]
    df = spark.createDataFrame(rows, "row_id int, prediction string, reference string")
    got = {r.row_id: (r.matches, r.chunks, r.meteor) for r in mt.meteor_row(df).collect()}
    assert got[1] == (3, 1, pytest.approx(1 - 0.5 / 27))
    assert got[2] == got[3] == got[4] == got[6] == (0, 0, 0.0)
    # The last "the" and "cat" match, in two chunks.
    p, r = 2 / 3, 1.0
    assert got[5] == (2, 2, pytest.approx(0.5 * p * r / (0.9 * p + 0.1 * r)))
    corpus = mt.meteor_corpus(mt.meteor_row(df)).first()
    assert corpus.n_rows == 6 and corpus.meteor == pytest.approx((got[1][2] + got[5][2]) / 6)


def test_examples(spark):
    dictionary = spark.createDataFrame([("en", "to", 9), ("en", "cat", 5), ("tr", "kedi", 2)], "iso string, term string, count long")
    vocab = ex.vocabulary(dictionary)
    ids = {r.term: r.id for r in vocab.collect()}
    assert ids == {"to": 3, "cat": 4, "kedi": 5}
    rows = [(1, "cat", "kedi kedi", "en", "tr"), (2, "cat " * 20, "", "en", "tr")]
    df = spark.createDataFrame(rows, "id int, source string, target string, source_lang string, target_lang string")
    got = {r.id: r for r in ex.build_examples(df, vocab, ["id"], 8).collect()}
    assert got[1].input_ids == [2, 2, 3, 2, 4, 1, 0, 0] and got[1].attention_mask == [1] * 6 + [0] * 2
    assert got[1].labels == [5, 5, 1] + [-100] * 5
    assert got[2].input_ids == [2, 2, 3, 2, 4, 4, 4, 1] and got[2].labels == [1] + [-100] * 7
