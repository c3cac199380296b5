"""Text expressions against plain Python on awkward strings."""

import re

import pytest
from pyspark.sql import functions as F

from duolex.functions import text as tx
from duolex.functions.distance import osa_batch, osa_distance
from duolex.functions.repair import fix_text

EDGES = [
    "",
    "   ",
    " \u0085 　x ",
    "İSTANBUL Iğdır",
    "áë z",
    "ok...??! well.. no!!!",
    "a<b>c</b> <not closed",
    "www.x y http://a.b/c?d=1 tail https://q",
    "ht<i>tp://joined after tags",
    "yada yanlız",
    "Don't stop",
    "½ cup ٣ 42 x²",
    "smile 😀 end",
    "123",
    "a_b c-d\te\x1ff",
    "ßtraße ΑΣ",
    "line\r\nbreak\n\n two",
    "<only><tags>",
]


# What EDGES become when normalized, in the same order.
NORMALIZED = [
    "",
    "",
    "x",
    "İSTANBUL Iğdır",
    "a\u0301e\u0308 z",
    "ok.?! well. no!",
    "ac <not closed",
    "y tail",
    "after tags",
    "yada yanlız",
    "Don't stop",
    "½ cup ٣ 42 x²",
    "smile 😀 end",
    "123",
    "a_b c-d e f",
    "ßtraße ΑΣ",
    "line break two",
    "",
]
# And as finished sentences.
FINISHED = [
    "",
    "",
    "X.",
    "İSTANBUL Iğdır.",
    "A\u0301e\u0308 z.",
    "Ok...??! well.. no!!!",
    "A<b>c</b> <not closed.",
    "Www.x y http://a.b/c?d=1 tail https://q.",
    "Ht<i>tp://joined after tags.",
    "Yada yanlız.",
    "Don't stop.",
    "½ cup ٣ 42 x².",
    "Smile 😀 end.",
    "123.",
    "A_b c-d\te\x1ff.",
    "SStraße ΑΣ.",
    "Line\r\nbreak\n\n two.",
    "<only><tags>",
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "i int, t string").orderBy("i")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_strip(edges):
    assert values(edges, tx.strip("t")) == [t.strip() for t in EDGES]
    assert values(edges, tx.is_blank("t")) == [not t.strip() for t in EDGES]


def test_normalize(edges, spark):
    assert values(edges, tx.normalize_text("t", repair=False)) == NORMALIZED
    assert values(spark.createDataFrame([(None,)], "t string"), tx.normalize_text("t")) == [""]


def test_word_array(edges):
    expected = [re.sub(r"[^\w\s]", "", t.lower()).split() for t in EDGES]
    assert values(edges, tx.word_array("t")) == expected


def test_keep_array(edges):
    assert values(edges, tx.keep_array("t")) == [[p for p in re.split(r"(\w+)", t) if p] for t in EDGES]


def test_token_kind(spark):
    tokens = ["word", "42", "x2", "a-b", "²", "_", "٣", "½", "."]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert values(df, tx.is_word("t")) == [bool(re.match(r"^\w+$", t)) and not t.isdigit() for t in tokens]


def test_sentence_case(edges):
    assert values(edges, tx.sentence_case("t")) == FINISHED


def test_transfer_casing(spark):
    cases = [("Teh", "the", "The"), ("TEH", "theme", "THEME"), ("teh", "the", "the"), ("tEh", "the", "tHe")]
    df = spark.createDataFrame(cases, "q string, t string, e string")
    assert all(r[0] == r[1] for r in df.select(tx.transfer_casing("q", "t"), "e").collect())


def test_fix_text(spark):
    cases = [
        ("&eacute;t&eacute; &amp; &#39;x&#39;", "été & 'x'"),
        ("<b>&amp;</b>", "<b>&amp;</b>"),
        ("cafÃ© Ã¼ber", "café über"),
        ("donâ€™t", "don't"),
        ("«CAFÉ» déjà", "«CAFÉ» déjà"),
        ("“quoted” ‘it’", "\"quoted\" 'it'"),
        ("ﬁn ﬂow Ｆｕｌｌ　ｗ", "fin flow Full w"),
        ("été", "été"),
        ("a\x00b\x07c\td", "abc\td"),
        ("plain text.", "plain text."),
        ("日本語", "日本語"),
    ]
    df = spark.createDataFrame(cases, "t string, e string")
    for got, expected in df.select(fix_text(F.col("t")), "e").collect():
        assert got == expected


def test_parse_direction(spark):
    df = spark.createDataFrame([("en -> tr",), ("en",), ("a->b->c",), ("->",), (None,)], "t string")
    got = values(df, tx.parse_direction("t"))
    assert [tuple(g) if g else None for g in got] == [("en", "tr"), None, None, ("", ""), None]


def test_counter_and_cap(spark):
    df = spark.createDataFrame([("x" * 250,), (None,), ("İ😀",)], "t string")
    assert values(df, tx.length_counter("t")) == ["250/200", "0/200", "2/200"]
    assert values(df, tx.cap_length("t")) == ["x" * 200, None, "İ😀"]


def osa_plain(a, b):
    table = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cell = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cell = min(cell, table[i - 2][j - 2] + 1)
            table[i][j] = cell
    return table[-1][-1]


def test_osa(spark):
    import itertools

    words = ["".join(p) for n in range(5) for p in itertools.product("abé", repeat=n)]
    pairs = [(a, b) for a in words[::3] for b in words]
    for bound in (1, 2, 3):
        expected = [min(osa_plain(a, b), bound + 1) for a, b in pairs]
        assert osa_batch([a for a, _ in pairs], [b for _, b in pairs], bound).tolist() == expected
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, got in df.select("a", "b", osa_distance("a", "b", 2)).collect():
        true = osa_plain(a, b)
        assert got == (true if true <= 2 else None), (a, b)


def _misread(text, codec="latin-1"):
    return text.encode().decode(codec)


RUNS = [
    # A genuine emoji and one misread word.
    ("😀 caf" + _misread("é") + " 😀", "😀 café 😀"),
    # Misread twice and three times beside text that was not.
    ("naïve " + _misread(_misread("déjà")) + " œuvre 漢字", "naïve déjà œuvre 漢字"),
    ("漢 " + _misread(_misread(_misread("ü"))), "漢 ü"),
    # By windows-1252, an emoji too.
    ("漢 " + _misread("’ € œ 😊", "cp1252"), "漢 ' € œ 😊"),
    ("漢 ÃƒÂ©", "漢 é"),
    # Letters that could be meant count where others can't.
    ("漢 Ä±ÅŸÄ±k Ä±", "漢 ışık ı"),
    ("漢 CAFÉ» DÉJÀ", "漢 CAFÉ» DÉJÀ"),
    # The whole text misread, and text that only looks unusual.
    (_misread("żółw"), "żółw"),
    ("São Paulo – Ärger", "São Paulo – Ärger"),
    # A run longer than is taken at once.
    ("漢 " + _misread("жук" * 400), "漢 " + "жук" * 400),
]


def test_misread_runs_are_repaired(spark):
    from duolex.functions.repair import fix_text

    frame = spark.createDataFrame([(i, given) for i, (given, _) in enumerate(RUNS)], "id int, text string")
    got = {r.id: r.text for r in frame.select("id", fix_text(F.col("text")).alias("text")).collect()}
    assert got == {i: wanted for i, (_, wanted) in enumerate(RUNS)}


def test_composition_keeps_batches_in_utf8():
    import pyarrow as pa

    from duolex.functions.repair import _compose

    texts = [None, "", "e\u0301 \U0001f600", "&eacute;"] * 50
    got = _compose.func(pa.array(texts, pa.string()), pa.array([i % 8 > 3 for i in range(200)]))
    assert isinstance(got, pa.Array)
    assert got.to_pylist() == [None, "", "\u00e9 \U0001f600", "&eacute;", None, "", "\u00e9 \U0001f600", "\u00e9"] * 25


def test_scoring_moves_texts_to_partitions_that_stay(spark):
    from duolex.operators.meteor import meteor_row

    rows = spark.createDataFrame([("a", "x y", "x y"), ("b", None, "z")], "row_id string, prediction string, reference string")
    plan = meteor_row(rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    assert {r.row_id: r.matches for r in meteor_row(rows).collect()} == {"a": 2, "b": 0}
