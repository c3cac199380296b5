"""Search, source audit and language-model scores against plain statements of what they must return."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.llm import divergence, language_model, search

SMALL = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows(df):
    return [r.asDict() for r in df.collect()]


def words_of(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


# Search


def brute_search(docs, items, k):
    held = [(key, Counter(words)) for key, text in docs if (words := words_of(TERMS, text))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for item, text in dict.fromkeys(items):
        asked[item].update(words_of(TERMS, text))
    out = []
    for item, terms in asked.items():
        scored = []
        for key, counts in held:
            m = 25 + (75 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for term, times in terms.items():
                if tf := counts.get(term):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, i + 1, key, score) for i, (_, _, key, score) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(df)), key=repr)


ITEMS = [
    (1, "ein kurzer Satz"), (1, "ein kurzer Satz"), (1, "the LAZY dog dog"), (2, None), (3, " !? "), (None, "quick brown naïve"),
    (4, "wort1 wort2 wort2 wort976 x" + "x" * 4999), (5, "nowhere to be found"), (6, "id at all ÄÖ😀"),
]


def test_search_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    docs = [(r["doc_id"], r["text"]) for r in rows(odd)]
    got = search.lexical_search(odd, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == brute_search(docs, ITEMS, 10)
    assert found(search.lexical_search(empty, items)) == found(search.lexical_search(odd, items.limit(0))) == []


@pytest.mark.parametrize("block_docs, step", [(7, 3), (40, 512)])
def test_search_of_a_table(spark, small, monkeypatch, block_docs, step):
    """Many small blocks, so that bounds skip lists and documents, and more than one pass."""
    monkeypatch.setattr(search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(search, "STEP", step)
    monkeypatch.setattr(search, "PASS_ITEMS", 25)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in rows(small)]
    items = [(r["item_id"], r["text"]) for r in rows(bench)]
    got = search.lexical_search(small.repartition(3), bench, k=4)
    assert found(got) == brute_search(docs, items, 4)


def test_ties_keep_the_smallest_ids(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in [*range(40, 0, -1), 7, None]], "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, "other") for i in range(30)], docs.schema))
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = rows(search.lexical_search(docs.repartition(5), items).orderBy("rank"))
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert [r["rank"] for r in got] == list(range(1, 11))


def test_skipping_agrees_with_summing():
    """Random blocks: whatever counts as short, and whatever bound is known, the best stay the best."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, terms = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        codes = [rng.choice(terms, size=rng.integers(0, 20), p=(p := rng.random(terms) ** 3) / p.sum()) for _ in range(n)]
        made = search.index_block(list(range(n)), [len(c) for c in codes], [c.astype(np.int64) for c in codes])
        block = search.Block(type("Row", (), made), max(n, 1), max(1, sum(map(len, codes))), terms)
        asked, weights = np.arange(terms), rng.integers(0, 5000, terms)
        scores = np.zeros(n, np.int64)
        for t in range(terms):
            for d, c in enumerate(codes):
                if tf := int((c == t).sum()):
                    m = 25 + (75 * len(c) * n) // max(1, sum(map(len, codes)))
                    scores[d] += weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        want = sorted(((-s, d) for d, s in enumerate(scores.tolist()) if s > 0))[:5]
        for floor in {0, -want[-1][0] if want else 0}:
            best = search.Best(5, floor)
            block.search(asked, weights, best)
            assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


# Source audit


def brute_audit(docs, least):
    texts = [(lang or "", source or "", words_of(LETTERS, text)) for lang, source, text in docs]
    df, total, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in texts:
        groups[lang].add(source)
        df[lang].update(set(words))
        total[lang].update(words)
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        p = {}
        for name, counts in [*((s, count[lang, s]) for s in sources), (None, total[lang])]:
            n = sum(counts[t] for t in kept)
            p[name] = {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, 10)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values[:most])]
    return sorted(out)


def audited(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r.values()) for r in rows(df))


def plain(df):
    return [(r["lang"], r["source"], r["text"]) for r in rows(df)]


@pytest.mark.parametrize("least", [1, 2, 10])
def test_audit_of_odd_rows(odd, empty, least):
    assert audited(divergence.source_divergence(odd, least)) == brute_audit(plain(odd), least)
    assert audited(divergence.source_divergence(empty, least)) == []


def test_audit_of_a_table(small, monkeypatch):
    """Small blocks and narrow tiles, and tasks that pass counts on early."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 50)
    assert audited(divergence.source_divergence(small, 3)) == brute_audit(plain(small), 3)


def test_products_do_not_depend_on_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    levels = [np.unique(rng.integers(0, 9, 70), return_inverse=True) for _ in range(7)]
    prices = [1 + v * 1_000_000 + 17 * i for i, (v, _) in enumerate(levels)]
    whole = divergence.level_products(levels, prices)
    for a, (_, x) in enumerate(levels):
        for b, (_, y) in enumerate(levels):
            p, q = prices[a][x], prices[b][y]
            assert whole[a, b] == ((p - q) ** 2 // (p + q)).sum()
    monkeypatch.setattr(divergence, "TILE_COLUMNS", 12)
    assert (divergence.level_products(levels, prices) == whole).all()


def test_counts_do_not_depend_on_what_a_task_holds(small, monkeypatch):
    batches = lambda: iter([small.select("lang", "source", F.col("text").cast("binary")).toPandas()])
    sums = lambda: [b.groupby(["lang", "source", "term"]).sum() for b in divergence._counts(batches())]
    import pandas as pd

    whole = pd.concat(sums()).groupby(level=[0, 1, 2]).sum()
    monkeypatch.setattr(divergence, "HELD_COUNTS", 500)
    parts = sums()
    assert len(parts) > 100 and pd.concat(parts).groupby(level=[0, 1, 2]).sum().equals(whole)


# Language model


def brute_base(docs):
    tokens = [(key, re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]) for key, text in docs]
    out_of = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 1
    counts = Counter(t for key, words in tokens if not out_of(key) for t in words)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (
            repr(key), out_of(key), len(words), sum(counts[t] > 0 for t in words), n,
            round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in words), 6),
        )
        for key, words in tokens
    )


def based(got):
    return sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)


def test_scores_of_odd_rows(odd, empty):
    got = rows(language_model.language_scores(odd))
    assert based(got) == brute_base([(r["doc_id"], r["text"]) for r in rows(odd)])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert rows(language_model.language_scores(empty)) == []


def test_no_training_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    docs = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    got = rows(language_model.language_scores(docs))
    assert len(got) == len(held) and all(r["train_tokens"] == 0 == r["n_known"] == r["base_score"] for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_scores_of_a_table(small, monkeypatch):
    """Several blocks; texts that took no part in learning are likelier than by their words alone."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(language_model, "WIDE", 300)
    got = rows(language_model.language_scores(small))
    assert based(got) == brute_base([(r["doc_id"], r["text"]) for r in rows(small)])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert np.mean([r["score"] > r["base_score"] for r in held]) > 0.9


class Row:
    """A block of one document over a vocabulary of `counts`, coded by `codes`."""

    def __init__(self, codes, counts, leaves):
        self.sizes, self.held_out = [len(codes)], [False]
        self.codes, self.wide = np.asarray(codes, np.uint16).tobytes(), b""
        self.at, self.known = np.arange(len(counts)), np.asarray(counts) * 2 + 1
        self.leaves = bytes(max(leaf, 0) for leaf in leaves)
        self.marks = [zlib.crc32(str(i).encode()) & 0x7FFFFFFF for i in range(len(counts))]


def vocabulary():
    rng = np.random.default_rng(8)
    counts = [*rng.integers(2, 40, 300).tolist(), *[1] * 50, 0]
    order = np.cumsum(counts[:300])
    leaves = [*((order - 1) * 240 // order[-1]).tolist(), *[-1] * 51]
    mass = Counter()
    for c, leaf in zip(counts[:300], leaves):
        mass[leaf] += c
    return counts, leaves, language_model.Shares(sum(counts), 350, 50, counts.count(2), mass)


def test_probabilities_sum_to_one():
    counts, leaves, shares = vocabulary()
    rng = np.random.default_rng(9)
    model = language_model.Model(
        shares,
        rng.standard_normal((language_model.CLASS_ROWS, language_model.CLASSES + 1)).astype(np.float32),
        rng.standard_normal((language_model.LEAF_ROWS, language_model.LEAVES)).astype(np.float32),
    )
    # Leaves without a word can't be drawn: they get no prior.
    model.leaf_prior[shares.leaves.reshape(model.leaf_prior.shape) == 0] = -np.inf
    for context in ([], [3], [3, 320], [350, 7, 7], [1, 2, 3, 4]):
        total = sum(
            math.exp(model.log_scores(language_model.Tokens(Row([*context, w], counts, leaves)), shares)[-1]) for w in range(len(counts))
        )
        assert total == pytest.approx(1, abs=1e-3)


def test_gradient_steps_lower_the_loss():
    counts, leaves, shares = vocabulary()
    text = [i * 7 % 351 for i in range(400)] * 30
    tokens = language_model.Tokens(Row(text, counts, leaves))
    model = language_model.Model(shares)
    before = model.log_scores(tokens, shares).mean()
    learner = language_model.Learner(model, np.zeros(language_model.CLASS_ROWS), np.zeros(language_model.LEAF_ROWS))
    for _ in range(5):
        learner.learn(tokens)
    assert model.log_scores(tokens, shares).mean() > before + 1
    # Each word after the first three is learned from once a pass, by every feature.
    assert learner.seen[0].sum() == 5 * 3 * len(text) and learner.seen[1].sum() == 5 * sum(leaves[c] >= 0 for c in text)


def test_batches_do_not_change_scores(monkeypatch):
    counts, leaves, shares = vocabulary()
    tokens = language_model.Tokens(Row([i * 11 % 351 for i in range(500)], counts, leaves))
    model = language_model.Model(shares, np.full((language_model.CLASS_ROWS, language_model.CLASSES + 1), 0.1, np.float32))
    whole = model.log_scores(tokens, shares)
    monkeypatch.setattr(language_model, "BATCH", 7)
    assert np.allclose(model.log_scores(tokens, shares), whole)
