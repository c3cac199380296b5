"""Every operator against a plain statement of what it must return, on odd and on given rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import compare
from duolex import llm
from duolex.llm import bpe, hnsw, imatch, languages, minhash, packing, repeats, sharding, toxicity, urls
from duolex.llm.components import components
from duolex.session import materialize

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# Components


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(50)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "none": [],
    }[kind]
    found = components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r["node"]: r["root"] for r in rows(found)} == brute_components(links)


# Embeddings


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    near = centres[rng.integers(0, 30, 400)] + rng.standard_normal((400, 24)) * 0.18
    found = [*near.tolist(), *rng.standard_normal((200, 24)).tolist(), near[0].tolist(), near[0].tolist()]
    wrong = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0] * 3]
    df = spark.createDataFrame(list(enumerate(found + wrong)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in rows(hnsw.near_vectors(df.withColumn("rep", df["vec_id"]), 0.9))}
    x = np.asarray(found, dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    roots = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    assert len(got) == len(found) + len(wrong)
    for i in range(len(found)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum() - 1, roots[i])
    for i in range(len(found), len(found) + len(wrong)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph(x).close()
    query, node, recall = graph.within(x[:200], 0.6)
    truth = x[:200] @ x.T >= 0.6
    assert recall == 1.0 and len(set(zip(query, node))) >= 0.99 * truth.sum()


def test_no_vectors(spark):
    assert rows(hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []


# URLs


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    given = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://example.org/en/17?x=1", "https://example.org/en/2",
        "http://org/x", "http://notexample.org/es/", "http://a.com/fr/1#t", "http://b.com/de/9?", "http://c.net/en/1", "x://y.com", "a://b.com/fr",
        "http://ÄB.com/de/", "q://h.org?p=/es/", "http://l.net/" + "9" * 50_000, "http://example.org/es/x://y",
    ]
    df = spark.createDataFrame(list(enumerate(given + given)), "page_id long, url string")
    got = rows(urls.judge_urls(df.withColumn("host", df["url"]).withColumn("score", df["page_id"])))
    assert len(got) == len(given) * 2
    for r in got:
        host, path, rule = plain_verdict(given[r["page_id"] % len(given)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (urls.RULES[rule] if rule else "block" if r["score"] >= 0.5 else "allow")


def test_trees_learn_the_rules(spark):
    found = rows(urls.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).filter("rule IS NOT NULL"))
    blocked = np.asarray([r["verdict"] == "block" for r in found])
    right = np.asarray([r["score"] >= 0.5 for r in found]) == blocked
    # Lexical features don't say which language a path names, so the rules can't be learned whole.
    assert right.mean() > max(blocked.mean(), 1 - blocked.mean()) + 0.02


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in rows(urls.judge_urls(df))} == {"allow"}
    assert rows(urls.judge_urls(df.limit(0))) == []


# Toxicity and language


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    found = llm.QUERIES["op3_toxicity"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]).all()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert held[held.toxic == 1].predicted.mean() > 0.75 and held[held.toxic == 0].predicted.mean() < 0.04


def test_misspelled_words_share_grams():
    clean = [["the", "dog", f"walks{i}", "home"] for i in range(60)]
    rude = [["the", "dog", word, f"walks{i}"] for i in range(15) for word in ("zorgblat", "zorgblatt", "zorgblats", "xzorgblat")]
    model = toxicity.train(rude + clean, np.asarray([1] * len(rude) + [0] * len(clean)))
    logits = model.logits(*toxicity.word_grams(["zorgblatty", "zorgblaty!", "garden", "walks99"]))
    assert logits[:2].min() > 0 > logits[2:].max()


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (6, 1, 0), (None, 1, 1), (7, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.toxicity(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["score"] == 0 for r in rows(toxicity.toxicity(odd, labels.limit(0))))
    assert rows(toxicity.toxicity(empty, labels)) == []


def test_languages(spark):
    found = llm.QUERIES["op10_language"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = found[found["held_out"]].merge(known, on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.96


def test_languages_of_odd_rows(odd, empty):
    got = rows(languages.identify(odd))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 5)} == {"und"}
    assert {r["lang_pred"] for r in rows(languages.identify(odd.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
    assert rows(languages.identify(empty)) == []


def test_every_language_is_learned(spark):
    """More languages than any fixed number, most with one document beside a frequent one."""
    rows = [(i, chr(0x4E00 + i % 90) * 30, f"l{i % 90}") for i in range(400)] + [(1000 + i, "abc " * 9, "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in docs.filter(~languages.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    pieces, labels, names = languages.sample_pieces(docs, "doc_id")
    assert set(names) == learned and len(learned) > 85
    assert set(labels) == set(range(len(names))) and len(pieces) == len(labels)


def test_gradients_of_the_network():
    net = languages.Network(3, hidden=4)
    x = np.random.default_rng(1).integers(0, 257, (6, 5)).astype(np.int16)
    y = np.asarray([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(x)[:, np.arange(5), y]
        return -np.log(p)[x < 256].mean()

    net.__dict__.update({k: v.astype(np.float64) for k, v in net.__dict__.items() if isinstance(v, np.ndarray)})
    for side in (net.ahead, net.back):
        side.table, side.inner = side.table.astype(np.float64), side.inner.astype(np.float64)
    for w, g in zip(net.weights(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = w[at]
        w[at] = before + 1e-3
        up = loss()
        w[at] = before - 1e-3
        down = loss()
        w[at] = before
        assert abs((up - down) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-4


# MinHash


def exact_sets(pairs, n):
    upper = {c: c + 32 for c in range(65, 91)}
    out = []
    for _, text in pairs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(upper))
        span = min(n, len(words))
        out.append(frozenset(zip(*(words[i:] for i in range(span)))))
    return out


def near_by_brute_force(pairs, n, percent):
    sets, ids = exact_sets(pairs, n), [i for i, _ in pairs]
    links = [
        (a, b) for a in range(len(pairs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    roots = brute_components([(a, b) for a, b in links] + [(a, a) for a in range(len(pairs))])
    least = {}
    for a, root in roots.items():
        if ids[a] is not None:
            least[root] = min(ids[a], least.get(root, ids[a]))
    return Counter((ids[a], len(sets[a]), least.get(roots[a])) for a in range(len(pairs)))


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    copies = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(300)] = f"edit{i}"
        copies.append((100 + i, " ".join(words).upper() if i % 3 else " ".join(words)))
    more = spark.createDataFrame(copies, "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more).selectExpr("*", "doc_id AS bands", "doc_id AS digest")
    got = rows(minhash.near_duplicates(df, 4, 80))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_by_brute_force(texts(df), 4, 80)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert rows(minhash.near_duplicates(empty)) == []


def test_near_duplicates_of_a_table(small):
    got = rows(minhash.near_duplicates(small, 4, 80))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_by_brute_force(texts(small), 4, 80)


def test_sketches_estimate_similarity():
    x = np.arange(1000, dtype=np.uint64)
    a, b = minhash.sketch(minhash.mix(x)), minhash.sketch(minhash.mix(x[200:]))
    assert abs((a == b).mean() - 0.8) < 0.1
    for n in (1, 2, 7, 180, 5000):
        assert (minhash.sketch(minhash.mix(x[:n] if n <= 1000 else np.arange(n, dtype=np.uint64))) != np.uint64(2**64 - 1)).all()


def test_long_texts_hash_in_parts(monkeypatch):
    text = " ".join(f"Wort{i}" for i in range(4000)) + " " + "y" * 9000 + " ende"
    whole = minhash.shingles(text, 4)
    monkeypatch.setattr(minhash, "BLOCK", 1000)
    assert (minhash.shingles(text, 4) == whole).all()


def test_unlike_members_of_a_hot_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    marks = np.random.default_rng(1).integers(0, 256, (20, minhash.FINE)).astype(np.uint8)
    marks[7], marks[13] = marks[2], marks[2]
    # All meet in the bucket 5 and again in 6; a pair leaves once.
    members = [(key, i, i, [5, 6, 100 + i], marks[i].tobytes(), 20) for i in range(20) for key in (5, 6)]
    df = spark.createDataFrame(members, "key long, class long, root long, bands array<long>, marks binary, size long")
    found = sorted((r["a"], r["b"]) for r in rows(minhash.unlike_parts(df, 80)))
    assert found == [(2, 7), (2, 13), (7, 13)]


# Repeated windows


def cut_by_brute_force(pairs, n):
    data = [t.encode("utf-8", "surrogatepass") for _, t in pairs]
    count = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(pairs, data):
        gone = np.zeros(len(b), dtype=bool)
        for at in range(len(b) - n + 1):
            if count[b[at : at + n]] > 1:
                gone[at : at + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((i, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), tuple(spans)))
    return Counter(out)


def cut_rows(df, n):
    return Counter(
        (r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest(), tuple((s["begin"], s["end"]) for s in r["removed"]))
        for r in repeats.without_repeats(df, n).collect()
    )


@pytest.mark.parametrize("n", [400, 60])
def test_repeats_of_odd_rows(odd, empty, n):
    df = odd.filter("doc_id IS NULL OR doc_id <> 9")
    assert cut_rows(df, n) == cut_by_brute_force(texts(df), n)
    assert set(repeats.without_repeats(df, n).columns) >= {"spans", "digest", "_digest", "kept", "removed"}
    assert cut_rows(empty, n) == Counter()


@pytest.mark.parametrize("seed", range(3))
def test_repeats_that_share_parts(spark, seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdé") for _ in range(260))
    found = []
    for i in range(40):
        a, b = sorted(rng.sample(range(260), 2))
        noise = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120))) for _ in range(2)]
        found.append((i, noise[0] + passage[a:b] * rng.choice([1, 1, 2]) + noise[1]))
    df = spark.createDataFrame(found, "doc_id long, text string")
    assert cut_rows(df, 60) == cut_by_brute_force(found, 60)


def test_repeats_of_a_table(small):
    assert cut_rows(small, 400) == cut_by_brute_force(texts(small), 400)


def test_long_texts_cut_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    found = [(0, "x" + passage + "y" * 100), (1, passage[500:2500]), (2, "ab" * 200)]
    df = spark.createDataFrame(found, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(repeats, "BLOCK", 700)
    data = np.frombuffer(found[0][1].encode(), dtype=np.uint8)
    whole = [tuple(int(x) for x in r) for r in zip(*repeats.blocks(data, np.asarray([0, len(data)]), 60)[1:4])]
    assert sum(last - first + 1 for first, last, _ in whole) == len(data) - 59
    assert cut_rows(df, 60) == cut_by_brute_force(found, 60)


# Sharding


def test_shards(odd, empty):
    got = sorted(rows(sharding.byte_shards(odd, 4)), key=lambda r: (r["shard"], r["slot"]))
    sizes = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts(odd))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    start, total = 0, sum(r["size"] for r in got)
    slots = Counter()
    for r in got:
        assert r["shard"] == (2 * start + r["size"]) * 4 // (2 * total) and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        start += r["size"]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert rows(sharding.byte_shards(empty)) == []


# Fingerprints


def test_fingerprints(odd, empty):
    df = odd.filter("doc_id IS NOT NULL").select("doc_id", "text", "digest", "n_chars")
    got = {r["doc_id"]: r for r in rows(imatch.compared(df))}
    order = sorted({i: t for i, t in texts(df)}.items(), reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        assert got[i]["n_chars"] == len(text) and got[i]["edited"] == text[: len(text) - third] + after[:third]
    assert got[6]["fingerprint"] == got[7]["fingerprint"] != got[9]["fingerprint"]
    assert len(rows(imatch.compared(df))) == df.count()
    assert rows(imatch.compared(empty)) == []
    assert len(rows(imatch.compared(odd))) == odd.count()


def test_fingerprints_of_a_table(spark):
    found = llm.QUERIES["op7_imatch"](spark, SMALL).toPandas()
    assert ((found[["near_edited", "near_next"]] >= 0) & (found[["near_edited", "near_next"]] <= 1)).all().all()
    assert found.near_edited.mean() > 0.3 > 0.1 > found.near_next.mean()


# BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.VOCABULARY)


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_encoding_of_odd_rows(odd, empty):
    theirs = library(bpe.VOCABULARY)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in bpe.decode_ids(bpe.encode_texts(odd)).collect())
    want = [(i, theirs.encode(t, add_special_tokens=False).ids) for i, t in texts(odd)]
    assert got == Counter((i, tuple(x), theirs.decode(x, skip_special_tokens=False)) for i, x in want)
    assert rows(bpe.encode_texts(empty)) == []


def test_broken_bytes_decode_alike(coder):
    theirs, rng = library(bpe.VOCABULARY), random.Random(3)
    decoder = bpe.Decoder(coder.tokens)
    for _ in range(300):
        ids = [rng.randrange(50257) if rng.random() < 0.3 else rng.randrange(188, 256) for _ in range(12)]
        assert decoder(np.asarray(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_windows_give_what_the_whole_gives(coder, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(coder.merges, "step", 128)
    for parts in (["a", "e", "in", "the", "er"], ["x"], ["ab", "ba", "a", "ß"], ["=", "==", "-"]):
        data = "".join(rng.choice(parts) for _ in range(3000)).encode()
        assert sum(coder.merges.stream(data), []) == coder.merges.merge(data)


def test_lookahead_suffices_for_random_merges():
    rng = random.Random(8)
    for _ in range(150):
        tokens, merges = {i: bytes([i]) for i in (97, 98, 99)}, []
        names = dict((t, i) for i, t in tokens.items())
        while len(merges) < 12:
            a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
            if tokens[a] + tokens[b] not in names:
                names[tokens[a] + tokens[b]] = i = 200 + len(merges)
                tokens[i] = tokens[a] + tokens[b]
                merges.append((a, b))
        made = bpe.Merges(tokens, merges)
        made.step = max(map(len, tokens.values()))
        data = bytes(rng.choice(b"abc") for _ in range(200))
        ids = list(data)
        for a, b in merges:
            i = 0
            while i + 1 < len(ids):
                if (ids[i], ids[i + 1]) == (a, b):
                    ids[i : i + 2] = [made.pairs[a, b][1]]
                i += 1
        assert made.merge(data) == ids == sum(made.stream(data), [])


# Packing


def test_packing(odd, empty):
    theirs = library(packing.VOCABULARY)
    want = Counter()
    for i, t in texts(odd):
        want[i, tuple(theirs.encode(t, add_special_tokens=False).ids + [1])] += 1
    got = packing.packed_documents(odd).toPandas()
    full = got.groupby("sequence_id")
    assert (got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.cumsum() == got.offset + got.length).all()
    assert all(n == 2048 or n & (n - 1) == 0 for n in full.length.sum())
    assert all(zlib.crc32(np.asarray(x, dtype="<u4").tobytes()) == c and len(x) == n for x, c, n in zip(got.ids, got.ids_crc32, got.length))
    spread = Counter()
    for (i, n), part in got.groupby(["doc_id", "doc_tokens"], dropna=False):
        repeated = part.start.eq(0).sum()
        assert part.length.sum() == n * repeated
        if repeated == 1:
            spread[None if pd.isna(i) else int(i), tuple(int(x) for ids in part.sort_values("start").ids for x in ids)] += 1
    assert all(want[k] == 1 for k in spread) and sum(spread.values()) >= sum(want.values()) - 2
    assert len(packing.packed_documents(empty).toPandas()) == 0


def test_neighbours_share_words():
    ids = [np.asarray(x, dtype="<u2") for x in ([5, 6, 7, 8], [50, 60, 70], [5, 6, 9, 10], [50, 61, 71])]
    index = packing.Index(ids, np.ones(1 << 16, dtype=np.float32), 4.0)
    assert index.neighbours(0, np.asarray([False, True, True, True])).tolist() == [2]
    assert index.neighbours(1, np.asarray([True, False, True, True])).tolist() == [3]


def test_seeds_ask_all_terms_of_all_documents(spark, monkeypatch):
    """Against BM25 of every seed with every document of the table, over many indexes."""
    random.seed(8)
    tokens = spark.createDataFrame(
        [(i, np.asarray([random.randrange(10, 400) for _ in range(60)] + [1], dtype="<u2").tobytes(), 61) for i in range(300)],
        "doc_id long, ids binary, doc_tokens long",
    )
    weights, mean = packing.term_weights(tokens)
    bags = [Counter(np.frombuffer(r["ids"], dtype="<u2").tolist()) for r in tokens.collect()]

    def score(a, b):
        norm = packing.K1 * (1 - packing.B + packing.B * 61 / mean)
        return sum(weights[t] * b[t] * (packing.K1 + 1) / (b[t] + norm) for t in a if t in b)

    asked = []
    settled = packing.settled
    monkeypatch.setattr(packing, "settled", lambda claims, rooms: asked.append((claims.toPandas(), rooms.toPandas())) or settled(claims, rooms))
    pieces = packing.pack(tokens, window=256, index_docs=100, last_docs=200).toPandas()
    assert pieces.length.sum() == 300 * 61 and sum(pieces.groupby("sequence_id").length.sum() != 256) <= 8
    placed = packing.placed_tokens(tokens, 3).toPandas()
    name = dict(zip(placed.base, placed.doc_id))
    claims, rooms = asked[0]
    free = [name[b] for b in placed.base if b not in set(rooms.window)]
    assert len(rooms) > 10
    for window, part in claims.groupby("window"):
        got = part.sort_values("score").tail(4).score.tolist()
        want = sorted(score(bags[name[window]], bags[d]) for d in free)[-4:]
        assert np.allclose(got, want, rtol=1e-4)


def test_windows_hold_neighbours_from_all_shards(spark):
    """Documents of 150 subjects, four of each, lie in sequences with their like."""
    random.seed(3)
    ids = lambda s: np.asarray([10 + 20 * s + random.randrange(20) for _ in range(63)] + [1], dtype="<u2").tobytes()
    tokens = spark.createDataFrame([(i, ids(i % 150), 64) for i in range(600)], "doc_id long, ids binary, doc_tokens long")
    got = packing.pack(tokens, window=256, index_docs=150, last_docs=150).toPandas()
    subjects = got.assign(subject=got.doc_id % 150).groupby("sequence_id").subject.nunique()
    assert (subjects == 1).mean() > 0.5


def test_seeds_of_large_tables_ask_all_documents(spark, monkeypatch):
    """However many documents there are, a window's best ones are those of the whole table."""
    random.seed(12)
    rows = [(i, [random.randrange(10, 3000) for _ in range(random.randrange(4, 20))] + [1]) for i in range(17_000)]
    rows += [(None, rows[7][1]), (20_000, [random.randrange(10, 3000) for _ in range(500)] + [1]), *[rows[3]] * 5]
    coded = [(i, np.asarray(x, dtype="<u2").tobytes(), len(x)) for i, x in rows]
    tokens = materialize(spark.createDataFrame(coded, "doc_id long, ids binary, doc_tokens long").repartition(5), "tokens")
    weights, mean = packing.term_weights(tokens)
    asked, settled = [], packing.settled
    monkeypatch.setattr(packing, "settled", lambda claims, rooms: asked.append((claims, rooms)) or settled(claims, rooms))
    got = packing.pack(tokens, window=64).toPandas().sort_values(["sequence_id", "offset"])
    placed = packing.placed_tokens(tokens, 5).toPandas()
    bags = {b: Counter(np.frombuffer(x, dtype="<u2").tolist()) for b, x in zip(placed.base, placed.ids)}
    claims, rooms = (x.toPandas() for x in asked[0])
    assert len(rooms) > 1000
    begin = np.sort(placed.base)
    seeds = set(begin[np.searchsorted(begin, rooms.window, side="right") - 1])
    free = [b for b in bags if b not in seeds]
    for window, part in list(claims[claims.window.isin(list(bags))].groupby("window"))[:5]:
        score = [
            sum(weights[t] * bags[b][t] * (packing.K1 + 1) / (bags[b][t] + packing.K1 * (1 - packing.B + packing.B * bags[b].total() / mean)) for t in bags[window] if t in bags[b])
            for b in free
        ]
        assert np.allclose(part.score.nlargest(3), sorted(score)[:-4:-1], rtol=1e-4)
    sequences = got.groupby("sequence_id")
    assert (sequences.length.cumsum() == got.offset + got.length).all()
    assert (sequences.length.sum() != 64).sum() <= 6 and got.length.sum() == sum(len(x) for _, x in rows)
    for i, x in rows[:50] + rows[-7:]:
        part = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        times = 6 if i == 3 else 1
        assert part.length.sum() == times * len(x) and (times > 1 or np.concatenate(part.ids.to_list()).tolist() == x)


def test_drawn_texts_ask_all_terms_of_all_documents(spark, monkeypatch):
    """Each document goes to the drawn text with the highest BM25 score for it, over partitions and slices of texts."""
    random.seed(10)
    ids = [np.asarray([random.randrange(10, 400) for _ in range(random.randrange(1, 80))] + [1], dtype="<u2").tobytes() for _ in range(300)]
    rows = [(i, x, len(x) // 2) for i, x in enumerate(ids + ids[:20])]
    tokens = spark.createDataFrame(rows, "doc_id long, ids binary, doc_tokens long").repartition(3)
    weights, mean = packing.term_weights(tokens)
    monkeypatch.setattr(packing, "ASKS", 10)
    sent = packing.drawn_asks(tokens, 10)
    asks = {int(n): np.frombuffer(t, dtype="<u2").tolist() for part in sent for n, t in zip(*part.value)}
    assert len(sent) > 1 and 10 < len(asks) < 80
    got = packing.nearest_asks(tokens, sent, spark.sparkContext.broadcast(weights), mean).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(320))
    for r in got:
        bag = Counter(np.frombuffer(r["ids"], dtype="<u2").tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * r["doc_tokens"] / mean)
        score = {n: sum(weights[t] * bag[t] * (packing.K1 + 1) / (bag[t] + norm) for t in terms if t in bag) for n, terms in asks.items()}
        assert np.isclose(r["score"], max(score.values()), rtol=1e-4) and np.isclose(score[r["name"]], r["score"], rtol=1e-4)


def test_large_tables_are_packed_without_rounds(spark, monkeypatch):
    """Every token once, in full windows or powers of two; subjects that are drawn keep together."""
    random.seed(11)
    monkeypatch.setattr(packing, "rounds", None)
    size = lambda i: 700 if i % 97 == 0 else 0 if i % 50 == 0 else 63
    ids = lambda i: np.asarray([10 + 20 * (i % 40) + random.randrange(20) for _ in range(size(i))] + [1], dtype="<u2").tobytes()
    rows = [(i, ids(i)) for i in range(1200)]
    rows += [(None, rows[7][1]), (5000, rows[97][1]), *[rows[3]] * 5]
    tokens = spark.createDataFrame([(i, x, len(x) // 2) for i, x in rows], "doc_id long, ids binary, doc_tokens long").repartition(4)
    got = packing.pack(tokens, window=256, whole_docs=1000, every=8).toPandas()
    got = got.sort_values(["sequence_id", "offset"]).reset_index(drop=True)
    sequences = got.groupby("sequence_id")
    assert (sequences.length.cumsum() == got.offset + got.length).all()
    sizes = sequences.length.sum()
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes) and (sizes != 256).sum() <= 8
    assert all(zlib.crc32(np.asarray(x, dtype="<u4").tobytes()) == c and len(x) == n for x, c, n in zip(got.ids, got.ids_crc32, got.length))
    assert got.length.sum() == sum(len(x) // 2 for _, x in rows)
    for i, x in rows:
        part = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        if i == 3:
            assert part[part.start == 0].shape[0] == 6 and part.length.sum() == 6 * len(x) // 2
        else:
            assert np.concatenate(part.ids.to_list()).tolist() == np.frombuffer(x, dtype="<u2").tolist()
    subjects = got.assign(subject=got.doc_id % 40).groupby("sequence_id").subject.nunique()
    assert (subjects <= 2).mean() > 0.6
    bare = packing.pack(tokens, window=256, with_ids=False, whole_docs=1000, every=10**9).toPandas()
    assert "ids" not in bare and bare.length.sum() == got.length.sum()


# Queries


@pytest.mark.parametrize("name", list(llm.SQL))
def test_query(spark, name):
    assert compare.check(spark, compare.oracle("0.001"), "0.001", name, llm.QUERIES[name], llm.SQL[name]) == ""


def test_thirteen_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES) == list(range(1, 14))


def test_likeness_reads_fingerprints_as_bytes(spark):
    """Cut out of strings, each of 320 hashes passed all letters before it."""
    width = imatch.SUBSETS * imatch.DIGITS
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:200]), " ".join(words[290:]), "only this", "", "!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = imatch.compared(df).withColumn("near", imatch.likeness("fingerprint", "next_print"))
    assert "unhex(fingerprint" in found._jdf.queryExecution().optimizedPlan().toString()

    def plain(a: str, b: str) -> float:
        if a == b or "#" in a + b:
            return float(a == b)
        held = []
        for level in range(imatch.LEVELS):
            cut = [slice(i, i + imatch.DIGITS) for i in range(level * width, (level + 1) * width, imatch.DIGITS)]
            held.append([a[c] == b[c] for c in cut if (a[c], b[c]) != (imatch.EMPTY, imatch.EMPTY)])
        enough = [x for x in held if len(x) >= imatch.READ_FROM]
        same = (enough or held[:1])[-1]
        return sum(same) / max(len(same), 1)

    for row in found.collect():
        assert row["near"] == plain(row["fingerprint"], row["next_print"])


def test_bands_and_class_texts_are_not_sent(spark):
    """A stored row with many bands is sized as one with a single band, and texts as they are packed."""
    classes = [(i, [i // 2, 1000 + i % 5, 2000 + i]) for i in range(20)]
    stored = materialize(spark.createDataFrame(classes, "class long, bands array<long>"), "classes")
    found = minhash.shared_bands(stored)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    size = Counter(k for _, bands in classes for k in bands)
    want = sorted((k, i, size[k]) for i, bands in classes for k in bands if size[k] > 1)
    assert sorted(found.select("key", "class", "size").collect()) == want
    texts = materialize(spark.createDataFrame([(i, "one two three four " * 40) for i in range(20)], "class long, text string"), "texts")
    pairs = materialize(spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"), "pairs")
    same = minhash.verified(pairs, texts, 4, 80)
    assert "Broadcast" not in same._jdf.queryExecution().sparkPlan().toString()
    assert sorted(same.collect()) == [(0, 1), (2, 3)]


def test_toxicity_samples_keep_a_word_once(spark):
    docs = spark.createDataFrame([(i, f"common words{i} here") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    words, _ = toxicity.sample(docs, labels, "doc_id")
    assert len(words) > 5 and len({id(w) for d in words for w in d if w == "common"}) == 1


def test_graphs_stay_small():
    """Wide vectors make more shards, large tables larger slices; upper layers hold their own nodes only."""
    assert hnsw.cuts(0, 0) == (8, 1) and hnsw.cuts(256_410, 64) == (8, 16)
    shards, slices = hnsw.cuts(3_000_000, 64)
    assert shards * hnsw.SHARD_BYTES >= 3_000_000 * 12 * 64 and slices == 46
    assert hnsw.cuts(100_000, 1024)[0] > 30
    vectors = np.random.default_rng(4).standard_normal((600, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(vectors)
    whole = list(graph.layers)
    graph.close()
    assert len(whole) > 1 and sum(len(x.links) for x in graph.layers[:-1]) < 100
    ids = np.arange(600)
    assert all((a[ids] == b[ids]).all() for a, b in zip(graph.layers, whole))
