"""Odd rows, names and keys; hot groups; trained models against plain arithmetic."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import storage
from factloom.llm import common, decontamination, jaccard, language, mixing, quality, sharding, token_counts, topk, toxicity, warc
from factloom.llm.queries import VOCABULARY
from tests.llm.test_operators import blanks_apart, brute_contamination, jump, plain_words

MASK = (1 << 64) - 1
#: Names that operators use inside, in several cases.
INNER = (
    "id h n s1 s2 bits minima prefix node component token least x y a b tile side size source_size target taken hash again row at filled rest whole left hash_at "
    "again_at row_at wanted own hashed copies doc bucket part number base shard slot grown_shard TEXT_CRC32 score Known known _known _copy _hash _start _bucket _n_chars "
    "lang_pred most _w _f _g _m _s fp places n_words n_hit n_items items_sha256 contaminated _rows own_key block record h2 n_tokens n_docs rank query_id dim kind ids data"
).split()


def with_names(df, besides=()):
    taken = {c.lower() for c in df.columns} | {c.lower() for c in besides}
    for name in INNER:
        if name.lower() not in taken:
            df, taken = df.withColumn(name, F.lit("?")), taken | {name.lower()}
    return df


TEXTS = ["a b c d e f g", "a b c d e f g", "", None, "ok then", "Ünï cödé"]


@pytest.mark.parametrize("kind, keys", [("string", ["k1", "k1", None, "", "k 2", "k3"]), ("short", [1, 1, None, 2, 3, 4]), ("decimal(10,2)", None), ("long", [1, 1, None, 2, 3, 4])])
def test_names_and_keys(spark, kind, keys):
    rows = [(i if keys is None else k, t, "s", "en", 3) for i, (k, t) in enumerate(zip(keys or TEXTS, TEXTS, strict=True))]
    docs = with_names(spark.createDataFrame(rows, f"doc_id {'int' if keys is None else kind}, text string, source string, lang string, n_chars long").withColumn("doc_id", F.col("doc_id").cast(kind)))
    labels = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows)], f"doc_id {'int' if keys is None else kind}, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        own = docs.drop("score")
        got = module.score(own, module.train(docs, labels, label, F.lit(True)))
        assert got.count() == len(rows) and [c for c in own.columns if c != "text"] == got.columns[:-1] and not got.where("score is null or score < 0 or score > 1").take(1)
        assert {r["known"] for r in got.select(F.col("known")).collect()} == {"?"}
    got = language.predict(docs, language.train(docs, F.lit(True)))
    assert got.count() == len(rows) and got.where("node = '?'").count() == len(rows)
    sharded = sharding.assign_shards(docs, 4)
    assert sharded.count() == len(rows) and set(docs.columns) - {"shard", "slot", "size", "grown_shard", "TEXT_CRC32"} <= set(sharded.columns)
    assert not sharded.where("bucket <> '?' or base <> '?' or number <> '?'").take(1)
    by_key = {}
    for r in sharded.collect():
        by_key.setdefault(r["doc_id"], set()).add(r["shard"])
        assert kind == "string" or kind.startswith("decimal") or r["shard"] == jump(int(r["doc_id"] or 0), 4)
    assert all(len(v) == 1 for v in by_key.values())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and not mixed.where("wanted <> '?' or hash <> '?' or copies <> '?' or doc <> '?'").take(1)
    assert mixing.mix(docs).count() == len(rows)
    benchmark = spark.createDataFrame([("x", "a b c d e f g"), (None, "ok then")], "item_id string, text string")
    assert decontamination.contamination(docs, benchmark).where("contaminated").count() == 2
    assert token_counts.with_suffix_sums(token_counts.length_histogram(docs, VOCABULARY)).agg(F.sum("n_docs")).first()[0] == len(rows)
    if kind in ("short", "long"):
        assert jaccard.jaccard_components(docs).count() == len(rows)
        vectors = with_names(docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding")), ("score",))
        assert topk.top_k(vectors, F.lit(True)).count() == 3 + 3 * 4  # id 1 twice: a query once, a candidate twice
    pages = with_names(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html")))
    made = warc.derivatives(warc.responses_of(pages))
    assert made.count() == 2 * len(rows) and made.schema["page_id"].dataType == pages.schema["page_id"].dataType


def test_added_columns_replace_their_own_name(spark):
    docs = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, SIZE int")
    assert sharding.assign_shards(docs, 4).columns == ["doc_id", "text", "size", "text_crc32", "shard", "grown_shard", "slot"]
    assert toxicity.score(docs.withColumn("score", F.lit("x")), (np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0)).first()["score"] == 0.5


@pytest.mark.parametrize("words", [300_000])
def test_a_long_text_of_benchmark_words(spark, words):
    item = " ".join(f"w{i}" for i in range(30))
    long = " ".join([item] * (words // 30))
    rows = [(1, long), (2, " ".join(f"z{i % 997}" for i in range(words))), (3, long + " x"), (4, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in decontamination.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    digest = hashlib.sha256(b"1").hexdigest()
    assert got[1] == (1, words, words, 1, digest, True) and got[3] == (3, words + 1, words, 1, digest, True)
    assert got[2][2:4] == (0, 0) and got[4][2:4] == (0, 0)


def test_windows_of_many_items_and_repeated_rows(spark):
    common_window = " ".join(f"c{i}" for i in range(14))
    items = [(i, f"{common_window} own{i} tail") for i in range(300)]
    rows = [(i, f"x{i} {common_window} y") for i in range(40)] + [(5, f"x5 {common_window} y")] * 50 + [(5, "other")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for bound in (10**6, 0):
        got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), bound=bound).collect()
        assert len(got) == len(rows) and sum(r["n_items"] == 300 and r["n_hit"] == 14 for r in got) == 90 and sum(r["n_hit"] == 0 for r in got) == 3


def test_repeated(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, 8), (5, 17)], "at long, times long")
    assert sorted(r["at"] for r in common.repeated(df, "times", piece=4).collect()) == [2] + [3] * 7 + [4] * 8 + [5] * 17


def brute_groups(rows):
    """Least id by id, where rows of one id are one document with the links of all its texts."""
    sets = [(i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := blanks_apart(t)) else set()) for i, t in rows]
    least = {i: i for i, _ in sets if i is not None}
    links = [(i, j) for i, x in sets for j, y in sets if i is not None and j is not None and i < j and x and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(((-1 if i is None else i), len(s), (-1 if i is None else least[i])) for i, s in sets)


@pytest.mark.parametrize("run, block, large, heavy", [(64, 256, 32, 1 << 14), (2, 4, 32, 1 << 14), (2, 2, 3, 1 << 14), (3, 8, 4, 4), (2, 2, 1000, 6)])
def test_texts_of_one_id_are_one_document(spark, monkeypatch, run, block, large, heavy):
    for name, value in (("RUN", run), ("BLOCK", block), ("LARGE", large), ("HEAVY", heavy)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(run)
    texts = [" ".join(rng.choices([f"v{i}" for i in range(60)], k=40)) for _ in range(6)]

    def near(t):
        w = t.split()
        w[rng.randrange(len(w))] = f"u{rng.randrange(9)}"
        return " ".join(w)

    rows = [(i, near(texts[i // 10])) for i in range(60)]
    rows += [(100, texts[0]), (100, texts[3]), (101, ""), (101, texts[1]), (102, None), (102, texts[1]), (103, "lone words only here now"), (103, "quite other lone words here now"), (104, ""), (104, None)]
    rows += [(105, texts[4])] * 40 + [(None, texts[2])] * 3 + [(7, texts[5])]
    rng.shuffle(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute_groups(rows)


@pytest.mark.parametrize("run", [64, 2])
def test_an_id_bridges_two_groups(spark, monkeypatch, run):
    monkeypatch.setattr(jaccard, "RUN", run)
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, b), (100, a), (100, b), (3, a + " x"), (4, b + " y"), (5, "")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (100, 1), (5, 5)}


@pytest.mark.parametrize("run, block, large", [(64, 256, 1000), (2, 2, 1000)])
def test_heavy_shingles_are_dealt_to_cells(spark, monkeypatch, run, block, large):
    for name, value in (("RUN", run), ("BLOCK", block), ("LARGE", large), ("HEAVY", 4)):
        monkeypatch.setattr(jaccard, name, value)
    # One passage of 8 to 90 words in most texts, so that sizes lie in many bands.
    words = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join(words[: 8 + i % 83] + [f"own{i % 5}"] * (i % 4))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = []
    plain = jaccard.cells
    monkeypatch.setattr(jaccard, "cells", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    got = jaccard.jaccard_components(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(rows)
    sizes = [r["count"] for r in dealt[0][1].groupBy("run").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 40  # of 120 rows; pieces are filled at random


def brute_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(blanks_apart(text))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, full = {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while True:
        rate = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        target = {s: 3.0 * sizes[s] if s in full else rate * weight[s] for s in names}
        if not (over := {s for s in names if target[s] > 3 * sizes[s]} - full):
            return sizes, target
        full |= over


MIXES = {
    "null ids": [(None, "w", s) for s in "aab" for _ in range(1000)],
    "one id": [(7, "w", s) for s in "aab" for _ in range(1000)],
    "one id, other texts": [(7, " ".join(["w"] * (i % 5)) + f" t{i}", s) for s in "aabb" for i in range(200)],
    "half copies": [(i % 2 * i, "one two three" if i % 2 else "x y", "ab"[i % 3 == 0]) for i in range(900)],
    "null sources": [(i, "w " * (i % 7), [None, "é", "z"][i % 3]) for i in range(500)],
    "nothing": [(1, None, "a"), (2, "", None)],
}


@pytest.mark.parametrize("name", MIXES)
def test_every_source_meets_its_target(spark, name):
    rows = MIXES[name]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    sizes, target = brute_targets(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    whole = {}
    for r in mixing.mixed_documents(docs.withColumn("more", F.lit(1))).collect():
        whole[r["source"]] = whole.get(r["source"], 0) + len(blanks_apart(r["text"]))
    longest = max(len(blanks_apart(t)) for _, t, _ in rows)
    assert all(abs(whole.get(s, 0) - target[s]) <= longest for s in sizes)


def test_a_hot_key_is_cut_into_parts(spark):
    rows = [(7, "x")] * 500 + [(i, f"t{i}") for i in range(100)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8, hot=50).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 600 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and {r["shard"] for r in out if r["doc_id"] == 7} == {jump(7, 8)}


def test_scores_at_the_least_integer(spark):
    m = -(2.0**63)
    rows = [(0, [1.0, 1.0]), (1, [m, 1.0]), (2, [m, 3.0]), (3, [m, m]), (4, [-m, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1.0).collect()
    low, high = -(2**63), 2**63 - 1
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(4, high), (2, low + 3), (1, low + 1), (3, low)]


def test_bounds_go_on_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "HELD", 2)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 10, 5)]) for i in rng.permutation(500)] + [(20, [1.0] * 5)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 10 == 0, k=7, scale=1.0).collect()
    want = []
    for q in {r[0] for r in rows if r[0] % 10 == 0}:
        asked = {tuple(v) for i, v in rows if i == q}
        scores = sorted((-int(np.dot(v, u)), i) for v in asked for i, u in rows if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def odd(i):
    return int(common.ODD[i])


def mixed(h):
    h = ((h ^ (h >> 32)) * odd(60)) & MASK
    h = ((h ^ (h >> 29)) * odd(61)) & MASK
    return h ^ (h >> 32)


def word_hash(w):
    import xxhash

    return xxhash.xxh3_64_intdigest(w.encode())


def test_factorisation_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    size = (1 << quality.BITS) + quality.DENSE
    m = quality.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(0, 0.3, (size, quality.FACTORS)).astype(np.float32))
    made = [quality.features(t.encode(), None, common.WordHashes()) for t in ("one two three two", "", "A longer text. With lines\nand 42 numbers!")]
    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in made])[:-1]])
    got, _ = m.logits(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), starts)
    for (idx, val), logit in zip(made, got, strict=True):
        want = m.w0 + sum(float(m.w[i]) * float(v) for i, v in zip(idx, val, strict=True))
        for a in range(len(idx)):
            for b in range(a + 1, len(idx)):
                want += float(np.dot(m.v[idx[a]].astype(float), m.v[idx[b]].astype(float))) * float(val[a]) * float(val[b])
        assert logit == pytest.approx(want, abs=1e-3)
    buckets = {mixed(word_hash(w)) >> (64 - quality.BITS) for w in ("one", "two", "three")}
    assert set(made[0][0][: -quality.DENSE].tolist()) == buckets and made[0][1][0] == pytest.approx(1 / math.sqrt(3))


def test_factorisation_machine_learns_along_the_gradient():
    rows = [quality.features(t.encode(), None, common.WordHashes()) for t in ("good plain text", "bad junk 1234", "bad text")]
    y = np.array([1, 0, 0], np.float32)
    got = quality.fit(rows, y, epochs=1, batch=3, rate=0.1, l2=0.0)
    size = (1 << quality.BITS) + quality.DENSE
    start = np.random.default_rng(7).normal(0, 0.05, (size, quality.FACTORS)).astype(np.float32).astype(np.float64)

    def loss(w0, w, v):
        total = 0.0
        for (idx, val), label in zip(rows, y, strict=True):
            x = val.astype(np.float64)
            vx = v[idx] * x[:, None]
            z = w0 + w[idx] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
            total += math.log1p(math.exp(-z if label else z))
        return total / len(rows)

    zero = np.zeros(size)
    step = 1e-5
    for i in (int(rows[0][0][0]), int(rows[1][0][1]), size - 1, size - 5):
        up, down = zero.copy(), zero.copy()
        up[i], down[i] = step, -step
        g = (loss(0, up, start) - loss(0, down, start)) / (2 * step)
        assert got.w[i] == pytest.approx(-0.1 * g / math.sqrt(0.01 + g * g), abs=1e-4)
        up, down = start.copy(), start.copy()
        up[i, 2] += step
        down[i, 2] -= step
        g = (loss(0, zero, up) - loss(0, zero, down)) / (2 * step)
        assert got.v[i, 2] - start[i, 2] == pytest.approx(-0.05 * g / math.sqrt(0.01 + g * g), abs=1e-4)


def toxic_buckets(text):
    h = [word_hash(w) for w in re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).split()]
    grams = list(h)
    for gap in (1, 2, 3):
        grams += [(a * odd(2 * gap) + b * odd(2 * gap + 1)) & MASK for a, b in zip(h, h[gap:])]
    return sorted({mixed(g) >> (64 - toxicity.BITS) for g in grams})


def test_ftrl_is_the_published_update():
    texts = ["you are kind", "you are a vile fool", "a vile vile thing", "kind words", "fool"] * 6
    labels = [0, 1, 1, 0, 1] * 6
    rows = [toxicity.features(t.encode(), common.WordHashes()) for t in texts]
    assert [r.tolist() for r in rows] == [toxic_buckets(t) for t in texts]
    learner = toxicity.Ftrl(least_l1=0.1, most_l1=0.1)
    used, weights, bias = learner.fit(rows, labels, epochs=2)
    z, n, b, bn = {}, {}, 0.0, 1.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.1:
            return 0.0
        return -(z[i] - math.copysign(0.1, z[i])) / ((learner.beta + math.sqrt(n[i])) / learner.alpha + learner.l2)

    for _ in range(2):
        for t, y in zip(texts, labels, strict=True):
            x = toxic_buckets(t)
            p = 1 / (1 + math.exp(-(sum(weight(i) for i in x) + b)))
            g = (p - y) * (learner.weight if y else 1)
            for i in x:
                w, before = weight(i), n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / learner.alpha * w
                n[i] = before + g * g
            bn += g * g
            b -= 0.5 * g / math.sqrt(bn)
    want = {i: weight(i) for i in z if weight(i)}
    assert bias == pytest.approx(b) and dict(zip(used.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, abs=1e-5)


def test_toxic_scores_are_sums_of_weights(spark):
    texts = ["you are kind", "a vile fool", None, "", "!?", "kind " * 50_000 + "fool"]
    rows = [toxicity.features(t.encode(), common.WordHashes()) for t in ("you are kind", "a vile fool")]
    model = toxicity.Ftrl(least_l1=0.01, most_l1=0.01).fit(rows * 5, [0, 1] * 5)
    weights = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        z = model[2] + sum(weights.get(i, 0.0) for i in toxic_buckets(texts[r["doc_id"]] or ""))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def grams(text):
    """N-grams of letters in lower case, with one blank around words."""
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    if not flat.strip():
        return []
    return [flat[1:][i] for i in range(len(flat) - 1)] + [flat[i : i + n] for n in (2, 3, 4) for i in range(len(flat) - n + 1)]


def gram_bucket(gram, bits=language.BITS):
    h = 0
    for place, c in enumerate(gram):
        h = (ord(c) * odd(0)) & MASK if place == 0 else (h * odd(1) + ord(c) * odd(0)) & MASK
    m = ((h + len(gram)) * odd(2)) & MASK
    return (((m ^ (m >> 31)) * odd(3)) & MASK) >> (64 - bits)


@pytest.mark.parametrize("piece", [1 << 18, 3, 1])
def test_language_counts_are_those_of_plain_ngrams(spark, monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    texts = {1: ("the cat, the hat", "en"), 2: ("der Hut 12 und", "de"), 3: ("und der", "de"), 4: (" x ", "en"), 5: ("...", "de"), 6: (None, "en"), 7: ("the und", None), 8: ("Über", "de")}
    for t, _ in texts.values():
        got = sorted(b for own in language.buckets(t or "") for b in own.tolist())
        assert got == sorted(map(gram_bucket, grams(t or "")))
    docs = spark.createDataFrame([(i, *v) for i, v in texts.items()] + [(3, "und der", "de")], "doc_id long, text string, lang string").repartition(1)
    model = language.train(docs, F.col("doc_id") != 8)
    counts = {n: {} for n in ("de", "en")}
    for i, (t, lang) in texts.items():
        if lang and t and i != 8:
            for g in grams(t):
                counts[lang][gram_bucket(g)] = counts[lang].get(gram_bucket(g), 0) + 1
    prior = {"de": 4 + 1, "en": 2 + 1}  # rows with a text; a repeated row counts in the prior and teaches once
    total = {n: sum(c.values()) + 0.5 * (1 << language.BITS) for n, c in counts.items()}
    for r in language.predict(docs, model).collect():
        own = [gram_bucket(g) for g in grams(texts[r["doc_id"]][0] or "")]
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logit = {n: math.log(prior[n] / 8) + sum(math.log((counts[n].get(b, 0) + 0.5) / total[n]) for b in own) for n in counts}
        best = max(logit, key=logit.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(x - logit[best]) for x in logit.values()), abs=1e-4)


def test_language_samples_are_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    counted = language.train(docs, F.lit(True), sample=2500)
    assert np.exp(counted.prior).tolist() == pytest.approx([18_001 / 20_002, 2_001 / 20_002], rel=1e-3)
    # "a" exceeds the sample, "b" doesn't: each document has the same n-grams.
    ratio = np.exp(counted.table[gram_bucket("abc")])
    grams_each = len(grams("abc 1"))
    n = ratio * (0.5 * (1 << language.BITS)) / (1 - ratio * grams_each)
    assert 2000 < n[0] < 2500 and n[1] == pytest.approx(2000, rel=0.01)


def test_very_long_texts_are_read_in_pieces(monkeypatch):
    text = b"".join(f"word{i} ,x{i % 7}\n".encode() for i in range(3000))
    whole = [jaccard.shingle_set(text, common.WordHashes(), 5), toxicity.features(text, common.WordHashes()), *quality.features(text, 5.0, common.WordHashes())]
    monkeypatch.setattr(common, "TEXT_PIECE", 100)
    monkeypatch.setattr(quality, "TEXT_PIECE", 100)
    cut = [jaccard.shingle_set(text, common.WordHashes(), 5), toxicity.features(text, common.WordHashes()), *quality.features(text, 5.0, common.WordHashes())]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert list(common.word_lists(b"x" * 500)) == [[b"x" * 500]] and list(common.word_lists(b"")) == [[]]


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_samples_are_bounded_by_bytes(spark, monkeypatch, module, label):
    docs = spark.createDataFrame([(i, f"word{i} " * 5 + "good" * (i % 2)) for i in range(200)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (999, 1), (None, 1)], f"doc_id long, {label} int")
    seen = {}
    monkeypatch.setattr(module, "SAMPLE_BYTES", 2000)
    monkeypatch.setattr(common, "sampled_features", common.sampled_features)
    inner = common.sampled_features

    def counted(made, most):
        rows = list(inner(made, most))
        seen["bytes"], seen["rows"] = sum(len(r["x"]) for r in rows), len(rows)
        return iter(rows)

    monkeypatch.setattr(module, "sampled_features", counted)
    module.train(docs, labels, label, F.lit(True))
    assert 0 < seen["bytes"] <= 2000 and 0 < seen["rows"] < 200


def read_warc(data):
    """An independent reading of one record: version, headers, block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    headers = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines)
    n = int(headers["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return version, headers, rest[:n]


def chunked(data, n=7):
    return b"".join(f"{len(data[i : i + n]):x};a=b\r\n".encode() + data[i : i + n] + b"\r\n" for i in range(0, len(data), n)) + b"0\r\n\r\n"


def deflated(data, bits):
    c = zlib.compressobj(wbits=bits)
    return c.compress(data) + c.flush()


PAGE = "<html><head><title>T</title></head><body><p>grün one</p><p>two</p>".encode()
CODED = {
    "plain": ([], PAGE, PAGE), "gzip": (["Content-Encoding: gzip"], gzip.compress(PAGE, mtime=0), None), "two members": (["Content-Encoding: x-gzip"], gzip.compress(PAGE[:20], mtime=0) + gzip.compress(PAGE[20:], mtime=0), None),
    "deflate": (["content-encoding: deflate"], zlib.compress(PAGE), None), "raw deflate": (["content-encoding: deflate"], deflated(PAGE, -15), None),
    "chunked": (["Transfer-Encoding: chunked"], chunked(PAGE), PAGE), "chunked gzip": (["Transfer-Encoding: chunked", "Content-Encoding: gzip"], chunked(gzip.compress(PAGE, mtime=0)), gzip.compress(PAGE, mtime=0)),
    "twice": (["Content-Encoding: gzip, deflate"], zlib.compress(gzip.compress(PAGE, mtime=0)), None), "unknown": (["Content-Encoding: br"], b"\x00\x01", None), "broken": (["Content-Encoding: gzip"], b"not gzip", None),
    "not chunked": (["Transfer-Encoding: chunked"], PAGE, PAGE),
}


def test_codings_and_an_independent_reading(spark):
    rows = []
    for i, (lines, payload, _) in enumerate(CODED.values()):
        head = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *lines]).encode()
        rows.append((i, f"<urn:uuid:{i}>", f"http://h/{i}", "2024-05-05T00:00:00Z", bytearray(head + b"\r\n\r\n" + payload)))
    responses = spark.createDataFrame(rows, "page_id short, record_id string, target_uri string, warc_date string, block binary")
    names = list(CODED)
    for r in warc.derivatives(responses).collect():
        name = names[r["page_id"]]
        _, payload, whole = CODED[name]
        version, headers, block = read_warc(bytes(r["record"]))
        sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
        assert version == b"WARC/1.1" and headers["WARC-Type"] == r["warc_type"] and headers["WARC-Refers-To"] == f"<urn:uuid:{r['page_id']}>" and headers["WARC-Target-URI"] == f"http://h/{r['page_id']}"
        assert headers["WARC-Block-Digest"] == sha(block) and headers["WARC-Source-Payload-Digest"] == sha(payload if whole is None else whole)
        if r["warc_type"] == "conversion":
            assert block.decode() == ("" if name in ("unknown", "broken") else "grün one\ntwo")
        else:
            assert ("undecoded: content-encoding" in block.decode()) == (name in ("unknown", "broken"))


def test_contamination_of_odd_tables(spark):
    rows = [(None, "a b c"), (1, "A-B.c!"), (1, "a b c"), (2, "é é é"), (3, None), (4, " ")]
    items = [(1, "a b c"), (2, ""), (3, None), (None, "é é é"), (5, "É é é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, *brute_contamination([(i, t)], [x for x in items if x[0] is not None])[i]) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and plain_words("É") == ["É"]


@pytest.mark.parametrize("dense", [8, 0])
def test_dense_pairs_are_verified_in_rounds(spark, monkeypatch, dense):
    """Near copies in four chains of drifting texts: links all count, but few of the pairs within a component are looked at."""
    for name, value in (("LARGE", 10**6), ("DENSE", dense), ("LEADERS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = []
    for group in range(4):
        words = [f"g{group}w{i}" for i in range(400)]
        for i in range(45):
            words[(i * 9) % 400] = f"x{group}.{i // (1 + group)}"
            rows.append((group * 100 + i, " ".join(words)))
    looked, plain = [], jaccard.verified

    def verified(texts, pairs, *more):
        looked.append(pairs.count())
        return plain(texts, pairs, *more)

    monkeypatch.setattr(jaccard, "verified", verified)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(396)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == set(least.items())
    assert len(links) > 1500 and len(looked) > 1 and sum(looked) < len(links) / 2


@pytest.mark.parametrize("piece", [500_000, 50, 0])
def test_components_of_few_edges_take_two_tables(spark, monkeypatch, piece):
    """A long path, a star and pairs: tasks contract their own edges, and one task settles what is left, unless that is too much."""
    monkeypatch.setattr(common, "PIECE_EDGES", piece)
    written, plain = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, *a, **b: written.append(a) or plain(df, *a, **b))
    rng = random.Random(4)
    path = rng.sample(range(1000), 300)
    edges = [*zip(path, path[1:]), *((5000, 5001 + i) for i in range(40)), (7001, 7000), (7001, 7000), (8000, 8000)]
    rng.shuffle(edges)
    got = [(r["node"], r["component"]) for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()]
    assert sorted(got) == sorted([*((i, min(path)) for i in path), *((i, 5000) for i in range(5000, 5041)), (7000, 7000), (7001, 7000)])
    assert piece < 500_000 or len(written) == 2
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_wide_rows_reach_python_in_small_batches(spark, monkeypatch):
    before, seen, plain = spark.conf.get(common.BATCH), [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda *a: seen.append(spark.conf.get(common.BATCH)) or plain(*a))
    assert jaccard.jaccard_components(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).count() == 2
    assert set(seen) == {common.BATCH_BYTES} != {before} and spark.conf.get(common.BATCH) == before


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    rows = [(i, " ".join(base[: rng.randrange(50, 60)] if i % 3 else [f"o{i}-{j}" for j in range(30)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = []

    def counted(df, name="table", lean=False):
        out = storage.materialize(df, name, lean)
        files = out.inputFiles()
        beside = [x for folder in {f.removeprefix("file://").rpartition("/")[0] for f in files} for x in os.listdir(folder) if x.endswith(".crc")]
        written.append((name, len(files), beside))
        return out

    for module in (common, jaccard):
        monkeypatch.setattr(module, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == set(brute_groups(rows))
    narrow = {"classes", "slim", "ids", "links", "linked", "pairs"}
    assert not [x for x in written if x[2]]
    assert {name for name, *_ in written} >= narrow and all(n <= 1 for name, n, _ in written if name in narrow - {"pairs"})
