"""Operators against brute force, round trips and held-out labels on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, jaccard, language, mixing, quality, sharding, token_counts, topk, toxicity, warc
from factloom.llm.common import components, crc_mod
from factloom.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names that operators must not trip over.
ODD = {"score": "x", "shard": "y", "size": "z", "id": "1", "n": "2", "component": "3", "token": "4"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blanks_apart(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 30, 120]))) for _ in range(60)]
    out = []
    for i in range(260):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append([i, rng.choice([" ", "\n", " \t"]).join(words), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "é", None]), 5])
    out += [[1000, None, "en", "a", None], [1001, "", None, "b", 0], [1002, " \n ", "en", None, 3], [1003, "$$$ --- 12", "de", "c", 9], [1004, "Ünï " * 4000, "de", "b", 1], [1005, "x", "en", "d", 1]]
    return out + [list(r) for r in out[:3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in ODD.items()}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows):
    sets = {}
    for i, text, *_ in rows:
        w = blanks_apart(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.mark.parametrize("run", [64, 3])
def test_jaccard_is_exact(spark, docs, rows, empty, monkeypatch, run):
    monkeypatch.setattr(jaccard, "RUN", run)
    monkeypatch.setattr(jaccard, "BLOCK", 4 if run == 3 else 256)
    monkeypatch.setattr(jaccard, "LARGE", 4 if run == 3 else 32)
    got = jaccard.jaccard_components(docs).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    assert jaccard.jaccard_components(empty).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(lone).collect()} == {(None, 2, None), (7, 2, 7)}


def test_jaccard_of_a_common_shingle_over_all_sizes(spark, monkeypatch):
    """Blocks of a common shingle hold small and large sets; links within and across blocks stay."""
    monkeypatch.setattr(jaccard, "RUN", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LARGE", 10**6)
    # A rare head in front of a base that copies make common: all heads come first, whatever the size.
    base = [f"b{i}" for i in range(2600)]
    rows = [(i, " ".join([f"h{j}" for j in range(12)] + base[: int(10 * 1.15**i)])) for i in range(40)]
    rows += [(i, " ".join(base)) for i in range(100, 300)]
    want = brute_components(rows)
    assert {c for _, c in want.values()} == {0}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202), (202, 201)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 201: 201, 202: 201}


def brute_contamination(rows, items):
    windows = {}
    for i, text in items:
        w = plain_words(text)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(i))
    out = {}
    for i, text, *_ in rows:
        w, hit, own = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    own |= found
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination_is_exact(spark, docs, rows, empty, bound):
    rng = random.Random(4)
    texts = [r[1] for r in rows if r[1] and len(plain_words(r[1])) > 15]
    items = []
    for i in range(12):
        w = plain_words(rng.choice(texts))
        at = rng.randrange(len(w) - 14)
        items.append((i, ", ".join(w[at : at + rng.choice([13, 14, 15])]).upper() + (" tail of its own here" if i % 2 else "")))
    items += [(20, "w1 w2"), (21, "w5"), (22, None), (23, " ... "), (24, "a " * 40), (None, "w7"), (20, "w1 w2"), (25, "Ünï " * 13)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, benchmark, bound=bound).collect()
    want = brute_contamination(rows, [x for x in items if x[0] is not None])
    assert len(got) == len(rows) and [(tuple(r), want[r["doc_id"]]) for r in got if tuple(r)[1:] != want[r["doc_id"]]] == []
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert not decontamination.contamination(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").take(1)


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(blanks_apart(text))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        rate = left / max(1, sum(weight[s] for s in names if s not in full))
        target = {s: 3.0 * sizes[s] if s in full else rate * weight[s] for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    by_id = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    taken = {s: 0 for s in names}
    for r in got:
        _, text, _, source, _ = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (len(blanks_apart(text)), sizes[source]) and r["target"] == pytest.approx(target[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() > 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, rows, empty):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), 40).alias("s"), sharding.jump_hash(F.col("k"), 1).alias("o")).collect()
    assert all(r["s"] == jump(r["k"] % 2**64, 40) and r["o"] == 0 for r in got)
    out = sharding.assign_shards(docs, 40).collect()
    by_id, slots = {r[0]: r[1] for r in rows}, {}
    for r in out:
        text = by_id[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 16 and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert r["grown_shard"] in (r["shard"], 40) and r["shard"] == jump(r["doc_id"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(empty, 40).count() == 0


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(400)]
    vectors += [(401, None), (402, [float("nan")] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("inf")] * 6), (405, [1.0]), (420, [2.0]), (5, [0.5] * 6), (None, [1.0] * 6), (440, [1e300] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({k: F.lit(v) for k, v in ODD.items()})
    whole = [(i, [int(min(max(np.floor(64 * x), -(2**63)), 2**63 - 1)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, u)))), i) for i, u in whole if i != q and len(u) == len(v))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_token_counts(spark, docs, rows, empty):
    with open(VOCABULARY, "rb") as f:
        encode = token_counts.encoding_of(f.read()).encode_ordinary
    lengths = [len(encode(r[1] or "")) for r in rows]
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(docs, VOCABULARY)).cache()
    assert sums.agg(F.sum("n_docs")).first()[0] == len(rows)
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["docs_upto"], r["truncated_total"], r["tokens_longer"]) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths), sum(x for x in lengths if x > n))
    for r in token_counts.at_limit(sums, [0, 7, 100, 10**6]).collect():
        assert r["truncated_total"] == sum(min(x, r["limit"]) for x in lengths)
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[(len(lengths) - 1) // 2], 1.0: max(lengths)}
    assert token_counts.with_suffix_sums(token_counts.length_histogram(empty, VOCABULARY)).count() == 0


def test_warc_round_trip(spark):
    page = "<html><head><title>A &amp; B</title><script>x='</p>'</script></head><body><p>One&nbsp;<b>two</b><!-- no --><p>three <br>fo< ur <script>gone"
    pages = spark.createDataFrame([(1, "http://a/?x=1", page), (1, "http://a/?x=1", page), (2, None, None), (3, "http://b", "")], "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in ODD.items()})
    got = warc.derivatives(warc.responses_of(pages)).collect()
    assert len(got) == 8
    for r in got:
        ((headers, block),) = warc.parse(bytes(r["record"]))
        assert block == bytes(r["block"]) and headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Block-Digest"] == warc.sha1(block) and int(headers["Content-Length"]) == len(block)
    one = {r["warc_type"]: bytes(r["block"]).decode() for r in got if r["page_id"] == 1}
    assert one["conversion"] == "One two\nthree\nfo< ur" and "title: A & B" in one["metadata"]
    assert {r["source_payload_digest"] for r in got if r["page_id"] == 1} == {warc.sha1(page.encode())}
    assert warc.plain_text("<b" * 50_000)[1] and warc.plain_text("<script>" * 50_000) == ("", "")
    assert warc.derivatives(warc.responses_of(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "page, title, text",
    [
        ("<html><head><title>x</title><p>whole text", "x", "whole text"), ("<head><title>t</title><header>in</header><p>rest", "t", "in\nrest"),
        ("<head><meta a>plain", "", "plain"), ("<head><script>'</scripty><p>'</script></head ><p>q", "", "q"), ("a<svg>b<p>c", "", "a\nb\nc"),
        ("a<select><option>1<iframe>c", "", "a\n1\nc"), ("a<svg>b</svg>c<script>d<p>e", "", "a\nc"),
    ],
)
def test_open_elements_keep_the_rest(page, title, text):
    assert warc.plain_text(page) == (title, text)


@pytest.fixture(scope="module")
def sf(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")}


@pytest.mark.parametrize("module, label, cut", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_labels(spark, sf, docs, empty, module, label, cut):
    held = crc_mod("doc_id", 5) == 0
    model = module.train(sf["documents"], sf["labels"], label, ~held)
    own = sf["labels"].where(held & F.col(label).isNotNull())
    both = module.score(sf["documents"].join(own.select("doc_id", label), "doc_id"), model).select(label, "score").collect()
    pos, neg = ([r["score"] for r in both if r[label] == x] for x in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95 and np.mean([s < 0.5 for s in (neg if label == "toxic" else [1 - p for p in pos])]) > 0.95
    odd = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and len(odd) == docs.select("doc_id").distinct().count()
    assert module.score(empty, model).count() == 0
    blank = module.train(sf["documents"], sf["labels"].limit(0), label, ~held)
    assert module.score(docs, blank).where("score is null").count() == 0


def test_languages(spark, sf, docs, empty):
    held = crc_mod("doc_id", 4) == 2
    model = language.train(sf["documents"], ~held, sample=300)
    got = language.predict(sf["documents"].where(held).select("doc_id", "text", "lang"), model)
    assert got.where("lang = lang_pred").count() > 0.98 * got.count()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert {odd[i] for i in (1000, 1001, 1002, 1003)} == {("und", 0.0)} and odd[1004][0] in model.languages
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.train(empty, ~held)).collect()} == {"und"}
