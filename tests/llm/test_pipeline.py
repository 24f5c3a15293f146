"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import toxicity
from factloom.llm.common import crc_mod, materialize
from tests.llm.test_edges import brute_groups, brute_targets, toxic_buckets
from tests.llm.test_operators import blanks_apart, brute_components, brute_contamination, jump

FOLDER = "/root/testdata/sf0.001"


def not_toxic(spark, docs, labels, rows):
    """Rows whose sum of weights, bucket by bucket, stays below the bound."""
    used, weights, bias = toxicity.train(docs, labels, "toxic", crc_mod("doc_id", 5) != 0)
    weight = dict(zip(used.tolist(), weights.tolist(), strict=True))
    return [i for i, t, _ in rows if 1 / (1 + math.exp(-(bias + sum(weight.get(b, 0.0) for b in toxic_buckets(t or ""))))) < 0.5]


def mixed(rows):
    """Copies of each document: sorted by hash, budgets filled from the least."""
    sizes, target = brute_targets(rows)
    out = Counter()
    for source, size in sizes.items():
        whole = min(3, math.floor(target[source] / size + 1e-12)) if size else 0
        rest = max(target[source] - whole * size, 0.0) if size else 0.0
        done = False
        for _, _, doc, n in sorted((hashlib.md5(str(i).encode()).hexdigest()[:12], t or "", i, len(blanks_apart(t))) for i, t, s in rows if s == source):
            more = not done and (n <= rest or 2 * math.floor(rest) >= n and rest >= 1)
            done = done or n > rest
            rest -= n if not done else 0
            out[doc] += whole + more
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        columns, earlier, docs = docs.columns, docs, materialize(stage(spark, docs, FOLDER), name)
        after = [r[0] for r in docs.select("doc_id").collect()]
        kept[name] = after
        if name == "toxicity":
            assert sorted(after) == sorted(not_toxic(spark, earlier, labels, before))
        elif name == "jaccard_join":
            assert sorted(after) == sorted(i for i, (_, c) in brute_components(before).items() if i == c)
        elif name == "decontamination":
            assert sorted(after) == sorted(i for i, v in brute_contamination(before, benchmark).items() if not v[-1])
        elif name == "mixing":
            assert Counter(after) == +mixed(before)
        elif name == "sharding":
            assert sorted(after) == sorted(i for i, *_ in before)
            assert all(r["shard"] == jump(r["doc_id"], 40) for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    assert len(kept["toxicity"]) > 150 and kept["sharding"]


@pytest.fixture
def folder(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    other = " ".join(f"q{i}" for i in range(20))
    rows = [(1, other, "en", "a", 5), (2, other, "en", "a", 5), (None, other, "en", "b", 5), (None, passage, "en", "b", 5), (3, passage, "en", "a", 5), (3, "clean words of the same id as a passage", "en", "a", 5)]
    rows += [(4, None, None, None, None), (5, "", "en", "a", 0), (6, "ok", "en", None, 2), (6, "ok", "en", None, 2)] + [(i, f"own text {i}", "en", "b", 4) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("?") for c in ("score", "h", "own_id", "d", "g", "shard", "slot")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages_decide_odd_rows(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    near = corpus_pipeline.drop_near_copies(spark, docs, path)
    assert near.columns == docs.columns
    found = sorted({i for i, *_ in rows if i is not None})
    groups = {i: c for i, _, c in brute_groups([(i, t) for i, t, *_ in rows])}
    assert Counter(r["doc_id"] for r in near.collect()) == Counter({None: 2} | {i: 1 for i in found if groups[i] == i})
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, path).collect()]
    assert Counter(clean) == Counter((i, t) for i, t, *_ in rows if t is None or not t.startswith("p0 "))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, path)
        assert got.count() >= 0 and (name == "sharding" or got.columns == docs.columns)
        assert stage(spark, docs.limit(0), path).count() == 0
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 0 and {"shard", "slot"} <= set(out.columns)
