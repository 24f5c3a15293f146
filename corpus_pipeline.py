"""A corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, jaccard, mixing, sharding, toxicity
from factloom.llm.common import crc_mod, few, fresh, materialize, small

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from this stage's labelled documents.

    Decides row by row, by the text alone: null and empty texts have the score of the bias.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, "toxic", crc_mod("doc_id", 5) != 0)
    (score,) = fresh(docs.columns, "score")
    return toxicity.score(docs, model, out=score, keep_text=True).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that Jaccard links join.

    Of the rows of one id, which are one document, the least row stays.  Rows
    of a null id are linked with nothing and stay.  Documents without words
    are no copies of one another and stay.
    """
    n_docs = docs.count()
    found = materialize(few(jaccard.jaccard_components(docs), n_docs), "components")
    gone = materialize(few(found.where("doc_id <> component_id").select("doc_id").distinct(), n_docs), "copies")
    rest = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return rest
    again = small(again, n)
    once = rest.join(again, "doc_id", "left_semi").select(*docs.columns).groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("d")).select("d.*")
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth.

    Decides by id and text: of rows of one id, or of none, only those whose own text is contaminated go.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, benchmark, text_hash="h")
    gone = materialize(found.where("contaminated").select(F.col("doc_id").alias("own_id"), "h").distinct(), "contaminated")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.own_id")) & F.xxhash64("d.text").eqNullSafe(F.col("g.h"))
    return docs.alias("d").join(small(gone, gone.count()).alias("g"), same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; copies of one row are told apart by number."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with their shard and slot."""
    return sharding.assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The trained first stage is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
