"""Exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize, running_sum

#: Fixed value: the published split pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[int, object] = {}


def encoding_of(ranks_file: bytes, pattern: str = PATTERN):
    """The tiktoken encoding of a rank file's bytes; made once per process."""
    import tiktoken

    key = hash((ranks_file, pattern))
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def length_histogram(documents: DataFrame, vocabulary: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``n_tokens, n_docs`` for each encoded length that occurs.

    The vocabulary, a rank file at the path ``vocabulary``, is read by the
    driver and sent to the executors (its size, about a megabyte, doesn't
    depend on the documents).  Each task sums its own documents, so at most one
    row per length and task is shuffled.  Null and empty texts have 0 tokens;
    strings of special tokens are ordinary text; an empty table gives no rows;
    other columns play no part.
    """
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoding_of(ranks.value, pattern).encode_ordinary, Counter()
        for batch in batches:
            for value in batch.column(0):
                lengths[len(encode(value.as_py() or ""))] += 1
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(lengths.keys(), pa.int64()), "n_docs": pa.array(lengths.values(), pa.int64())})

    parts = documents.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").cast("long").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs, with what a context limit of L gives.

    ``docs_longer`` and ``tokens_longer``: documents longer than L and their
    tokens; ``docs_upto`` and ``tokens_upto``: the others'; ``truncated_total``:
    tokens left if each document is cut to L; ``padded_total``: tokens if the
    documents up to L are padded to L; ``quantile``: share of documents up to
    L.  A limit between two lengths follows from the lower one (``at_limit``).
    Suffix sums run in blocks of lengths, not in one task.  The histogram is
    written once, so that the texts are encoded once.
    """
    histogram = materialize(histogram, "histogram")
    docs, tokens = F.col("n_docs"), F.col("n_docs") * F.col("n_tokens")
    sums = running_sum(histogram, "n_tokens", "n_docs", "docs_from", descending=True)
    sums = running_sum(sums.withColumn("n_tokens_all", tokens), "n_tokens", "n_tokens_all", "tokens_from", descending=True)
    total = histogram.agg(F.coalesce(F.sum(docs), F.lit(0)).alias("docs_total"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens_total"))
    sums = sums.join(F.broadcast(total))  # the totals are one row
    longer_docs, longer_tokens = F.col("docs_from") - docs, F.col("tokens_from") - F.col("n_tokens_all")
    upto_docs, upto_tokens = F.col("docs_total") - longer_docs, F.col("tokens_total") - longer_tokens
    return sums.select(
        "n_tokens", "n_docs",
        longer_docs.cast("long").alias("docs_longer"), longer_tokens.cast("long").alias("tokens_longer"),
        upto_docs.cast("long").alias("docs_upto"), upto_tokens.cast("long").alias("tokens_upto"),
        (upto_tokens + longer_docs * F.col("n_tokens")).cast("long").alias("truncated_total"),
        (upto_docs * F.col("n_tokens")).cast("long").alias("padded_total"),
        (upto_docs / F.col("docs_total")).alias("quantile"),
    )


def at_limit(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_upto, tokens_upto, truncated_total`` for any context limits.

    Each answer comes from the largest length up to the limit: documents longer
    than that length are longer than the limit, too.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    total = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_total"))
    best = asked.join(sums, F.col("n_tokens") <= F.col("limit"), "left").groupBy("limit").agg(F.max_by(F.struct("docs_upto", "tokens_upto", "docs_longer"), "n_tokens").alias("b"))
    longer = F.coalesce("b.docs_longer", "docs_total")
    kept = F.coalesce("b.tokens_upto", F.lit(0))
    return best.join(F.broadcast(total)).select("limit", F.coalesce("b.docs_upto", F.lit(0)).alias("docs_upto"), kept.alias("tokens_upto"), (kept + longer * F.col("limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least that share of documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(sums, F.col("quantile") >= F.col("share") - F.lit(1e-15), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
