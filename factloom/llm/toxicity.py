"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ODD, PLAIN, WordHashes, column_bytes, labelled_sample, mix, sampled_features, slices, word_hashes

#: Bits of a feature's bucket.
BITS = 20
#: The most labelled documents to learn from, and bytes of their features.
SAMPLE, SAMPLE_BYTES = 8_000, 128 << 20


def buckets_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Buckets of the words, word pairs and pairs with a gap of one or two words."""
    h = word_hashes(text.translate(PLAIN), hashes)
    grams = [h, *(h[:-gap] * ODD[2 * gap] + h[gap:] * ODD[2 * gap + 1] for gap in (1, 2, 3) if len(h) > gap)]
    return (mix(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.uint32)


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The distinct buckets of a text."""
    return np.unique(buckets_of(text, hashes))


@dataclass
class Ftrl:
    """McMahan's follow-the-regularised-leader with a rate per coordinate and L1.

    ``l1`` grows with the number of positive rows, one for each ``per_l1`` of
    them, from ``least_l1`` to ``most_l1``; each positive row counts ``weight`` times.
    """

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    least_l1: float = 3.0
    most_l1: float = 8.0
    per_l1: float = 40.0
    l2: float = 1.0
    weight: float = 3.0

    def fit(self, rows: list[np.ndarray], labels: list[int], epochs: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
        """Buckets with a weight, their weights, and the bias."""
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bias, bias_n = 0.0, 1.0
        self.l1 = float(np.clip(sum(labels) / self.per_l1, self.least_l1, self.most_l1))
        for _ in range(epochs):
            for x, y in zip(rows, labels, strict=True):
                zi, ni = z[x], n[x]
                w = self.weights(zi, ni)
                p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
                g = (p - y) * (self.weight if y else 1.0)
                root = np.sqrt(ni + g * g)
                z[x] = zi + g - (root - np.sqrt(ni)) / self.alpha * w
                n[x] = ni + g * g
                bias_n += g * g
                bias -= 0.5 * g / np.sqrt(bias_n)
        w = self.weights(z, n)
        used = np.flatnonzero(w)
        return used.astype(np.uint32), w[used].astype(np.float32), float(bias)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def train(documents: DataFrame, labels: DataFrame, label: str, admitted: Column, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``sample`` labelled documents that ``admitted`` lets in.

    Executors turn whole texts into buckets; the driver holds only those, at
    most ``sample`` rows and ``SAMPLE_BYTES``, and learns in the order of the
    ids' hashes, so that reruns agree.  Repeated rows of an id count once; an
    id with several texts counts with one of them; null texts teach nothing.
    Without labels the bias alone decides (score 0.5).
    """

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            rows = [features(text, hashes).tobytes() for text in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    known = labelled_sample(documents, labels, label, admitted, sample).select("doc_id", "y", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    got = [(r["y"], np.frombuffer(r["x"], np.uint32)) for r in sampled_features(known.mapInArrow(buckets, f"doc_id {kind}, y int, x binary"), SAMPLE_BYTES)]
    return Ftrl().fit([x for _, x in got], [y for y, _ in got])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """All columns of ``documents`` (``text`` if ``keep_text``), and ``out``: the probability of label 1.

    Whole texts, one pass, no shuffle.  The weights are sparse and bounded by
    the number of buckets, 4 MB unpacked.  Null and empty texts get the bias'
    score; equal texts get equal scores; an empty table gives no rows.  A
    column named ``out`` is replaced; any other column stays as it is.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in documents.columns if c != out and (keep_text or c != text)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[used] = weights
        hashes = WordHashes()
        for batch in slices(batches):
            scores = np.full(batch.num_rows, bias)
            for i, value in enumerate(column_bytes(batch, text)):
                if value:
                    x = buckets_of(value, hashes)
                    x = np.unique(x[dense[x] != 0])
                    scores[i] += dense[x].astype(np.float64).sum()
            scores = 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(scores)], [*rest, out])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.select(*dict.fromkeys([*rest, text])).mapInArrow(scored, f"{schema}, `{out}` double")
