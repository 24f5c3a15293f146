"""Quality by a factorisation machine over hashed words, structure and metadata.

score = w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2):
all pairwise interactions in time linear in the features of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import PLAIN, TEXT_PIECE, WordHashes, column_bytes, fresh, labelled_sample, mix, sampled_features, slices, word_hashes, word_lists

#: Bits of a word's bucket, and factors per feature.
BITS, FACTORS = 15, 8
#: The most labelled documents to learn from, and bytes of their features.
SAMPLE, SAMPLE_BYTES = 8_000, 128 << 20
#: Features of documents scored at once, beyond which a piece is closed.
PIECE = 1 << 18
#: Structure and metadata features, after the word buckets.
DENSE = 20

_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True
_punctuation = np.array([c < 128 and chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in range(256)])


def structure(text: bytes, n_chars: float) -> np.ndarray:
    """Statistics of the text's form, about 0 to 1 each; the last is metadata."""
    n = max(len(text), 1)
    each = np.frombuffer(text, np.uint8)
    counts = sum(np.bincount(each[at : at + TEXT_PIECE], minlength=256) for at in range(0, max(len(each), 1), TEXT_PIECE))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    distinct, sizes = set(), []
    for words in word_lists(text):
        distinct.update(words)
        sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
    lengths = np.concatenate(sizes)
    m = max(len(lengths), 1)
    known = lengths if len(lengths) else np.zeros(1, np.int64)
    punctuation = counts[_punctuation]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in full)
    return np.array(
        [
            np.log1p(n) / 12, np.log1p(len(lengths)) / 10, counts[_letters].sum() / n, counts[65:91].sum() / n, counts[48:58].sum() / n,
            counts[128:].sum() / n, punctuation.sum() / n * 4, punctuation.max() / n * 8, counts[32] / n * 3, counts[10] / n * 20,
            known.mean() / 12, known.std() / 8, min(known.max(), 200) / 50, len(distinct) / m, len(set(full)) / max(len(full), 1),
            ends / max(len(full), 1), min(n / max(len(lines), 1), 1000) / 500, counts[124] / n * 20, (counts[46] + counts[44]) / n * 20,
            np.log1p(max(n_chars, 0)) / 12,
        ],
        np.float32,
    )


def features(text: bytes, n_chars: float | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: distinct word buckets share a unit norm; then the statistics."""
    h = word_hashes(text.translate(PLAIN), hashes)
    buckets = np.unique((mix(h) >> np.uint64(64 - BITS)).astype(np.uint32))
    values = np.full(len(buckets), 1 / np.sqrt(max(len(buckets), 1)), np.float32)
    known = float(len(text) if n_chars is None else n_chars)
    dense = np.arange(1 << BITS, (1 << BITS) + DENSE, dtype=np.uint32)
    return np.concatenate([buckets, dense]), np.concatenate([values, np.clip(structure(text, known), 0, 4)])


@dataclass
class Machine:
    """Bias, weights and factors; 1.2 MB whatever the corpus."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents laid end to end, each beginning at ``starts``; also the factor sums."""
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, l2: float = 1e-5) -> Machine:
    """Adagrad over small batches, in a fixed pseudo-random order."""
    rng = np.random.default_rng(7)
    size = (1 << BITS) + DENSE
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    gw, gv, g0 = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            if not len(at):
                continue
            idx, val = (np.concatenate([rows[i][k] for i in at]) for k in (0, 1))
            lengths = np.array([len(rows[i][0]) for i in at])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            logits, sums = m.logits(idx, val, starts)
            error = (1 / (1 + np.exp(-np.clip(logits, -35, 35))) - labels[at]) / len(at)
            each = np.repeat(error, lengths).astype(np.float32) * val
            used, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, each, len(used)) + l2 * m.w[used]
            own = each[:, None] * (np.repeat(sums, lengths, axis=0) - m.v[idx] * val[:, None])
            dv = np.stack([np.bincount(where, own[:, f], len(used)) for f in range(FACTORS)], axis=1) + l2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += error.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            m.w0 -= rate * error.sum() / np.sqrt(g0)
    return m


def _metadata(documents: DataFrame, metadata: str | None, name: str) -> Column:
    known = metadata is not None and metadata in documents.columns
    return (F.col(metadata) if known else F.lit(None)).cast("double").alias(name)


def train(documents: DataFrame, labels: DataFrame, label: str, admitted: Column, metadata: str | None = "n_chars", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents that ``admitted`` lets in.

    Executors make the features of whole texts; the driver holds those of the
    sample only, ``SAMPLE_BYTES`` at most, and learns in the order of the ids'
    hashes, so that reruns agree.  Repeated rows of an id count once; an id with
    several texts counts with one of them; null texts teach nothing.  Without
    labels every score is 0.5.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            made = [features(t, n, hashes) for t, n in zip(column_bytes(batch, "text"), batch.column("known").to_pylist(), strict=True)]
            x = [i.astype(np.uint16).tobytes() + v[-DENSE:].tobytes() for i, v in ((i[:-DENSE], v) for i, v in made)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    known = labelled_sample(documents, labels, label, admitted, sample)
    kind = documents.schema["doc_id"].dataType.simpleString()
    made = known.select("doc_id", "y", "text", _metadata(known, metadata, "known")).mapInArrow(make, f"doc_id {kind}, y int, x binary")
    dense, parts, y = np.arange(1 << BITS, (1 << BITS) + DENSE, dtype=np.uint32), [], []
    for r in sampled_features(made, SAMPLE_BYTES):
        idx, stats = np.frombuffer(r["x"][: -4 * DENSE], np.uint16), np.frombuffer(r["x"][-4 * DENSE :], np.float32)
        parts.append((np.concatenate([idx.astype(np.uint32), dense]), np.concatenate([np.full(len(idx), 1 / np.sqrt(max(len(idx), 1)), np.float32), stats])))
        y.append(r["y"])
    return fit(parts, np.array(y, np.float32))


def score(documents: DataFrame, model: Machine, text: str = "text", metadata: str | None = "n_chars", out: str = "score") -> DataFrame:
    """All columns of ``documents`` but ``text``, and ``out``: the probability of label 1.

    Whole texts, one pass, no shuffle; the model is broadcast at a fixed size,
    and a task holds the features of 256 documents or of ``PIECE`` of them.  A
    null text counts as an empty one; where the metadata is null or absent the
    text's length stands in; equal texts with equal metadata get equal scores;
    an empty table gives no rows.  A column named ``out`` is replaced; any
    other column stays as it is.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))
    rest = [c for c in documents.columns if c not in (text, out)]
    (known,) = fresh([*documents.columns, out], "known")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = Machine(*shared.value), WordHashes()

        def logits(made: list) -> np.ndarray:
            starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in made])[:-1]])
            return m.logits(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), starts)[0].astype(np.float64)

        for batch in slices(batches, 256):
            made, held, found = [], 0, [np.zeros(0)]
            for t, n in zip(column_bytes(batch, text), batch.column(known).to_pylist(), strict=True):
                made.append(features(t or b"", n, hashes))
                held += len(made[-1][0])
                if held > PIECE:
                    found.append(logits(made))
                    made, held = [], 0
            if made:
                found.append(logits(made))
            scores = 1 / (1 + np.exp(-np.clip(np.concatenate(found), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(scores, pa.float64())], [*rest, out])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.select(*rest, text, _metadata(documents, metadata, known)).mapInArrow(scored, f"{schema}, `{out}` double")
