"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ODD

#: Bits of an n-gram's bucket, its lengths, and the most documents per language to learn from.
BITS, LENGTHS, SAMPLE = 16, (1, 2, 3, 4), 2_000
#: The most cells of the broadcast matrix (64 MB); more languages get fewer buckets.
CELLS = 1 << 24
#: Characters of a text that are looked at at once.
PIECE = 1 << 18

_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per process."""
    if not _table:
        _table.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _table[0]


def buckets(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """A bucket per character n-gram of the lower-cased letters, one blank between words; nothing without a letter.

    The text is read in pieces; each gives the n-grams that end in it, so that
    what is held doesn't grow with the text.
    """
    held = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", errors="replace"), np.uint32)
        letter = letters()[points]
        new = np.where(letter, points, np.uint32(32))[letter | np.concatenate([[held[-1] != 32], letter[:-1]])]
        both = np.concatenate([held, new])
        if at + PIECE >= len(text) and both[-1] != 32:
            both = np.append(both, np.uint32(32))
        if len(both) > len(held):
            yield _grams(both, len(held), bits)
            held = both[1 - max(LENGTHS) :]


def _grams(points: np.ndarray, old: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams that end behind the first ``old`` points."""
    points = points.astype(np.uint64) * ODD[0]
    found, gram = [], points
    for n in range(1, max(LENGTHS) + 1):
        if n > 1:
            gram = gram[:-1] * ODD[1] + points[n - 1 :]
        if n in LENGTHS:
            mixed = (gram[max(old - n + 1, 0) :] + np.uint64(n)) * ODD[2]
            found.append(((mixed ^ (mixed >> np.uint64(31))) * ODD[3] >> np.uint64(64 - bits)).astype(np.uint32))
    return np.concatenate(found)


@dataclass
class Model:
    """Languages in order, log prior, and log probability by bucket and language."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray
    bits: int


def train(documents: DataFrame, admitted: Column, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Count n-grams of about ``sample`` admitted documents per language, hardly ever more.

    A language of more documents than that gives those whose hash of key and
    text lies below the share wanted (expected: four standard deviations less
    than ``sample``), so that nothing is ranked or joined.  The prior is the
    share of all admitted documents.  Executors count whole texts and add the
    counts up task by task; the driver gets one row of counts per language.
    Null languages and texts teach nothing.  Repeated rows count once a task.
    """
    labelled = documents.where(admitted & F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    names = sorted(totals)
    if not names:
        return Model([], np.zeros(0, np.float32), np.zeros((1 << BITS, 0), np.float32), BITS)
    bits = min(BITS, int(np.log2(CELLS // len(names))))
    wanted = max(1.0, sample - 4 * sample**0.5)
    limits = [(n, 2**63 - 1 if totals[n] <= sample else int(-(2**63) + wanted / totals[n] * 2**64)) for n in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: set[int] = set()
        for batch in batches:
            for name, value, h in zip(batch.column("lang"), batch.column("text"), batch.column("h").to_pylist(), strict=True):
                name = name.as_py()
                for own in buckets(value.as_py(), bits) if h not in seen else ():
                    sums.setdefault(name, np.zeros(1 << bits, np.int64))
                    sums[name] += np.bincount(own, minlength=1 << bits)
                seen.add(h)
        yield packed(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sums[row["lang"]] = sums.get(row["lang"], 0) + np.frombuffer(row["counts"], np.int64)
        yield packed(sums)

    def packed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    hashed = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    # A row per language.
    shares = F.broadcast(documents.sparkSession.createDataFrame(limits, "lang string, most long"))
    chosen = hashed.join(shares, "lang").where("h <= most").select("lang", "text", "h")
    schema = "lang string, counts binary"
    sums = chosen.mapInArrow(count, schema).repartition(min(len(names), 64), "lang").mapInArrow(add, schema)
    table, prior = np.full((1 << bits, len(names)), smoothing), np.array([totals[n] + 1.0 for n in names])
    for row in sums.toLocalIterator():
        table[:, names.index(row["lang"])] += np.frombuffer(row["counts"], np.int64)
    return Model(names, np.log(prior / prior.sum()).astype(np.float32), np.log(table / table.sum(axis=0)).astype(np.float32), bits)


def predict(documents: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``documents`` but ``text``, the language and its posterior probability.

    Whole texts, one pass, no shuffle.  The matrix is broadcast; its size is
    bounded by ``CELLS``.  ``und`` with score 0 if the text is null or has no
    letter, or nothing was learned; ties go to the first language by name;
    equal texts get equal rows; an empty table gives no rows.  Columns named
    ``out`` and ``score`` are replaced, others stay.  A long text is read in
    pieces of ``PIECE`` characters.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.table, model.bits))
    rest = [c for c in documents.columns if c not in (text, out, score)]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, table, bits = shared.value
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(text):
                logits = None
                for own in buckets(value.as_py() or "", bits) if names else ():
                    for at in range(0, len(own), 1 << 16):  # bounds what is gathered at once
                        logits = (prior if logits is None else logits) + table[own[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                if logits is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(logits))
                langs.append(names[best])
                scores.append(float(1 / np.exp(logits - logits[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, out, score])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.select(*rest, text).mapInArrow(predicted, f"{schema}, `{out}` string, `{score}` double")
