"""Helpers that several operators share: shared storage, word hashing, samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factloom.storage import BROADCAST_ROWS, drop, few, materialize, shared_dir, small  # noqa: F401


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def repeated(df: DataFrame, times: str, piece: int = 1 << 16) -> DataFrame:
    """Each row as often as its column ``times``, which goes; no array is longer than ``piece``."""
    (at,) = fresh(df.columns, "at")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / piece).cast("long"))
    cut = df.where(F.col(times) > 0).withColumn(at, F.explode(pieces))
    left = F.least(F.col(times).cast("long") - F.col(at) * piece, F.lit(piece).cast("long"))
    return cut.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), left))).drop(at, times)


def running_sum(df: DataFrame, key: str, value: str, out: str, by: list[str] = (), shift: int = 10, descending: bool = False) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of a group up to ``key`` (inclusive).

    ``key`` is a non-negative integer, unique within ``by``.  Two levels: sums
    of blocks of ``2**shift`` keys are accumulated first, then the rows within
    each block, so no task sees all rows of a group.
    """
    by = list(by)
    block = f"_{out}_block"
    order = (lambda c: F.col(c).desc()) if descending else F.col
    df = df.withColumn(block, F.shiftright(F.col(key), shift))
    upto = Window.partitionBy(*by or [F.lit(0)]).orderBy(order(block)).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, block).agg(F.sum(value).alias("_b")).withColumn("_base", F.coalesce(F.sum("_b").over(upto), F.lit(0))).drop("_b")
    within = Window.partitionBy(*by, block).orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    join = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, block]]
    both = df.alias("l").join(base.alias("r"), join)
    return both.select("l.*", "_base").withColumn(out, F.col("_base") + F.sum(value).over(within)).drop("_base", block)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


class WordHashes(dict):
    """Hashes of byte words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes of a text that are cut into words at once, so that a very long text holds no list of all its words.
TEXT_PIECE = 1 << 22
_space = re.compile(rb"[ \t\n\x0b\x0c\r]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists: runs of bytes other than space and U+0009 to U+000D."""
    at = 0
    while len(text) - at > TEXT_PIECE:
        found = _space.search(text, at + TEXT_PIECE)
        if not found:
            break
        yield text[at : found.start()].split()
        at = found.start()
    yield (text[at:] if at else text).split()


def word_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The hash of each word, in order."""
    found = [hashes.of(words) for words in word_lists(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


#: Odd multipliers for combining word hashes by position.
ODD = np.array([xxhash.xxh3_64_intdigest(b"odd", seed=i) | 1 for i in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * ODD[60]
    h = (h ^ (h >> np.uint64(29))) * ODD[61]
    return h ^ (h >> np.uint64(32))


#: ASCII letters and digits stay (in lower case), other ASCII becomes a space, other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def column_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, row by row, without decoding them."""
    column = batch.column(name)
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, to bound what is held of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of the Arrow batches that Python gets in ``in_small_batches``, and Spark's setting for them.
BATCH_BYTES, BATCH = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator(df, ...)``, where what it writes on the way passes to Python in batches of ``BATCH_BYTES``: rows of whole texts or sets are wide."""

    @wraps(operator)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(BATCH)
        conf.set(BATCH, BATCH_BYTES)
        try:
            return operator(df, *args, **named)
        finally:
            conf.set(BATCH, before)

    return run


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """``doc_id, text, y`` (and ``n_chars`` if there) of at most ``rows`` labelled documents.

    The bound is on distinct documents: those with the least hash of their id
    among the rows of ``labels`` that ``train`` admits and whose label is 0 or
    1.  Repeated label rows count once (the larger label); a document without
    text stays out.  The sample's ids are broadcast, being at most ``rows``.
    """
    own = labels.where(train & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select("doc_id", "text", *[c for c in documents.columns if c == "n_chars"]).where(F.col("text").isNotNull()).join(F.broadcast(own), "doc_id")


def sampled_features(made: DataFrame, most: int) -> Iterator[Row]:
    """Rows ``h, doc_id, y, x`` of ``made(doc_id, y, x)`` by hash of the id, one per id, partition by partition.

    Two bounds hold for the driver: the sample's rows, and ``most`` bytes of
    features: rows beyond that, in the order of the hashes, stay out.  Only the
    sizes, a number a row, are gathered before.
    """
    rows = made.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "r.y", "r.x")
    rows = materialize(rows, "sample")
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in rows.select("h", "doc_id", F.octet_length("x").alias("n")).collect())
    total, last = 0, None
    for h, _, n in sizes:
        total += n
        if total > most:
            break
        last = h
    if last is None:
        return iter(())
    return iter(sorted(rows.where(F.col("h") <= last).toLocalIterator(), key=lambda r: (r["h"], r["doc_id"])))


#: Edges that a task contracts at once, and up to which one task settles them.
PIECE_EDGES = 500_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``u, v`` and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends, 2)
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[parent]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # A root hooks onto the least root next to it; all then point to their roots.
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u, v`` of other edges' components: each node's to the least node that it reaches by the edges held at once."""
    held, n = [], 0

    def stars() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if held:
            u, v = least_reachable(*map(np.concatenate, zip(*held, strict=True)))
            yield u[u != v], v[u != v]

    def rows(found) -> Iterator[pa.RecordBatch]:
        for u, v in found:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
        if n > PIECE_EDGES:
            held = list(stars())
            n = sum(len(u) for u, _ in held)
            if n > PIECE_EDGES // 2:
                yield from rows(held)
                held, n = [], 0
    yield from rows(stars())


def settled_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of all nodes of the edges ``u, v`` of one task."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, least = least_reachable(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``node, component`` per node.

    ``component`` is the least node reachable.  Each task first contracts its
    own edges to stars.  If at most ``PIECE_EDGES`` are left, one task contracts
    those, and all is settled; more go through alternating large-star and
    small-star rounds, each an aggregate and a join, written to the shared
    folder; the number of rounds grows with the logarithm of the diameter.
    """
    edges = edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    edges = materialize(edges.mapInArrow(contracted, "u long, v long"), "edges")
    if edges.count() <= PIECE_EDGES:
        return materialize(edges.coalesce(1).mapInArrow(settled_nodes, "node long, component long"), "components")
    edges = materialize(edges.distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        after = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(after, "edges")
        if star(after):
            edges = after
            break
        drop(edges)
        edges = after
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def star(edges: DataFrame) -> bool:
    """Whether each node has one parent and no parent has a parent: the components are settled."""
    twice = edges.groupBy("u").count().where("count > 1").limit(1)
    deep = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
    return not twice.select("u").unionByName(deep.select("u")).take(1)
