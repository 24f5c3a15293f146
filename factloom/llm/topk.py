"""Exact top-k search by Fagin's threshold algorithm over sorted lists, in blocks.

Candidates lie in blocks.  Within a block every dimension has a list of the
block's vectors sorted by that component.  A query walks its lists from the
end that its component's sign favours, scores each newly met vector in full,
and stops at the depth where the bound, the sum over the dimensions of query
component times list value, is below its kth best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 2048, 2048
#: Blocks of candidates and of queries that one task meets.
PER_TASK = (8, 32)
#: Products are exact in double precision below this.
EXACT = 2.0**53

PACKED = "dim int, kind string, ids binary, data binary"
#: Query blocks whose best are held by a task at once.
HELD = 64


def narrowed(data: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes that hold them."""
    low, high = int(data.min(initial=0)), int(data.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return data.astype(kind)


def largest(data: np.ndarray) -> float:
    """The largest absolute value; the least 64-bit integer has none of its own type."""
    return max(-float(data.min(initial=0)), float(data.max(initial=0)))


def pack(rows: int):
    """Pack batches of ``id, v`` into blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def block(dim: int, most: int) -> pa.RecordBatch:
            ids, data = np.concatenate(held[dim][0]), np.concatenate(held[dim][1])
            held[dim] = ([ids[most:]], [data[most:]])
            own = narrowed(data[:most])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "kind": [own.dtype.str], "ids": pa.array([ids[:most].tobytes()], pa.binary()), "data": pa.array([own.tobytes()], pa.binary())})

        for batch in batches:
            vectors = batch.column("v")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, ids = vectors.flatten().to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
            for dim in map(int, np.unique(lengths)):
                own = np.flatnonzero(lengths == dim)
                data = flat[starts[own][:, None] + np.arange(dim)[None, :]]
                a, b = held.setdefault(dim, ([], []))
                a.append(ids[own])
                b.append(data.astype(np.int64).reshape(len(own), dim))
                while sum(map(len, held[dim][0])) >= rows:
                    yield block(dim, rows)
        for dim in held:
            if sum(map(len, held[dim][0])):
                yield block(dim, rows)

    return run


def threshold_search(ids: np.ndarray, data: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top ``k`` of one block for each query: query position, candidate position, score.

    ``least``: per query a score that ``k`` other candidates reach already;
    what lies below it may stay out.
    """
    n, dim = data.shape
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    if not n:
        return out[0]
    if largest(queries) * largest(data) * max(dim, 1) >= EXACT:
        return _search_wide(ids, data, q_ids, queries, k)
    least = np.full(len(q_ids), -np.inf) if least is None else least
    values, asked = data.astype(np.float64), queries.astype(np.float64)
    order = np.argsort(data, axis=0, kind="stable").T  # per dimension, ascending
    each = np.arange(dim)
    for at in range(0, len(q_ids), 256):
        q, own, known = asked[at : at + 256], q_ids[at : at + 256], least[at : at + 256]
        mine = ids[None, :] == own[:, None]
        active = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        met = np.full((len(q), n), -np.inf)
        depth, step = 0, max(k, n // 32)
        while len(active):
            to = min(n, depth + step)
            if to == n:
                met[active] = q[active] @ values.T
                break
            low, high = order[:, depth:to], order[:, n - to : n - depth]
            for d in range(dim):  # a component of 0 needs no list
                seen[np.ix_(active[q[active, d] > 0], high[d])] = True
                seen[np.ix_(active[q[active, d] < 0], low[d])] = True
            depth, step = to, step * 2
            new = np.flatnonzero(seen[active].any(axis=0))
            # Random access: full scores of the vectors met.
            cells = np.ix_(active, new)
            met[cells] = np.where(seen[cells], q[active] @ values[new].T, met[cells])
            top, bottom = values[order[:, n - depth], each], values[order[:, depth - 1], each]
            bound = (np.maximum(q[active], 0) * top + np.minimum(q[active], 0) * bottom).sum(axis=1)
            scored = np.where(mine[active], -np.inf, met[active])
            kth = np.partition(scored, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
            # A vector not met yet may tie at the bound and have a smaller id: stop only below.
            active = active[~(bound < np.maximum(kth, known[active]))]
        met[mine] = -np.inf
        for i in range(len(q)):
            took = np.flatnonzero((met[i] > -np.inf) & (met[i] >= known[i]))
            if len(took) > k:
                took = took[met[i][took] >= np.partition(met[i][took], len(took) - k)[len(took) - k]]
            took = took[np.lexsort((ids[took], -met[i][took]))[:k]]
            out.append((np.full(len(took), at + i), took, met[i][took].astype(np.int64)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _search_wide(ids: np.ndarray, data: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in Python's integers, for components too large for doubles; scores stop at the 64-bit bounds."""
    out = []
    values = data.astype(object)
    for i, (own, q) in enumerate(zip(q_ids, queries.astype(object), strict=True)):
        scores = [max(-(2**63), min(2**63 - 1, int(x))) for x in (values @ q if data.shape[1] else [0] * len(ids))]
        out += [(i, j, scores[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != own), key=lambda j: (-scores[j], ids[j]))[:k]]
    return tuple(np.array([x[c] for x in out], np.int64) for c in range(3))


class Best:
    """The best ``k`` so far of each query of a block: positions of queries, ids and scores."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.which = self.ids = self.scores = np.zeros(0, np.int64)
        self.least = np.full(len(q_ids), -np.inf)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        which, ids, scores = (np.concatenate(x) for x in ((self.which, which), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, ~scores, which))  # ~x falls as x rises, at either bound
        which, ids, scores = which[order], ids[order], scores[order]
        first = np.searchsorted(which, which)
        place = np.arange(len(which)) - first
        kept = place < self.k
        self.which, self.ids, self.scores = which[kept], ids[kept], scores[kept]
        full = self.which[place[kept] == self.k - 1]
        self.least[full] = self.scores[place[kept] == self.k - 1].astype(np.float64)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": self.q_ids[self.which], "vec_id": self.ids, "score": self.scores})


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds null or a non-finite value."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~odd, F.transform(wide, lambda x: F.floor(x * F.lit(scale)).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each query row.

    Score: inner product of the quantised vectors; ties to the smaller id.
    Vectors that are null, or hold null or a non-finite component, and rows
    with a null id take no part.  Vectors of unlike lengths never meet; an
    empty vector scores 0 with its like.  "Other rows" are those with another
    id, so repeated rows of the query's id stay out, while repeated candidates
    each count.  Query rows of one id count once if their vectors are equal;
    other vectors of that id join its one ranking, each with its own scores.
    Fewer candidates than ``k`` are all returned; an empty table gives no rows.
    Other columns play no part.  Components beyond 64 bits stop at the bounds.

    Candidates and queries are packed into blocks without a shuffle; each
    query block meets each candidate block once, and only the best ``k`` of a
    query in a task go on.  Nothing is broadcast or collected.
    """
    whole = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("v"), is_query.alias("_query")).where("id is not null and v is not null")
    candidates = materialize(whole.select("id", "v").mapInArrow(pack(CANDIDATES), PACKED), "candidates")
    queries = whole.where("_query").select("id", "v").distinct().mapInArrow(pack(QUERIES), PACKED)
    queries = materialize(queries, "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The kth best of a query so far bounds what later blocks of candidates must give.
        held: dict[bytes, Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                data, q = (np.frombuffer(row[c], row[t]).astype(np.int64).reshape(len(n), row["dim"]) for c, t, n in (("data", "kind", ids), ("q_data", "q_kind", q_ids)))
                name = row["q_ids"] + row["q_data"]
                if name not in held:
                    if len(held) >= HELD:
                        yield held.pop(next(iter(held))).rows()
                    held[name] = Best(q_ids, k)
                which, found, score = threshold_search(ids, data, q_ids, q, k, held[name].least)
                held[name].add(which, ids[found], score)
        for best in held.values():
            yield best.rows()

    # A grid: each candidate block goes to all columns, each query block to all rows, so that each pair meets once.
    n, m = candidates.count(), queries.count()
    columns = max(1, -(-m // PER_TASK[1]))
    rows = max(1, -(-n // PER_TASK[0]), min(n, -(-24 // columns)))
    left = candidates.withColumn("_r", F.pmod(F.xxhash64("ids"), F.lit(rows))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = queries.select("dim", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"), F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int").alias("_c"))
    right = right.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    pairs = left.join(right.hint("shuffle_hash"), ["_r", "_c", "dim"])
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
