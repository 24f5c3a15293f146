"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersections.

A document's set holds the 64-bit hashes of its distinct word shingles.
Documents of one set become one node.  Two nodes can only reach the threshold
if they share a shingle among the first ``n - ceil(t n) + 1`` of each, in one
order of all shingles (the common ones last), so nodes meet on those.  What
meets on a shingle lies sorted by size and is compared in tiles: blocks whose
size bands are compatible.  A bitmap of the set bounds the intersection from
above; pairs that pass are decided by intersecting the sorted arrays.

A pair counts on the first shingle that it shares.  What precedes it in a set
is not shared, so its place bounds the size of the partners that are in reach.
Sets that agree on the shingle before as well have met there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import ODD, WordHashes, column_bytes, components, drop, few, in_small_batches, materialize, mix, slices, small, word_hashes

#: Buckets of the table of shingle frequencies, and pieces that it is summed in.
BUCKETS, PIECES = 1 << 22, 64
#: Minimum hashes for finding large groups, and the size from which a group is large.
SIGNATURES, LARGE = 6, 32
#: Rounds of joining large groups, and members compared with the rest in each but the first.
ROUNDS, LEADERS = 3, 4
#: Pairs for each node beyond which pairs are verified in rounds.
DENSE = 8
#: Nodes on a shingle up to which they are paired at once; beyond, nodes per block of a tile.
RUN, BLOCK = 64, 256
#: Pairs of sets, which are wide, that one task verifies at least.
TASK_PAIRS = 512
#: Nodes on a shingle up to which one task holds them; beyond, they are dealt in pieces of about that many.
HEAVY = 1 << 14


def shingle_set(text: bytes | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if it is shorter."""
    h = word_hashes((text or b"").lower(), hashes)
    if not len(h):
        return np.zeros(0, np.uint64)
    width = min(k, len(h))
    sums = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        sums = sums + h[i : len(h) - width + 1 + i] * ODD[i]
    return np.unique(mix(sums))


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bits set at the hashes, modulo a power of two of at least twice the size."""
    bits = int(min(16384, max(128, 1 << int(2 * max(len(values), 1) - 1).bit_length())))
    out = np.zeros(bits, bool)
    out[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmap of fewer words: the same hashes modulo a smaller power of two."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_common(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bound of the intersections of sets with the bitmaps ``a`` and ``b`` (of one width)."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, common, n_a, n_b):
        return self.den * common >= self.num * (n_a + n_b - common)

    def sizes(self, n_a, n_b):
        return self.den * np.minimum(n_a, n_b) >= self.num * np.maximum(n_a, n_b)

    def reach(self, n, place):
        """The largest size of a set that shares nothing before ``place`` of a set of ``n``."""
        return F.expr(f"{self.den} * ({n} - {place}) div {self.num} - {place}")

    def band(self, n: str):
        """Sizes that may be linked lie in one band or in two that are next to each other."""
        return F.floor(F.log(F.col(n)) / (max(math.log(self.den / self.num), 0.01) * (1 + 1e-9)))

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1 if n else 0


def frequency_levels(documents: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How common the shingles of each bucket are: 0 for the usual, more the more common; the buckets of more than ``HEAVY``.

    Counts all documents.  Each task adds up its own; the sums are streamed
    into one table of fixed size (4 MB), in pieces.  Any table gives right
    results: it only sets the order in which shingles are looked at.
    """

    def packed(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        # Counts of the fewest bytes that hold them.
        least = [c.astype(np.min_scalar_type(int(c.max()))) for c in counts.values()]
        kinds, data = [c.dtype.str for c in least], [c.tobytes() for c in least]
        return pa.RecordBatch.from_pydict({"piece": pa.array(list(counts), pa.int32()), "kind": pa.array(kinds, pa.string()), "counts": pa.array(data, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(BUCKETS, np.uint32)
        for batch in slices(batches):
            found = [shingle_set(text, hashes, k) for text in column_bytes(batch, "text")]
            if found:
                np.add.at(total, (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
        if total.any():
            yield packed(dict(enumerate(np.split(total, PIECES))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sums[row["piece"]] = sums.get(row["piece"], 0) + np.frombuffer(row["counts"], row["kind"]).astype(np.int64)
        yield packed(sums)

    schema = "piece int, kind string, counts binary"
    sums = np.zeros((PIECES, BUCKETS // PIECES), np.int64)
    for row in documents.select("text").mapInArrow(count, schema).repartition(PIECES, "piece").mapInArrow(add, schema).collect():
        sums[row["piece"]] += np.frombuffer(row["counts"], row["kind"])
    usual = max(sums.sum() / BUCKETS, 1.0)
    levels = [np.clip(4 * np.log2(np.maximum(piece, 1) / usual), 0, 255).astype(np.uint8) for piece in sums]
    return np.concatenate(levels), np.flatnonzero(sums.ravel() > HEAVY)


FEATURES = "id long, h long, n long, s1 long, s2 long, bits binary, minima array<long>, prefix array<long>"


def described(documents: DataFrame, levels: np.ndarray, k: int, threshold: Threshold) -> DataFrame:
    """``FEATURES`` of every document: size, 128-bit signature of the set, bitmap, minimum hashes, first shingles."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), shared.value
        for batch in slices(batches, 256):
            n, s1, s2, bits, minima, prefix = [], [], [], [], [], []
            for text in column_bytes(batch, "text"):
                x = shingle_set(text, hashes, k)
                n.append(len(x))
                s1.append(int(mix(x + ODD[20]).sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(mix(x ^ ODD[21]).sum(dtype=np.uint64).astype(np.int64)))
                bits.append(bitmap(x).tobytes())
                minima.append([int((mix(x * ODD[30 + i])).min().astype(np.int64)) for i in range(SIGNATURES)] if len(x) else [])
                p = threshold.prefix(len(x))
                level = table[(x % np.uint64(BUCKETS)).astype(np.int64)]
                prefix.append((x[np.argsort(level, kind="stable")[:p]] if level.any() else x[:p]).view(np.int64))
            flat, offsets = (np.concatenate(prefix) if prefix else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary()),
                 pa.array(minima, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))],
                ["id", "h", "n", "s1", "s2", "bits", "minima", "prefix"],
            )

    return documents.mapInArrow(describe, FEATURES)


class Texts:
    """The texts behind nodes: ``documents(id, h, text)``, of ``n`` rows, and each node's row ``node, id, h`` (``h``: hash of the text)."""

    def __init__(self, documents: DataFrame, n: int, rows: DataFrame, again: bool):
        self.documents, self.n, self.rows, self.again = documents, n, rows, again

    def sets(self, nodes: DataFrame, k: int) -> DataFrame:
        """``id, x``: sorted shingle arrays of ``nodes(id)``.

        Texts of other documents never leave their task if the nodes are few
        enough to broadcast; beyond that they are joined by a shuffle.
        """
        own = materialize(few(self.rows.join(nodes.withColumnRenamed("id", "node"), "node"), self.n), "ids")
        chosen = self.documents.join(small(own, own.count()), ["id", "h"]).select(F.col("node").alias("id"), "text")

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, seen = WordHashes(), set()
            for batch in slices(batches):
                # Repeated rows of a node are one.
                new = [i for i, node in enumerate(batch.column("id").to_pylist()) if not (node in seen or seen.add(node))]
                batch = batch.take(pa.array(new, pa.int64()))
                found = [shingle_set(text, hashes, k).tobytes() for text in column_bytes(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "x"])

        found = chosen.mapInArrow(arrays, "id long, x binary")
        return materialize(found.groupBy("id").agg(F.min("x").alias("x")) if self.again else found, "sets")


def verified(texts: Texts, pairs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes, written and each given once, that are linked, by intersecting the sorted arrays of whole texts."""

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                kept.append(bool(threshold.linked(int((both[1:] == both[:-1]).sum()), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sets = texts.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    with_both = with_b.join(sets.select(F.col("id").alias("a"), "x"), "a").select("a", "b", "x", "y")
    links = materialize(few(with_both, pairs.count(), TASK_PAIRS).mapInArrow(intersect, "a long, b long"), "links")
    drop(sets)
    return links


def merged_groups(texts: Texts, nodes: DataFrame, k: int, threshold: Threshold) -> tuple[DataFrame, DataFrame] | None:
    """Links within large groups, and the components (``id, component``) of the nodes they join.

    A large group shares a minimum hash.  Its least member is compared with all
    others; in each later round, where many are joined already, ``LEADERS``
    members that a hash picks are compared with those of other components.
    This spares later steps the pairs within a group; links that it misses are
    found there.
    """
    keys = nodes.where("n > 0").select("id", "n", F.posexplode("minima").alias("i", "key"))
    large = materialize(keys.groupBy("i", "key").count().where(F.col("count") > LARGE).select("i", "key"), "large")
    if not large.take(1):
        return None
    # Keys are broadcast, if few, so that a large group stays spread over its tasks.
    n_large = large.count()
    large = small(large, n_large)
    keys = materialize(keys.join(large, ["i", "key"]), "keys")
    n_keys = keys.count()
    links, merged = None, None
    for round_ in range(ROUNDS):
        if links is None:
            members = keys.withColumn("component", F.col("id"))
            leaders = [F.min(F.struct("id", "n", "component"))]
        else:
            members = keys.join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
            shares = members.groupBy("i", "key", "component").count().groupBy("i", "key").agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("parts"))
            members = members.join(small(shares.where((F.col("most") > LARGE) & (F.col("parts") > 1)).select("i", "key"), n_large), ["i", "key"])
            leaders = [F.min(F.struct(F.xxhash64("id", F.lit(round_ * LEADERS + j)).alias("h"), "id", "n", "component")) for j in range(LEADERS)]
        chosen = members.groupBy("i", "key").agg(F.array_distinct(F.array(*[F.struct(x["id"].alias("id"), x["n"].alias("n"), x["component"].alias("component")) for x in leaders])).alias("leader"))
        chosen = small(chosen.select("i", "key", F.explode("leader").alias("l")), n_large * LEADERS)
        sizes = threshold.den * F.least("n", "l.n") >= threshold.num * F.greatest("n", "l.n")
        pairs = members.join(chosen, ["i", "key"]).where((F.col("component") != F.col("l.component")) & sizes)
        pairs = pairs.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()
        pairs = materialize(possible(pairs, nodes, threshold, max(n_keys * len(leaders), texts.n)).select("a", "b"), "pairs")
        if not pairs.take(1):
            break
        found = verified(texts, pairs, k, threshold)
        links = found if links is None else links.unionByName(found)
        merged = components(links.toDF("u", "v")).withColumnRenamed("node", "id")
        merged = small(merged, merged.count())
    return None if links is None else (links, merged)


def settled(texts: Texts, pairs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """Links among ``pairs(a, b, near)`` that join all nodes which those pairs can join.

    In a dense group most pairs say nothing new.  While there are more than
    ``DENSE`` pairs for each node, at most ``ROUNDS`` times, each node's
    ``LEADERS`` pairs of the greatest possible similarity ``near`` are verified,
    and pairs within a component go.  All that is left is verified.
    """
    links: list[DataFrame] = []
    for _ in range(ROUNDS):
        n, nodes = pairs.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if n <= DENSE * nodes:
            break
        ends = pairs.select(F.explode(F.array("a", "b")).alias("end"), "near", "a", "b")
        first = Window.partitionBy("end").orderBy(F.desc("near"), F.xxhash64("a", "b"))
        best = ends.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= LEADERS).select("a", "b").distinct()
        best = materialize(few(best, n), "chosen")
        links.append(verified(texts, best, k, threshold))
        merged = materialize(components(reduce(DataFrame.unionByName, links).toDF("u", "v")), "merged")
        left, right = (merged.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in "ab")
        rest = pairs.join(best, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
        pairs = materialize(few(rest.where(~F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))).select("a", "b", "near"), max(n, texts.n)), "pairs")
    return reduce(DataFrame.unionByName, [*links, verified(texts, pairs.select("a", "b"), k, threshold)])


def meetings(tokens: DataFrame, threshold: Threshold) -> DataFrame:
    """What meets on a shingle: pairs ``a, b``, or for more than ``RUN`` nodes rows ``a, tile, side``.

    ``tokens(token, id, n, component, reach, before)`` is sorted by token, size
    and id within its partitions and streamed; ``before`` is the set's shingle
    before the token, or the token if it is the first.  With ``run, side`` too
    (see ``cells``) it is sorted by run first, and what meets is of one run and
    of different sides, or of side 2.  Only pairs of
    compatible sizes from different components count, each within the other's
    reach, and not if they met on the shingle before.  A tile is a
    block of nodes (side 0) and a block of nodes at least as large that may be
    in their reach (side 1).
    """

    names = ["token", "id", "n", "component", "reach", "before", *(c for c in ("run", "side") if c in tokens.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(len(names))]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            # The last token may go on in the next batch.
            first = held[6] if len(names) > 6 else held[0]
            cut = int(np.searchsorted(first, first[-1])) if len(first) else 0
            yield from met([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        yield from met(held)

    def met(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, runs = columns[0], columns[6] if len(names) > 6 else columns[0]
        if len(token) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        lengths = np.diff(np.append(starts, len(token)))
        for s, m in zip(starts[lengths > RUN], lengths[lengths > RUN], strict=True):
            own = [x[s : s + m] for x in columns]
            if len(names) == 6 or own[7][0] == 2:
                yield from tiles(*own[:6])
            else:
                yield from tiles(*own[:6], side=own[7])
        usable = np.repeat((lengths > 1) & (lengths <= RUN), lengths)
        token, node, n, component, reach, before, *more = (x[usable] for x in columns)
        runs, side = more or (token, None)
        pairs = []
        at = np.arange(len(token))
        for gap in range(1, RUN):
            at = at[at + gap < len(token)]
            at = at[runs[at] == runs[at + gap]]
            if not len(at):
                break
            to = at + gap
            good = (component[at] != component[to]) & threshold.sizes(n[at], n[to]) & (n[to] <= reach[at]) & (n[at] <= reach[to])
            good &= (before[at] != before[to]) | (before[at] == token[at])
            if side is not None:
                good &= (side[at] != side[to]) | (side[at] == 2)
            pairs.append(np.stack([np.minimum(node[at], node[to])[good], np.maximum(node[at], node[to])[good]], axis=1))
        if pairs:
            found = np.unique(np.concatenate(pairs), axis=0)
            yield rows(found[:, 0], found[:, 1], None, None)

    def rows(a, b, tile, side) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, tile, side)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "tile", "side"])

    def tiles(token, node, n, component, reach, before, side=None) -> Iterator[pa.RecordBatch]:
        smaller = np.flatnonzero(reach >= n)
        groups = [smaller] if side is None else [smaller[side[smaller] == i] for i in (0, 1)]
        for x in (g[s : s + BLOCK] for g in groups for s in range(0, len(g), BLOCK)):
            within = (n >= n[x[0]]) & (n <= reach[x].max()) & (reach >= n[x[0]])
            if side is not None:
                within &= side != side[x[0]]
            if (component[x] == component[x[0]]).all():
                within &= component != component[x[0]]
            within = np.flatnonzero(within)
            for r in range(0, len(within), BLOCK):
                y = within[r : r + BLOCK]
                earlier = np.concatenate([before[x], before[y]])
                if earlier[0] != token[0] and (earlier == earlier[0]).all():
                    continue
                # Tokens that the same nodes share make one tile.
                sides = np.array([mix(node[x].view(np.uint64)).sum(dtype=np.uint64), mix(node[y].view(np.uint64) * ODD[1]).sum(dtype=np.uint64)])
                tile = (sides * ODD[2:4]).sum(dtype=np.uint64).astype(np.int64)
                both = np.concatenate([node[x], node[y]])
                yield rows(both, None, np.full(len(both), tile), np.repeat([0, 1], [len(x), len(y)]))

    return tokens.select(*names).mapInArrow(run, "a long, b long, tile long, side long")


def cells(prefixes: DataFrame, tokens: DataFrame, buckets: np.ndarray, threshold: Threshold) -> tuple[DataFrame, DataFrame] | None:
    """The tokens of more than ``HEAVY`` nodes, and their rows dealt to cells: ``tokens``' columns, ``run`` and ``side``.

    A heavy token's nodes are parted by size band, by being of the component
    that most of them are of or not, and at random into pieces of about
    ``HEAVY``.  A cell holds two pieces (sides 0 and 1) that may have links, or
    one (side 2), so no task holds a whole token, however common.  Pieces of
    the main component need no cell with one another.  Only tokens of
    ``prefixes(prefix)`` in ``buckets`` can be heavy, and so only they are counted.
    """
    if not len(buckets):
        return None
    spark, some = tokens.sparkSession, prefixes.select(F.explode("prefix").alias("token"))
    if len(buckets) <= 1 << 16:
        # At most that many rows.
        listed = F.broadcast(spark.createDataFrame([(int(b),) for b in buckets], "bucket long"))
        some = some.withColumn("bucket", F.col("token").bitwiseAND(F.lit(BUCKETS - 1))).join(listed, "bucket", "left_semi")
    common = materialize(some.groupBy("token").count().where(F.col("count") > HEAVY).select("token"), "common")
    n_common = common.count()
    if not n_common:
        return None
    shares = tokens.join(small(common, n_common), "token", "left_semi").groupBy("token", "component").count()
    heavy = shares.groupBy("token").agg(F.sum("count").alias("nodes"), F.max(F.struct("count", "component"))["component"].alias("main"))
    heavy = materialize(heavy.where(F.col("nodes") > HEAVY).select("token", "main"), "heavy")
    n_heavy = heavy.count()
    if not n_heavy:
        return None
    hot = tokens.join(small(heavy, n_heavy), "token").withColumn("band", threshold.band("n")).withColumn("main", F.col("component") == F.col("main"))
    hot = materialize(hot, "hot")
    parts = hot.groupBy("token", "band", "main").agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    pieces = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left, right = (pieces.select("token", F.struct("band", "main", "part").alias(c)) for c in "pq")
    near = (F.col("q.band") - F.col("p.band")).between(0, 1) & (F.col("p") <= F.col("q")) & ~(F.col("p.main") & F.col("q.main"))
    # Across two bands the pieces' order is that of the bands. The number of a cell is given once, when it is written.
    paired = materialize(left.join(right, "token").where(near).withColumn("run", F.monotonically_increasing_id()), "cells")
    one = paired.where("p = q").select("token", "run", "p.*", F.lit(2).cast("long").alias("side"))
    two = [paired.where("p <> q").select("token", "run", f"{c}.*", F.lit(i).cast("long").alias("side")) for i, c in enumerate("pq")]
    members = materialize(one.unionByName(two[0]).unionByName(two[1]), "members")
    dealt = hot.join(small(parts, parts.count()), ["token", "band", "main"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.join(small(members, members.count()), ["token", "band", "main", "part"])
    return heavy.select("token"), dealt.select(*tokens.columns, "run", "side")


def bounded(tile_rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs ``a, b, near`` of a tile's two sides that their bitmaps don't rule out, with the similarity that those allow; at most ``2 * BLOCK`` rows a tile."""

    def compare(pdf):
        import pandas as pd

        own = pdf.sort_values(["n", "a"])
        node, n, component, side = (own[c].to_numpy() for c in ("a", "n", "component", "side"))
        maps = [np.frombuffer(b, np.uint64) for b in own["bits"]]
        width = np.array([len(m) for m in maps])
        # For each width, the bitmaps of at least that width folded to it; a pair is compared at the lesser of its two.
        stacks = {}
        for w in np.unique(width):
            stacks[w] = np.zeros((len(maps), w), np.uint64)
            for i in np.flatnonzero(width >= w):
                stacks[w][i] = folded(maps[i], w)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, near_ = [], [], []
        for i in left:
            larger = right[(n[right] > n[i]) | ((n[right] == n[i]) & (node[right] > node[i]))]
            near = larger[(component[larger] != component[i]) & threshold.sizes(n[larger], n[i])]
            common = most_common(stacks[width[i]][i][None, :], n[i], stacks[width[i]][near], n[near])
            keep = threshold.linked(common, n[near], n[i])
            good = near[keep]
            a.append(np.full(len(good), node[i]))
            b.append(node[good])
            most = common[keep]
            near_.append(most / (n[good] + n[i] - most))
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "near": np.concatenate([np.zeros(0), *near_])})

    return tile_rows.groupBy("tile").applyInPandas(compare, "a long, b long, near double")


def possible(pairs: DataFrame, nodes: DataFrame, threshold: Threshold, most: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that their bitmaps don't rule out, with ``near``, the similarity that those allow; ``most``: bounds the pairs and the nodes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, near = [], []
            for n_a, x, n_b, y in zip(batch.column("n_a").to_pylist(), batch.column("x"), batch.column("n_b").to_pylist(), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                width = min(len(x), len(y))
                common = int(most_common(folded(x, width), n_a, folded(y, width), n_b))
                kept.append(bool(threshold.linked(common, n_a, n_b)))
                near.append(common / (n_a + n_b - common))
            yield batch.select(["a", "b"]).append_column("near", pa.array(near, pa.float64())).filter(pa.array(kept, pa.bool_()))

    left = pairs.join(nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x")), "a")
    both = left.join(nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y")), "b")
    return few(both.select("a", "b", "n_a", "x", "n_b", "y"), most).mapInArrow(check, "a long, b long, near double")


@in_small_batches
def jaccard_components(documents: DataFrame, k: int = 5, num: int = 75, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` for every document.

    Words are runs of bytes other than space and U+0009 to U+000D, A-Z in
    lower case.  Two documents link when ``den`` times the size of the
    intersection is at least ``num`` times that of the union; the component is
    the least id reachable.  No link between different sets is lost, whatever
    the size of a group; copies are one node and never paired.

    Null and empty texts have an empty set and are linked with nothing.  Rows
    of a null id are never linked and have a null component.  Repeated rows
    each get a row; rows of one id with other texts count as one document with
    the links of all: they have one component, and each the size of its own
    text's set.  An empty table gives no rows.  Other columns play no part.
    """
    threshold = Threshold(num, den)
    documents = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    levels, buckets = frequency_levels(documents, k)
    features = materialize(described(documents, levels, k, threshold), "features")
    n_rows = features.count()
    known = features.where("id is not null")
    sets = known.where("n > 0")
    again = materialize(known.groupBy("id").count().where("count > 1").select("id"), "again")
    n_again = again.count()
    # A node is a set; its number is given once, when the table is written.
    classes = sets.groupBy("s1", "s2").agg(F.min(F.struct("id", "h")).alias("r")).select("s1", "s2", "r.id", "r.h")
    classes = materialize(few(classes, n_rows).withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = sets.join(classes, ["s1", "s2", "id", "h"])
    nodes = (nodes.dropDuplicates(["s1", "s2", "id", "h"]) if n_again else nodes).select(F.col("node").alias("id"), "n", "bits", "minima", "prefix")
    if n_again:
        nodes = materialize(few(nodes, n_rows), "nodes")
    slim = nodes.select("id", "n", "bits", "minima")
    if not n_again:
        # Read many times; without the prefixes it is a small part of the features.
        slim = materialize(few(slim, n_rows), "slim")
    texts = Texts(documents, n_rows, classes.select("node", "id", "h"), n_again > 0)
    groups = merged_groups(texts, slim, k, threshold)
    tokens = nodes.select("prefix", "id", "n")
    owner = slim.select("id", "n", "bits")
    if groups is None:
        tokens, owner = (x.withColumn("component", F.col("id")) for x in (tokens, owner))
    else:
        tokens, owner = (x.join(groups[1], "id", "left").withColumn("component", F.coalesce("component", "id")) for x in (tokens, owner))
    tokens = tokens.select(F.posexplode(F.arrays_zip(F.col("prefix").alias("token"), F.concat(F.slice("prefix", 1, 1), "prefix").alias("before"))).alias("place", "t"), "id", "n", "component")
    tokens = tokens.where("t.token is not null").select("t.token", "id", "n", "component", threshold.reach("n", "place").alias("reach"), "t.before")
    dealt = cells(known.select("prefix"), tokens, buckets, threshold)
    if dealt:
        tokens = tokens.join(small(dealt[0], dealt[0].count()), "token", "left_anti")
    met = materialize(meetings(tokens.repartition("token").sortWithinPartitions("token", "n", "id"), threshold), "meetings")
    if dealt:
        met = met.unionByName(materialize(meetings(dealt[1].repartition("run").sortWithinPartitions("run", "n", "id"), threshold), "meetings"))
    pairs = possible(met.where("b is not null and a <> b").select("a", "b").distinct(), slim, threshold, max(met.count(), n_rows))
    if met.where("tile is not null").take(1):
        tile_rows = met.where("tile is not null").select("a", "tile", "side").distinct().join(owner.withColumnRenamed("id", "a"), "a")
        pairs = pairs.unionByName(bounded(tile_rows, threshold))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("near").alias("near")), "pairs")
    more = settled(texts, pairs, k, threshold)
    links = more if groups is None else groups[0].unionByName(more)
    if n_again:
        # The sets of one id are linked: each with the id's least.
        shared = known.join(small(again, n_again), "id", "left_semi").where("n > 0").select("id", "s1", "s2").distinct()
        shared = materialize(shared.join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("id", "node"), "shared")
        links = links.unionByName(shared.join(shared.groupBy("id").agg(F.min("node").alias("b")), "id").where("node <> b").select(F.col("node").alias("a"), "b"))
    found = components(links.toDF("u", "v"))
    # The least id of each component of several nodes; of a lone node its own.
    joined = materialize(few(classes.select("node", "id").join(found, "node"), n_rows), "linked")
    least = joined.join(joined.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "least")
    named = classes.select("s1", "s2", "id", "node").join(least, "node", "left").select("s1", "s2", F.coalesce("least", "id").alias("least"))
    out = features.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left").select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("least")).alias("least"))
    if n_again:
        # Rows without words have the component of their id's other rows.
        of_id = out.join(small(again, n_again), "id", "left_semi").groupBy("id").agg(F.min("least").alias("of_id"))
        out = out.join(small(of_id, n_again), "id", "left").withColumn("least", F.coalesce("least", "of_id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
