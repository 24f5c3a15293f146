"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only.  Each document has a fixed 48-bit hash.  A source's
budget admits the documents whose hash lies below a threshold: thresholds of
smaller budgets give subsets of larger ones.  The threshold is found without
sorting: word counts are summed by source and hash bucket, whole buckets below
the budget are taken, and only the bucket at the boundary is cut into finer
buckets.  Rows that share the threshold's hash, such as those of one id, are cut
the same way by a hash of their text, and copies of one row by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import fresh, materialize, repeated, running_sum, small

#: Hash digits: LEVELS times BITS bits; digits of a row's number.
BITS, LEVELS, ROW_LEVELS = 12, 4, 5
#: Sources up to which their table is broadcast.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    blanks = "\t\n\x0b\x0c\r"
    flat = F.trim(F.translate(text, blanks, " " * len(blanks)))
    return F.when(flat.isNull() | (flat == ""), F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn.  All sizes are
    shared by weight; a source stops at ``most`` times its size and its excess
    goes to the others by weight, until none is above.  Closed form: a source
    is full at the share per weight ``most * size / weight``; in that order, a
    source is full iff the share left per weight, once all before it are full,
    reaches its own; the first that is not sets the rate of all that are not (later
    shares are lower).  One row per source, so one task holds them.
    """
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    table = sources.withColumn("weight", turn.cast("double")).withColumn("_cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy((F.col("_cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "_spent": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        }
    )
    table = table.withColumn("_share", (F.col("_total") - F.col("_spent")) / F.col("_left"))
    full = F.col("_share") >= F.col("_cap") / F.col("weight")
    table = table.withColumn("_full", full).withColumn("_rate", F.max(F.when(~F.col("_full"), F.col("_share"))).over(everything))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_rate") * F.col("weight"))
    return table.select("source", "source_size", "weight", target.cast("double").alias("target"))


def key_hash(key: Column) -> Column:
    """The fixed hash of a document, ``BITS * LEVELS`` bits of its id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """A second hash of as many bits, of the text."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS * LEVELS)


def mixing_plan(documents: DataFrame, weights: tuple[int, ...], most: int, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, int]:
    """``id, size, source, hash, again, row`` of all rows; per source ``source_size, target, whole, rest``; the number of sources.

    ``row`` numbers the rows; it is given once, when they are written.
    """
    rows = documents.select(F.col(key).alias("id"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"), key_hash(F.col(key)).alias("hash"), text_hash(F.col(text)).alias("again"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = targets(sizes, weights, float(most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + F.lit(1e-12)), F.lit(most)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = materialize(plan.withColumn("filled", F.lit(0).cast("long")), "plan")
    return rows, plan, plan.count()


def threshold(rows: DataFrame, plan: DataFrame, column: str, levels: int, sources: int) -> DataFrame:
    """``source, rest, filled, at`` of ``plan(source, rest, filled)``.

    All of a source's rows whose ``column`` lies below ``at`` fit into ``rest``
    words besides the ``filled`` ones, which now count them; those at ``at`` don't.
    """
    found = plan.select("source", "rest", "filled", F.lit(0).cast("long").alias("at"))
    for level in range(levels):
        found = materialize(refine(rows, found, column, BITS * (levels - 1 - level), sources), "thresholds")
    return found


def at_bound(rows: DataFrame, column: str, found: DataFrame, sources: int) -> DataFrame:
    """The rows whose ``column`` is at their source's bound."""
    bounds = small(found.select("source", F.col("at").alias("bound")), sources, SOURCES)
    return rows.alias("r").join(bounds.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col(f"r.{column}") == F.col("p.bound"))).select("r.*")


def cuts(tied: DataFrame, by_hash: DataFrame, sources: int) -> DataFrame:
    """Where each source's budget ends: ``source, hash_at, again_at, row_at, left``, from the rows at the hash bound.

    A row is taken if (hash, again, row) lies below the three, and the one row
    at all three gets the ``left`` words.  The last two are looked for only
    where rows tie.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    if tied.groupBy("source").count().where("count > 1").take(1):
        by_text = threshold(tied, by_hash, "again", LEVELS, sources)
        by_row = threshold(at_bound(tied, "again", by_text, sources), by_text, "row", ROW_LEVELS, sources)
    else:
        # One row at most: it lies at its own second hash and number.
        own = tied.select("source", "again", "row")
        by_text, by_row = (by_hash.alias("p").join(own.alias("r"), same("p", "r"), "left").select("p.source", "rest", "filled", F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias("at")) for c in ("again", "row"))
    named = by_hash.select("source", F.col("at").alias("hash_at")).alias("a").join(by_text.select("source", F.col("at").alias("again_at")).alias("b"), same("a", "b"))
    named = named.select("a.source", "hash_at", "again_at").alias("a").join(by_row.select("source", F.col("at").alias("row_at"), (F.col("rest") - F.col("filled")).alias("left")).alias("b"), same("a", "b"))
    return materialize(named.select("a.source", "hash_at", "again_at", "row_at", "left"), "cuts")


def below() -> Column:
    """Whether a row lies below its source's cut."""
    later = (F.col("again") < F.col("again_at")) | ((F.col("again") == F.col("again_at")) & (F.col("row") < F.col("row_at")))
    return (F.col("hash") < F.col("hash_at")) | ((F.col("hash") == F.col("hash_at")) & later)


def on_cut() -> Column:
    return (F.col("hash") == F.col("hash_at")) & (F.col("again") == F.col("again_at")) & (F.col("row") == F.col("row_at"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, size, source, source_size, target, taken`` for every document.

    Each source's target is ``whole`` passes over all its documents plus a rest
    that the hash threshold fills, so ``taken`` is ``whole`` or ``whole + 1``
    times the size, at most ``most`` times, and the document at the threshold is
    cut to what is left of the budget: each source's words come within one of
    its target.  Rows of one id are told apart by their text, copies by their
    place.  A null source is a source of its own; null and empty texts have
    size 0 and take 0; an empty table gives an empty result.  Other columns of
    the input play no part.  The same rows give the same mix.
    """
    rows, plan, n = mixing_plan(documents, weights, most, key, text, source)
    by_hash = threshold(rows, plan, "hash", LEVELS, n)
    found = cuts(materialize(at_bound(rows, "hash", by_hash, n), "tied"), by_hash, n)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = plan.alias("p").join(found.alias("c"), same("p", "c")).select("p.*", "hash_at", "again_at", "row_at", "left")
    part = F.when(below(), F.col("size")).when(on_cut(), F.least("size", F.floor("left"))).otherwise(F.lit(0))
    taken = (F.col("size") * F.col("whole") + part).cast("long").alias("taken")
    both = rows.alias("r").join(small(plan, n, SOURCES).alias("p"), same("r", "p"))
    return both.select(F.col("r.id").alias(key), "size", "r.source", "source_size", "target", taken)


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it whole; columns unchanged.

    The threshold's own document is in if that comes nearer to the target.
    Thresholds are looked up per source; the texts are filtered where they are
    read, without sorting.  Only the rows at a source's hash threshold, one if
    ids are unique, are written: copies among them are told apart by number.
    Null, empty and repeated rows are handled as in ``mix``.
    """
    rows, plan, n = mixing_plan(documents, weights, most, key, text, source)
    by_hash = threshold(rows, plan, "hash", LEVELS, n)
    columns = [F.col(f"d.`{c}`") for c in documents.columns]
    own, wanted, hashed, copies = fresh(documents.columns, "own", "wanted", "hashed", "copies")
    bounds = plan.alias("p").join(by_hash.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select(F.col("p.source").alias(own), F.col("whole").alias(wanted), F.col("at").alias(hashed))
    met = documents.alias("d").join(small(bounds, n, SOURCES).alias("b"), F.col(f"d.`{source}`").eqNullSafe(F.col(f"b.{own}")))
    place = key_hash(F.col(f"d.`{key}`"))
    plain = met.where(place != F.col(hashed)).select(*columns, (F.col(wanted) + (place < F.col(hashed)).cast("long")).alias(copies))
    # Rows at the threshold: numbered once, when they are written.
    held = met.where(place == F.col(hashed)).select(F.struct(*columns).alias("doc"), F.col(wanted).alias("wanted"), F.col(f"b.{own}").alias("source"), word_count(F.col(f"d.`{text}`")).alias("size"), place.alias("hash"), text_hash(F.col(f"d.`{text}`")).alias("again"))
    held = materialize(held.withColumn("row", F.monotonically_increasing_id()), "held")
    found = cuts(held, by_hash, n)
    near = (F.col("left") * 2 >= F.col("size")) & (F.col("left") >= 1)
    once = held.alias("r").join(small(found, n, SOURCES).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    once = once.select("doc", (F.col("wanted") + (below() | (on_cut() & near)).cast("long")).alias(copies)).select("doc.*", copies)
    return repeated(plain.unionByName(once), copies).select(*[F.col(f"`{c}`") for c in documents.columns])


def refine(rows: DataFrame, found: DataFrame, column: str, shift: int, sources: int) -> DataFrame:
    """Cut each source's boundary bucket of ``column`` by its next ``BITS`` bits.

    ``at``: the start of the boundary bucket found so far; ``filled``: the
    words below it.
    """
    inside = F.shiftright(F.col(column), shift + BITS) == F.shiftright(F.col("p.at"), shift + BITS)
    boundary = small(found, sources, SOURCES).alias("p")
    words = (
        rows.alias("r").join(boundary, F.col("r.source").eqNullSafe(F.col("p.source")) & inside)
        .groupBy(F.col("r.source").alias("source"), (F.shiftright(F.col(column), shift) % (1 << BITS)).alias("digit"))
        .agg(F.sum("size").alias("words"))
    )
    sums = running_sum(words, "digit", "words", "upto", by=["source"], shift=6)
    sums = sums.alias("s").join(boundary, F.col("s.source").eqNullSafe(F.col("p.source")))
    fits = F.col("upto") <= F.col("rest") - F.col("filled")
    cut = sums.groupBy("s.source").agg(F.min(F.when(~fits, F.col("digit"))).alias("next"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("more"))
    joined = found.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    # Without a boundary all buckets fit (or there are none): the next value above them bounds the source.
    digit = F.when(F.col("more").isNull(), F.lit(0)).otherwise(F.coalesce("next", F.lit(1 << BITS)))
    return joined.select(
        "p.source", "p.rest", (F.col("p.filled") + F.coalesce("more", F.lit(0))).cast("long").alias("filled"), (F.col("p.at") + F.shiftleft(digit.cast("long"), shift)).alias("at")
    )
