"""Generic differences of two snapshots: add, remove, set, link, unlink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import cut, reach, sliced, union
from factloom.storage import among


def changed_keys(both: DataFrame) -> DataFrame:
    """``id, attr, from_val, to_val`` of ``both(id, a, b)`` payload maps; an absent key differs from null."""
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    rows = both.select("id", "a", "b", F.explode(F.filter(keys, lambda k: ~k.startswith("_"))).alias("attr"))
    has_a, has_b = F.map_contains_key("a", F.col("attr")), F.map_contains_key("b", F.col("attr"))
    value_a, value_b = F.when(has_a, F.coalesce(F.try_element_at("a", F.col("attr")), F.lit("null"))), F.when(has_b, F.coalesce(F.try_element_at("b", F.col("attr")), F.lit("null")))
    return rows.where(~value_a.eqNullSafe(value_b)).select("id", "attr", value_a.alias("from_val"), value_b.alias("to_val"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, in_a, in_b, pa, pb, differ, ref``: both sides' parents by id, and whether their hashes differ, without payloads, written once."""
    # Of a digest 128 bits tell facts apart.
    digest = F.when(F.length("hash") == 64, F.unhex(F.substring("hash", 1, 32)))
    own = lambda x, s: x.select("id", F.col("parent_id").alias(f"p{s}"), F.coalesce(digest, F.col("hash").cast("binary")).alias(f"h{s}"), F.col("ref_only").alias(f"r{s}"), F.lit(True).alias(f"in_{s}"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    kept = ("id", flag("in_a").alias("in_a"), flag("in_b").alias("in_b"), "pa", "pb", (F.col("ha") != F.col("hb")).alias("differ"), (flag("ra") | flag("rb")).alias("ref"))
    return sliced([own(a, "a"), own(b, "b")], lambda x, y: x.join(y, "id", "full").select(*kept))


def gone(both: DataFrame, own: str, other: str) -> DataFrame:
    """Ids with an ancestor-or-self, along ``own``'s parents, that ``other`` lacks.

    What the other side lacks is known from ``both``; only common facts below
    it are walked, from the last found ones downwards.
    """
    lost = both.where(f"in_{own} and not in_{other}").select("id")
    common = both.where(f"in_{own} and in_{other} and p{own} is not null").select("id", F.col(f"p{own}").alias("p"))
    first = common.join(lost.withColumnRenamed("id", "p"), "p", "left_semi").select("id")
    return lost.unionByName(reach(first, common.select(F.col("p").alias("src"), F.col("id").alias("dst"))))


def inside(common: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids(id)`` that a root reaches within ``common(id, pa, pb)`` along either side's parents.

    Only what lies above them is walked: upwards for it, then down from its roots.
    """
    steps = union([common.where(f"p{s} is not null").select(F.col(f"p{s}").alias("src"), F.col("id").alias("dst")) for s in "ab"])
    ids = cut(ids)
    above = cut(reach(ids, steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    here = cut(among(common.select("id", (F.col("pa").isNull() | F.col("pb").isNull()).alias("root")), above))
    held = cut(among(steps, above, "dst").distinct().join(here.select(F.col("id").alias("src")), "src", "left_semi"))
    return ids.join(reach(here.where("root").select("id"), held), "id", "left_semi")


def fact_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """``verb, id, attr, from_val, to_val`` of ``a`` and ``b`` (``id, parent_id, payload, hash, ref_only``).

    A fact is removed (added) if it or an ancestor is missing on the other
    side; facts on both sides that a root reaches inside the common part are
    compared.  Where no parent differs that is all of the common part not gone
    on both sides' chains, which one full join finds.  Facts that either side
    holds for reference only have no deltas of their own.  Payloads are read
    only of facts whose hashes differ.
    """
    both = aligned(a, b)
    removed, added = cut(gone(both, "a", "b")), cut(gone(both, "b", "a"))
    common = both.where("in_a and in_b")
    wanted = "differ and not ref"
    if common.where("not pa <=> pb").take(1):
        differ = inside(common, common.where(wanted).select("id"))
    else:
        differ = common.where(wanted).select("id").join(removed, "id", "left_anti").join(added, "id", "left_anti")
    differ = cut(differ.distinct())
    pairs = among(a.select("id", F.col("payload").alias("a")), differ).join(among(b.select("id", F.col("payload").alias("b")), differ), "id")
    sets = changed_keys(pairs).select(F.lit("set").alias("verb"), "id", "attr", "from_val", "to_val")
    none = F.lit(None).cast("string")
    refs = both.where("ref").select("id")
    whole = [x.join(refs, "id", "left_anti").select(F.lit(verb).alias("verb"), "id", none.alias("attr"), none.alias("from_val"), none.alias("to_val")) for verb, x in (("remove", removed), ("add", added))]
    return union([*whole, sets])


def edge_deltas(a: DataFrame, b: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``verb, from_id, edge_kind, to_id``: link where only ``b`` has the edge, unlink where only ``a`` has it.

    Edges that leave a fact of ``refs(id)``, which either side holds for reference only, have no delta.
    """
    keys = ["from_id", "edge_kind", "to_id"]
    both = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "full")
    found = both.where("_a is null or _b is null").select(F.when(F.col("_a").isNull(), "link").otherwise("unlink").alias("verb"), *keys)
    return found if refs is None else found.join(refs.select(F.col("id").alias("from_id")), "from_id", "left_anti").select("verb", *keys)


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id`` of the facts outside equal subtrees, by stored roll-ups ``(id, rollup)``.

    A roll-up covers all that lies below, so a fact of equal roll-ups and all
    its descendants need no visit: a join by id leaves them out at once.
    """
    both = lambda x, y: x.select("id", F.col("rollup").alias("ra")).join(y.select("id", F.col("rollup").alias("rb")), "id", "full")
    return sliced([a, b], lambda x, y: both(x, y).where("not ra <=> rb").select("id"))


def delta_key(verb: str = "verb") -> Column:
    """Sort key of a delta: subject, verb, attribute."""
    return F.concat_ws("|", F.col("id"), F.col(verb), F.coalesce("attr", F.lit("")))


def apply_deltas(a: DataFrame, deltas: DataFrame, b: DataFrame) -> DataFrame:
    """``id, payload`` of ``a`` after the deltas (added payloads from ``b``): the inverse of ``fact_deltas``."""
    kept = a.select("id", "payload").join(deltas.where("verb = 'remove'").select("id"), "id", "left_anti")
    sets = deltas.where("verb = 'set'").groupBy("id").agg(F.collect_list(F.struct("attr", "to_val")).alias("s"))
    named = kept.join(sets, "id", "left")
    dropped = F.map_filter("payload", lambda k, v: ~F.coalesce(F.exists("s", lambda x: x["attr"] == k), F.lit(False)))
    new = F.map_from_entries(F.filter("s", lambda x: x["to_val"].isNotNull()))
    kept = named.select("id", F.when(F.col("s").isNull(), F.col("payload")).otherwise(F.map_concat(dropped, new)).alias("payload"))
    return kept.unionByName(b.select("id", "payload").join(deltas.where("verb = 'add'").select("id").distinct(), "id", "left_semi"))
