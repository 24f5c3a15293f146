"""Views of a snapshot: baselines, exclusions, scopes, projected targets, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import child_edges, cut, edge_digest, parent_edges, reach, sliced, union
from factloom.storage import among, small, without


def kept_edges(edges: DataFrame, ids: DataFrame, dangling: Column | None = None) -> DataFrame:
    """Edges of which both ends are in ``ids(id)``; the target may be missing where ``dangling`` holds."""
    from_kept = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    known = ids.select(F.col("id").alias("to_id"), F.lit(True).alias("_known"))
    both = from_kept.join(known, "to_id", "left")
    ok = F.col("_known").isNotNull() if dangling is None else F.col("_known").isNotNull() | F.coalesce(dangling, F.lit(False))
    return both.where(ok).select(*edges.columns)


def owned() -> Column:
    """An owner edge may point at a role that is not part of the view."""
    return F.col("edge_kind") == "owner"


def subtract_baseline(facts: DataFrame, edges: DataFrame, base_facts: DataFrame, base_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts that differ from the baseline in content or edges, and the ancestors of those; their edges.

    Walks upwards from the survivors, a row per fact; edge sets are compared by their hash.
    """
    base = base_facts.select("id", F.col("hash").alias("h"), F.lit(True).alias("_base"))
    ids = base.select("id")
    own_edges = edge_digest(edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi"))
    signed = own_edges.join(edge_digest(base_edges).withColumnRenamed("signature", "s"), "id", "full").where("not signature <=> s").select("id", F.lit(True).alias("_edges"))
    named = facts.select("id", "hash").join(base, "id", "left").join(signed, "id", "left")
    survivors = named.where("_base is null or hash <> h or _edges").select("id")
    kept = cut(reach(survivors, cut(parent_edges(facts))))
    return facts.join(kept, "id", "left_semi"), kept_edges(edges, kept, owned())


def exclude_subtrees(facts: DataFrame, edges: DataFrame, roots: DataFrame, dangling: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the subtrees of ``roots(id)``; edges need both ends, or may dangle where ``dangling`` holds."""
    kept = facts.join(reach(roots, child_edges(facts)), "id", "left_anti")
    return kept, kept_edges(edges, kept.select("id"), dangling)


def provenance_roots(edges: DataFrame, kind: str) -> DataFrame:
    """Facts with an outgoing edge of ``kind``."""
    return edges.where(F.col("edge_kind") == kind).select(F.col("from_id").alias("id")).distinct()


def member_closure(facts: DataFrame, edges: DataFrame, boundary: str, satellites: list[str], kind: str = "memberOfExtension") -> DataFrame:
    """Members and what lies below them; below a member of kind ``boundary`` nothing follows, satellites never do."""
    roots = provenance_roots(edges, kind)
    inner = facts.join(roots, "id", "left_semi").where(F.col("kind") != boundary).select("id")
    steps = child_edges(facts.where(~F.col("kind").isin(satellites)))
    return roots.join(facts.select("id"), "id", "left_semi").unionByName(reach(inner, steps)).distinct()


def scoped(facts: DataFrame, edges: DataFrame, scope: str = "cluster", default_owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scope ``cluster``: all.  ``database``: roles and memberships go with what lies below; owner edges to roles dangle, but those to the default owner go."""
    if scope == "cluster":
        return facts, edges
    gone = facts.where(F.col("kind").isin("role", "membership")).select("id")
    return exclude_subtrees(facts, edges, gone, owned() & (F.col("to_id") != F.lit(default_owner or "")))


def resolved(
    facts: DataFrame, edges: DataFrame, base: tuple[DataFrame, DataFrame] | None = None, incapable: Column | None = None, excluded: Column | None = None,
    assumed: Column | None = None, boundary: str = "schema", satellites: tuple[str, ...] = ("comment", "acl", "securityLabel"),
) -> tuple[DataFrame, DataFrame]:
    """The view that a profile manages, in the fixed order of its steps.

    Members of extensions, and what handlers manage, are found on the raw
    snapshot.  Then go: what equals
    the baseline, what handlers manage, what the applier is not capable of
    (``incapable`` over a fact) and what the policy excludes (``excluded``);
    excluded facts that are ``assumed`` present stay for reference.  Members
    and assumed facts, with all below those, are marked ``ref_only``.
    """
    members, handled = cut(member_closure(facts, edges, boundary, list(satellites))), provenance_roots(edges, "managedBy")
    if base is not None:
        facts, edges = subtract_baseline(facts, edges, *base)
    facts, edges = exclude_subtrees(facts, edges, handled, owned())
    if incapable is not None:
        facts, edges = exclude_subtrees(facts, edges, facts.where(incapable).select("id"), owned())
    reference = members
    if excluded is not None:
        keep = F.lit(False) if assumed is None else F.coalesce(assumed, F.lit(False))
        reference = cut(union([members, reach(facts.where(excluded & keep).select("id"), child_edges(facts))]).distinct())
        facts, edges = exclude_subtrees(facts, edges, facts.where(excluded & ~keep).select("id"), owned())
    marked = facts.join(reference.withColumn("_ref", F.lit(True)), "id", "left").withColumn("ref_only", F.col("ref_only") | F.coalesce("_ref", F.lit(False))).drop("_ref")
    return marked, edges


def managed(facts: DataFrame, edges: DataFrame, scope: str, default_owner: str | None = None, **steps) -> tuple[DataFrame, DataFrame]:
    """The resolved view in its management scope."""
    return scoped(*resolved(facts, edges, **steps), scope, default_owner)


def project_target(desired: DataFrame, deltas: DataFrame, source: DataFrame) -> DataFrame:
    """``id, parent_id, payload`` of the desired state with the filtered ``deltas`` undone; orphans go.

    What changes is known by its ids, which are few beside the facts: payloads
    are neither written nor dealt out.
    """
    deltas = cut(deltas)
    adds, removes, changed = (cut(deltas.where(F.col("verb") == v).select("id").distinct()) for v in ("add", "remove", "set"))
    own = lambda df: df.select("id", "parent_id", "payload")
    there = without(among(desired.select("id"), removes), adds)
    rows = without(own(desired), adds).unionByName(among(own(source), removes).join(there, "id", "left_anti"))
    # Few facts are orphans: they are walked, not the whole forest.
    links = rows.select("id", "parent_id").where("parent_id is not null")
    unknown = cut(links.select(F.col("parent_id").alias("id")).distinct().join(rows.select("id"), "id", "left_anti"))
    lost = among(links, unknown, "parent_id").select("id")
    rows = without(rows, cut(reach(lost, child_edges(rows))))
    sets = cut(deltas.where("verb = 'set'").groupBy("id").agg(F.collect_list(F.struct("attr", "from_val")).alias("s")))
    other = F.map_filter("payload", lambda k, v: ~F.exists("s", lambda x: x["attr"] == k))
    old = F.map_from_entries(F.filter("s", lambda x: x["from_val"].isNotNull()))
    restored = among(rows, changed).join(sets, "id").select("id", "parent_id", F.map_concat(other, old).alias("payload"))
    return without(rows, changed).unionByName(restored)


def normalise_ids(rows: DataFrame, names: DataFrame, columns: tuple[str, ...] = ("from_id", "to_id")) -> DataFrame:
    """Rows with the ids of ``names(old, new)`` replaced in the given columns."""
    for end in columns:
        rows = rows.join(F.broadcast(names.select(F.col("old").alias(end), "new")), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return rows


def normalise_payloads(facts: DataFrame, names: dict[str, str], attrs: list[str]) -> DataFrame:
    """Facts whose payload values at ``attrs`` are renamed; the map is the driver's, a few roles."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    new = F.transform_values("payload", lambda k, v: F.when(k.isin(attrs), F.coalesce(F.try_element_at(table, v), v)).otherwise(v))
    return facts.withColumn("payload", new)


def lone(own: DataFrame, other: DataFrame) -> DataFrame:
    """Facts that ``other`` lacks, topmost ones only."""
    missing = sliced([own, other.select("id")], lambda x, y: x.join(y, "id", "left_anti"))
    return missing.join(missing.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(own.columns)


def rename_candidates(removed: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """``from_id, to_id, state``: removed and added facts of one key; ambiguous unless one of each."""
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    pairs = removed.select(F.col("id").alias("from_id"), *key).join(added.select(F.col("id").alias("to_id"), *key), key)
    sized = pairs.join(count(removed, "n"), key).join(count(added, "m"), key)
    return sized.select("from_id", "to_id", F.when((F.col("n") == 1) & (F.col("m") == 1), "unambiguous").otherwise("ambiguous").alias("state"))


def near_misses(removed: DataFrame, added: DataFrame, key: list[str], whole: str) -> DataFrame:
    """``from_id, to_id``: same ``key``, other value of ``whole``; removed facts with an exact match stay out."""
    exact = removed.join(added.select(*key, whole).distinct(), [*key, whole], "left_semi").select("id")
    left = removed.join(exact, "id", "left_anti").select(F.col("id").alias("from_id"), *key, F.col(whole).alias("_w"))
    right = added.select(F.col("id").alias("to_id"), *key, F.col(whole).alias("_v"))
    return left.join(right, key).where("_w <> _v").select("from_id", "to_id")


def accepted(candidates: DataFrame, mode: str = "off", chosen: DataFrame | None = None) -> DataFrame:
    """``from_id, to_id``: ``auto`` takes the unambiguous ones, ``prompt`` those of ``chosen``, ``off`` none."""
    if mode == "auto":
        return candidates.where("state = 'unambiguous'").select("from_id", "to_id")
    if mode == "prompt" and chosen is not None:
        return candidates.join(chosen.select("from_id", "to_id"), ["from_id", "to_id"], "left_semi").select("from_id", "to_id")
    return candidates.limit(0).select("from_id", "to_id")


def confirmed(renames: DataFrame, source: DataFrame, source_edges: DataFrame, target: DataFrame, target_edges: DataFrame) -> DataFrame:
    """``from_id, to_id, ok`` of accepted renames against the projected target.

    The old id must be gone from ``target(id, structural)``, what lies below must
    be equal on both sides, and so must the edges that come in.  Of facts and
    edges only those of the renames are looked at.
    """
    renames = cut(renames)
    n = renames.count()
    of = lambda df, c, end: df.join(small(renames.select(F.col(end).alias(c)).distinct(), n), c, "left_semi")
    source, still_in, target = of(source, "id", "from_id"), of(target, "id", "from_id"), of(target, "id", "to_id")
    source_edges, target_edges = of(source_edges, "to_id", "from_id"), of(target_edges, "to_id", "to_id")
    incoming = lambda e, end: edge_digest(e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "edge_kind")).select(F.col("id").alias(end), F.col("signature").alias(f"{end}_in"))
    old = source.select(F.col("id").alias("from_id"), F.col("structural").alias("was"))
    new = target.select(F.col("id").alias("to_id"), F.col("structural").alias("now"))
    still = still_in.select(F.col("id").alias("from_id"), F.lit(True).alias("still"))
    named = renames.join(old, "from_id", "left").join(new, "to_id", "left").join(still, "from_id", "left").join(incoming(source_edges, "from_id"), "from_id", "left").join(incoming(target_edges, "to_id"), "to_id", "left")
    ok = F.col("still").isNull() & F.coalesce(F.col("was") == F.col("now"), F.lit(False)) & F.col("from_id_in").eqNullSafe(F.col("to_id_in"))
    return named.select("from_id", "to_id", ok.alias("ok"))


def drop_roots(facts: DataFrame, removed: DataFrame, cascades: list[str], satellites: tuple[str, ...] = (), redirect: DataFrame | None = None) -> DataFrame:
    """``id, drop_root``: for each removed fact the topmost removed ancestor that cascades reach without a break.

    A removed fact folds into its removed parent if the parent's kind is in
    ``cascades`` or its own is in ``satellites``.  Pointers are doubled, so
    rounds grow with the logarithm of the depth and rows stay one per removed
    fact.  ``redirect(id, to)``: drop roots that stand for others.
    """
    gone = facts.join(removed.select("id"), "id", "left_semi").select("id", "kind", "parent_id")
    parents = gone.select(F.col("id").alias("parent_id"), F.col("kind").alias("pk"))
    folds = F.col("pk").isNotNull() & (F.col("pk").isin(cascades) | F.col("kind").isin(list(satellites)))
    up = cut(gone.join(parents, "parent_id", "left").select("id", F.when(folds, F.col("parent_id")).otherwise(F.col("id")).alias("drop_root")))
    while True:
        twice = up.select(F.col("id").alias("drop_root"), F.col("drop_root").alias("next"))
        after = cut(up.join(twice, "drop_root").select("id", F.col("next").alias("drop_root"), (F.col("next") != F.col("drop_root")).alias("moved")))
        up = after.select("id", "drop_root")
        if not after.where("moved").take(1):
            break
    if redirect is None:
        return up
    return up.join(redirect.select(F.col("id").alias("drop_root"), "to"), "drop_root", "left").select("id", F.coalesce("to", "drop_root").alias("drop_root"))
