"""Plans over actions: graph edges, exact order, segments, safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import id_segments
from factloom.operators.graph import cut, islands, kahn, levels, numbered, reach, union
from factloom.plans.rules import weight
from factloom.storage import among, kept

#: The order of the hazard kinds in a report, the first four of actions, the others of coverage.
HAZARDS = ("data_loss", "rewrite_risk", "non_transactional", "access_exclusive_lock", "unmodeled_kind", "unmodeled_drift", "unresolved_security_label", "vault_presence")
COVERAGE = HAZARDS[4:]
#: Actions and edges up to which a plan is ordered by the driver, in the exact order of the least key first.
DRIVER_PLAN = 400_000


def tie_key(drop: Column, stratum: Column, rank: Column, subject: Column, index: Column) -> Column:
    """Sorts drops first, heavy kinds first among them; then by stratum, weight, subject, place."""
    return F.concat_ws("|", F.when(drop, "0").otherwise("1"), stratum.cast("string"), F.lpad(F.when(drop, F.lit(99) - rank).otherwise(rank).cast("string"), 2, "0"), subject, F.lpad(index.cast("string"), 10, "0"))


def column_key(ident: Column, place: Column) -> Column:
    """Subject key of a column's create: columns of a table by their declared place, not by name."""
    parts = id_segments(ident)
    return F.concat_ws("\0", F.lit("column"), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.lpad(place.cast("string"), 6, "0"))


def evaluators(subjects: DataFrame, edges: DataFrame, facts: DataFrame, routines: tuple[str, ...] = ("function", "procedure", "aggregate")) -> DataFrame:
    """``id`` of the subjects that reach a routine along ``depends`` edges, and from domains to their constraints; cycles are no matter."""
    back = edges.where("edge_kind = 'depends'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    held = facts.where("kind = 'constraint' and parent_id like 'domain:%'").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    start = facts.where(F.col("kind").isin(*routines)).select("id")
    return subjects.join(reach(start, back.unionByName(held)), "id", "left_semi")


def keyed(actions: DataFrame, late: DataFrame | None = None, places: DataFrame | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """Add ``key``, the tie key, of ``actions(action, verb, subject, kind)``.

    ``late(id)``: subjects that evaluate user expressions come behind
    definitions.  ``places(id, place)``: declared places of columns.
    """
    drop = F.col("verb") == "drop"
    rank = weight(F.col("kind")) if weights is None else weight(F.col("kind"), weights)
    named = actions.withColumn("_late", F.lit(0)) if late is None else actions.join(late.select(F.col("id").alias("subject"), F.lit(1).alias("_l")), "subject", "left").withColumn("_late", F.coalesce("_l", F.lit(0))).drop("_l")
    named = named.withColumn("_place", F.lit(None).cast("int")) if places is None else named.join(places.select(F.col("id").alias("subject"), F.col("place").alias("_place")), "subject", "left")
    subject = F.when((F.col("verb") == "create") & (F.col("kind") == "column") & F.col("_place").isNotNull(), column_key(F.col("subject"), F.col("_place"))).otherwise(F.col("subject"))
    stratum = F.when(drop, 0).otherwise(F.col("_late"))
    return named.withColumn("key", F.concat_ws("|", tie_key(drop, stratum, rank, subject, F.lit("")), "action")).drop("_late", "_place")


def touched(actions: DataFrame) -> DataFrame:
    """``action, role, id`` of actions that hold arrays (``idx, produces, consumes, destroys, releases``)."""
    return union([actions.select(F.col("idx").alias("action"), F.lit(role).alias("role"), F.explode(role).alias("id")).distinct() for role in ("produces", "consumes", "destroys", "releases")])


def graph_edges(actions: DataFrame) -> DataFrame:
    """``src, dst, reason`` of ``actions(idx, produces, consumes, destroys, releases)``."""
    return action_edges(touched(actions))


def action_edges(touches: DataFrame, built: DataFrame | None = None, torn: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """``src, dst, reason`` of ``touches(action, role, id)``.

    A release comes before the destroyer; a producer before its consumers; a
    consumer before the destroyer unless something produces the id again; a
    destroyer before that producer.  ``built(from_id, to_id)``: the desired
    state's dependencies, by which producers are ordered; ``torn``: the
    source's, by which destroyers are, dependents first; ``parents(id,
    parent_id)``: children are destroyed before their parents.
    """
    each = {r: touches.where(F.col("role") == r).select("action", "id").distinct() for r in ("produces", "consumes", "destroys", "releases")}

    def written(found: DataFrame, reason: str) -> DataFrame:
        """Edges of one reason, each once; the shuffle files of one reason go before the next."""
        return cut(found.where("src <> dst").select("src", "dst").distinct()).select("src", "dst", F.lit(reason).alias("reason"))

    def pairs(first: DataFrame, then: DataFrame, reason: str) -> DataFrame:
        both = first.withColumnRenamed("action", "src").join(then.withColumnRenamed("action", "dst"), "id")
        return written(both, reason)

    def along(links: DataFrame, first: str, then: str, role: str, reason: str) -> DataFrame:
        own = each[role]
        # Links between untouched facts, most of them, are neither dealt out nor compared.
        ids = cut(own.select("id").distinct())
        near = among(among(links.select(F.col(first).alias("id"), F.col(then).alias("_to")), ids), ids, "_to")
        left = near.join(own.withColumnRenamed("action", "src"), "id").select("src", F.col("_to").alias("id"))
        return written(left.join(own.withColumnRenamed("action", "dst"), "id"), reason)

    again = each["produces"].select("id").distinct()
    found = [
        pairs(each["releases"], each["destroys"], "release"), pairs(each["produces"], each["consumes"], "produce"),
        pairs(each["consumes"].join(again, "id", "left_anti"), each["destroys"], "consume"), pairs(each["destroys"], each["produces"], "replace"),
    ]
    if built is not None:
        found.append(along(built, "to_id", "from_id", "produces", "build"))
    if torn is not None:
        found.append(along(torn, "from_id", "to_id", "destroys", "teardown"))
    if parents is not None:
        found.append(along(parents.where("parent_id is not null"), "id", "parent_id", "destroys", "child"))
    return union(found)


def missing_requirements(actions: DataFrame, known: DataFrame) -> DataFrame:
    """``idx, id`` of what is consumed but neither produced nor in ``known(id)``."""
    return missing(touched(actions).withColumnRenamed("action", "idx"), known, "idx")


def missing(touches: DataFrame, known: DataFrame, name: str = "action") -> DataFrame:
    """Action and id of what is consumed but neither produced nor in ``known(id)``: a plan with any is refused."""
    produced = touches.where("role = 'produces'").select("id").unionByName(known.select("id")).distinct()
    return touches.where("role = 'consumes'").select(name, "id").join(produced, "id", "left_anti").select(name, "id")


def ordered(actions: DataFrame, edges: DataFrame, name: str = "idx", most: int = DRIVER_PLAN) -> DataFrame:
    """``idx, position`` of ``actions(idx, key)``: each behind all that ``edges(src, dst)`` put before it; raises on a cycle.

    Up to ``most`` actions and edges the driver gives the exact order, least
    key first among the ready ones.  A larger plan is ordered level by level,
    by key within a level, which respects every edge and collects nothing.
    """
    edges = edges.select("src", "dst").where("src <> dst")
    n = actions.count()
    if n <= most and n + (edges := edges.distinct()).count() <= most:
        nodes = [(r[name], r["key"]) for r in actions.select(name, "key").collect()]
        order = kahn(nodes, [(r["src"], r["dst"]) for r in edges.collect()])
        return actions.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order)], f"{name} {actions.schema[name].dataType.simpleString()}, position long")
    # The walk is over numbers: names are long.
    nodes = cut(actions.select(name, "key").withColumn("_n", F.monotonically_increasing_id()))
    at = lambda end: nodes.select(F.col(name).alias(end), F.col("_n").alias(f"_{end}"))
    walked = kept(lambda: edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    level = kept(lambda: levels(walked).withColumnRenamed("id", "_n"))
    return numbered(nodes.join(level, "_n", "left").select(name, "key", F.coalesce("level", F.lit(0)).alias("level")), "level", "key").select(name, F.col("position").cast("long"))


def with_boundaries(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``placed(action, position, commit_after, new_segment)`` where the first successor of each commit boundary opens a segment."""
    after = edges.join(placed.where("commit_after").select(F.col("action").alias("src")), "src").join(placed.select(F.col("action").alias("dst"), "position"), "dst")
    first = after.groupBy("src").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("_first")).distinct()
    return placed.join(first, "position", "left").withColumn("new_segment", F.col("new_segment") | F.coalesce("_first", F.lit(False))).drop("_first")


def in_segments(actions: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Add ``island``, the number of the action's segment.

    A segment opens at a non-transactional action, after one, after a commit
    boundary and where ``new_segment`` asks.  Groups (``by``) are plans: a plan
    is bounded.
    """
    w = Window.partitionBy(*by).orderBy(order)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    opens = F.col("non_tx") | before("non_tx") | before("commit_after") | F.col("new_segment") | F.lag(order).over(w).isNull()
    return islands(actions.withColumn("_opens", opens), F.col("_opens"), order, by)


def segments(actions: DataFrame, order: str, by: list[str]) -> DataFrame:
    """``by, island, first, last, transactional``: runs of actions that share a transaction."""
    marked = in_segments(actions, order, by)
    return marked.groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), (~F.max("non_tx")).alias("transactional"))


def segment_states(segments_: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Add ``status`` of each segment after an apply that stopped: applied, inDoubt or unapplied.

    ``done(by, island, outcome)``: ``committed``, ``failed`` (rolled back) or
    ``lost`` (no answer to the commit).  A failed non-transactional segment is in doubt.
    """
    named = segments_.join(done, [*by, "island"], "left")
    doubt = (F.col("outcome") == "lost") | ((F.col("outcome") == "failed") & ~F.col("transactional"))
    return named.withColumn("status", F.when(F.col("outcome") == "committed", "applied").when(doubt, "inDoubt").otherwise("unapplied")).drop("outcome")


def rendered(actions: DataFrame, order: str, by: list[str], size: int = 1000) -> DataFrame:
    """``by, island, piece, script``: all actions of each segment in order, ``size`` of them a piece."""
    w = Window.partitionBy(*by, "island").orderBy(order)
    placed = in_segments(actions, order, by).withColumn("piece", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return placed.groupBy(*by, "island", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.cast("string")), ",").alias("script"))


def safety_report(actions: DataFrame) -> DataFrame:
    """Counts of destructive, rewriting and non-transactional actions per lock class."""
    count = lambda c: F.count_if(F.col(c))
    return actions.groupBy("lock_class").agg(F.count(F.lit(1)).alias("actions"), count("destructive").alias("destructive"), count("rewrite").alias("rewrite"), count("non_tx").alias("non_transactional"))


def action_hazards() -> Column:
    """The hazards of an action (``destructive, rewrite, non_tx, lock_class``), in their order."""
    flags = (F.col("destructive"), F.col("rewrite"), F.col("non_tx"), F.col("lock_class") == "accessExclusive")
    return F.array_compact(F.array(*[F.when(f, h) for f, h in zip(flags, HAZARDS, strict=False)]))


def hazards(actions: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """``hazard, place, n``: those of actions, and of coverage by ``diagnostics(code)``, in the fixed order."""
    found = actions.select(F.explode(action_hazards()).alias("hazard"))
    if diagnostics is not None:
        found = found.unionByName(diagnostics.where(F.col("code").isin(*COVERAGE)).select(F.col("code").alias("hazard")))
    found = found.groupBy("hazard").agg(F.count(F.lit(1)).alias("n"))
    return found.select("hazard", F.array_position(F.array(*map(F.lit, HAZARDS)), F.col("hazard")).cast("int").alias("place"), "n")


def data_losses(actions: DataFrame) -> DataFrame:
    """The actions that lose data."""
    return actions.where("destructive")


def destruction_violations(actions: DataFrame, touches: DataFrame, facts: DataFrame, bearing: tuple[str, ...], kept: DataFrame | None = None) -> DataFrame:
    """``action, id``: facts that bear data and that an action destroys without saying so.

    A fact whose parent the same action destroys is the parent's matter; facts
    of ``kept(id)``, which accepted renames preserve, are no loss.
    """
    gone = touches.where("role = 'destroys'").select("action", "id").distinct()
    silent = gone.join(actions.where("not destructive").select("action"), "action", "left_semi").join(facts.where(F.col("kind").isin(*bearing)).select("id", "parent_id"), "id")
    own = silent.join(gone.select("action", F.col("id").alias("parent_id")), ["action", "parent_id"], "left_anti").select("action", "id")
    return own if kept is None else own.join(kept.select("id"), "id", "left_anti").select("action", "id")


def refused(deltas: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Deltas whose subject the extraction could not read (``unreadable(id)``): a plan with any is refused."""
    return deltas.join(unreadable.select("id").distinct(), "id", "left_semi")


def assumed(facts: DataFrame, edges: DataFrame, schemas: tuple[str, ...], roles: tuple[str, ...]) -> DataFrame:
    """``id`` of all that is taken as present: the named schemas and roles, and what lies below them."""
    start = facts.where((F.col("kind").isin("schema", "role")) & F.concat_ws(":", "kind", F.get(id_segments(F.col("id")), F.lit(0))).isin([f"schema:{s}" for s in schemas] + [f"role:{r}" for r in roles])).select("id")
    named = edges.where("edge_kind = 'owner'").select(F.col("to_id").alias("id")).where(F.col("id").isin([f"role:{r}" for r in roles]))
    return reach(start, facts.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))).unionByName(named).distinct()


def preamble(actions: DataFrame, routines: tuple[str, ...] = ("function", "procedure", "aggregate")) -> DataFrame:
    """One row: whether bodies must go unchecked, because a routine is touched."""
    return actions.agg(F.coalesce(F.bool_or(F.col("kind").isin(*routines)), F.lit(False)).alias("unchecked_bodies"))


def plan_id(placed: DataFrame) -> DataFrame:
    """One row: the hash of a plan (``position, verb, text, new_segment``); tasks hash pieces of 1,000 actions."""
    row = F.concat_ws("|", "verb", "text", F.col("new_segment").cast("string"))
    pieces = placed.groupBy(F.floor(F.col("position") / 1000).alias("piece")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("r")))), lambda x: x["r"]), "\n").cast("binary"), 256).alias("h"))
    return pieces.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "h"))), lambda x: x["h"]), ",").cast("binary"), 256).alias("plan_id"))


