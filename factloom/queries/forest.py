"""Snapshots of the entity forest: hashes, differences, views, policies, closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_map, content_hash, id_kind, id_name
from factloom.operators import diff, graph, policy, proof, view
from factloom.queries import query
from factloom.sources import tables
from factloom.sources.tables import SQL_A, edges, facts, multiset_sql, rolled, roles, table
from factloom.storage import small

GONE = """ga AS (SELECT id FROM fa WHERE id NOT IN (SELECT id FROM fb) UNION SELECT f.id FROM fa f JOIN ga ON f.parent_id = ga.id),
gb AS (SELECT id FROM fb WHERE id NOT IN (SELECT id FROM fa) UNION SELECT f.id FROM fb f JOIN gb ON f.parent_id = gb.id)"""
DELTAS = GONE + """,
deltas AS MATERIALIZED (SELECT 'remove' AS verb, id, NULL::VARCHAR AS attr, NULL::VARCHAR AS from_val, NULL::VARCHAR AS to_val FROM ga UNION ALL SELECT 'add', id, NULL, NULL, NULL FROM gb
  UNION ALL SELECT 'set', id, attr, x.val, y.val FROM ua x JOIN ub y USING (id, attr) WHERE x.val <> y.val AND id NOT IN (SELECT id FROM ga) AND id NOT IN (SELECT id FROM gb))"""
WITH = "WITH RECURSIVE " + tables.SQL + ","
WITH_A = "WITH RECURSIVE " + SQL_A + ","
#: The first number of an id; a line's is its order's.
KEY = "try_cast(split_part(split_part(id, ':', 2), '.', 1) as bigint)"


@query("WITH a AS (SELECT * FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey, c_acctbal::DECIMAL(18,2) + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS bal FROM customer WHERE c_custkey % 13 <> 0) SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'add' WHEN b.c_custkey IS NULL THEN 'remove' ELSE 'set' END AS verb FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_acctbal::DECIMAL(18,2) IS DISTINCT FROM b.bal")
def diff_customer(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("a"))
    b = c.where("c_custkey % 13 <> 0").select("c_custkey", (F.col("a") + F.when(F.col("c_custkey") % 17 == 0, 1).otherwise(0)).alias("b"))
    both = c.where("c_custkey % 11 <> 0").join(b, "c_custkey", "full").where("not a <=> b")
    return both.select("c_custkey", F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").otherwise("set").alias("verb"))


@query(WITH_A + "k AS (SELECT kind, count(*) AS facts FROM fa GROUP BY kind) SELECT * FROM k")
def snapshot_store(spark, d):
    """Extract both snapshots with edges and roll-ups; other queries read them."""
    for side in "ab":
        edges(spark, d, side)
        rolled(spark, d, side)
    return facts(spark, d, "a").groupBy("kind").agg(F.count(F.lit(1)).alias("facts"))


@query(WITH + DELTAS + "SELECT * FROM deltas")
def diff_facts(spark, d):
    return diff.fact_deltas(facts(spark, d, "a"), facts(spark, d, "b"))


def deltas(spark, d):
    """The deltas, written once, for queries that read them more than once."""
    return tables.stored(spark, d, "deltas", lambda: diff_facts(spark, d))


@query(WITH + DELTAS + "SELECT verb, split_part(id, ':', 1) AS kind, count(*) AS n FROM deltas GROUP BY ALL")
def delta_counts(spark, d):
    return diff_facts(spark, d).groupBy("verb", id_kind(F.col("id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + DELTAS + "SELECT verb, id, attr, row_number() OVER (ORDER BY concat_ws('|', id, verb, coalesce(attr, ''))) - 1 AS position FROM deltas")
def diff_ordered(spark, d):
    return graph.numbered(diff_facts(spark, d).select("verb", "id", "attr"), diff.delta_key())


@query(WITH + DELTAS + "SELECT * FROM deltas WHERE id NOT IN (SELECT id FROM ua WHERE kind = 'customer' AND attr = 'mktsegment' AND val = '\"BUILDING\"')")
def diff_refonly(spark, d):
    a = facts(spark, d, "a").withColumn("ref_only", (F.col("kind") == "customer") & (F.col("payload")["mktsegment"] == '"BUILDING"'))
    return diff.fact_deltas(a, facts(spark, d, "b"))


@query("WITH RECURSIVE " + tables.SQL + """,
b AS (SELECT id, CASE WHEN kind = 'order' AND (split_part(id, ':', 2)::BIGINT % 1000000000) % 23 = 0 THEN 'region:0' ELSE parent_id END AS parent_id FROM fb),
ga AS (SELECT id FROM fa WHERE id NOT IN (SELECT id FROM b) UNION SELECT f.id FROM fa f JOIN ga ON f.parent_id = ga.id),
gb AS (SELECT id FROM b WHERE id NOT IN (SELECT id FROM fa) UNION SELECT f.id FROM b f JOIN gb ON f.parent_id = gb.id)
SELECT 'remove' AS verb, id FROM ga UNION ALL SELECT 'add', id FROM gb""")
def diff_reparent(spark, d):
    return diff.fact_deltas(facts(spark, d, "a"), facts(spark, d, "b", reparent=True)).where("verb <> 'set'").select("verb", "id")


EDGE_DELTAS = "SELECT CASE WHEN x.from_id IS NULL THEN 'link' ELSE 'unlink' END AS verb, coalesce(x.from_id, y.from_id) AS from_id, coalesce(x.edge_kind, y.edge_kind) AS edge_kind, coalesce(x.to_id, y.to_id) AS to_id FROM (SELECT DISTINCT * FROM ea) x FULL OUTER JOIN (SELECT DISTINCT * FROM eb) y ON x.from_id = y.from_id AND x.to_id = y.to_id AND x.edge_kind = y.edge_kind WHERE x.from_id IS NULL OR y.from_id IS NULL"


@query("WITH " + tables.SQL + EDGE_DELTAS)
def diff_edges(spark, d):
    return diff.edge_deltas(edges(spark, d, "a"), edges(spark, d, "b"))


@query("WITH " + tables.SQL + f", x AS ({EDGE_DELTAS}) SELECT * FROM x WHERE from_id NOT IN (SELECT id FROM fa WHERE kind = 'part' UNION SELECT id FROM fb WHERE kind = 'part')")
def diff_edges_refonly(spark, d):
    """Edges that leave a part, which either side holds for reference only, have no delta."""
    refs = graph.union([facts(spark, d, s).where("kind = 'part'").select("id") for s in "ab"]).distinct()
    return diff.edge_deltas(edges(spark, d, "a"), edges(spark, d, "b"), refs)


@query("WITH " + SQL_A + "SELECT id, kind, hash FROM fa")
def fact_hash(spark, d):
    return facts(spark, d, "a").select("id", "kind", content_hash(F.col("payload")).alias("hash"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_ids(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)")
def missing_parents(spark, d):
    kept = table(spark, d, "customer").where("c_custkey % 11 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    return table(spark, d, "orders").join(kept, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("WITH " + SQL_A + "SELECT from_id, to_id, edge_kind FROM ea WHERE from_id NOT IN (SELECT id FROM fa) OR to_id NOT IN (SELECT id FROM fa) AND edge_kind <> 'owner'")
def dangling_edges(spark, d):
    ids = facts(spark, d, "a").select("id")
    e = edges(spark, d, "a").join(ids.select(F.col("id").alias("from_id"), F.lit(1).alias("f")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(1).alias("t")), "to_id", "left")
    return e.where("f is null or (t is null and edge_kind <> 'owner')").select("from_id", "to_id", "edge_kind")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def orphan_prune(spark, d):
    """Satellites (labels) whose target is there."""
    return table(spark, d, "labels").join(table(spark, d, "documents").where("doc_id % 7 <> 0"), "doc_id", "left_semi").select("doc_id", "quality")


def _level(name: str, kinds: str, children: str | None) -> str:
    """Roll-ups of one depth: children of ``children``'s level enter as a multiset."""
    below = f"LEFT JOIN (SELECT parent_id AS id, {multiset_sql('h')} AS c, {multiset_sql('s')} AS cs FROM (SELECT parent_id, sha256(id || '=' || r) AS h, s FROM {children}) GROUP BY parent_id) USING (id)" if children else ""
    c, cs = ("coalesce(c, '')", "coalesce(cs, '')") if children else ("''", "''")
    return f"{name} AS MATERIALIZED (SELECT f.id, f.parent_id, sha256('F|' || f.hash || '|C|' || {c} || '|E|' || coalesce(e, '')) AS r, sha256('S|' || f.hash || '|C|' || {cs}) AS s FROM fa f LEFT JOIN es USING (id) {below} WHERE f.kind IN ({kinds}))"


ROLL = WITH_A + f"es AS MATERIALIZED (SELECT from_id AS id, {multiset_sql('h')} AS e FROM (SELECT from_id, sha256(from_id || '-[' || edge_kind || ']->' || to_id) AS h FROM ea) GROUP BY from_id)," + ",".join(
    [_level("r4", "'line'", None), _level("r3", "'order'", "r4"), _level("r2", "'customer', 'supplier'", "r3"), _level("r1", "'nation'", "r2"), _level("r0", "'region', 'part'", "r1")]
)
ALL_LEVELS = "(" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(5)) + ")"


@query(ROLL + f"SELECT id, r AS rollup FROM {ALL_LEVELS}")
def rollup_facts(spark, d):
    return graph.rollups(facts(spark, d, "a"), edges(spark, d, "a")).select("id", "rollup")


@query(ROLL + f"SELECT id, s AS structural FROM {ALL_LEVELS}")
def structural_rollup(spark, d):
    return rolled(spark, d, "a").select("id", "structural")


@query(ROLL + f"SELECT sha256('ROOT|' || {multiset_sql('h')}) AS root_hash FROM (SELECT sha256(id || '=' || r) AS h FROM r0)")
def root_hash(spark, d):
    return graph.root_hash(rolled(spark, d, "a"))


@query()
def diff_pruned(spark, d):
    """Facts by kind that lie outside, and inside, subtrees of equal roll-ups."""
    left = diff.unequal(rolled(spark, d, "a"), rolled(spark, d, "b")).withColumn("visited", F.lit(True))
    ids = graph.union([facts(spark, d, s).select("id", "kind") for s in "ab"])
    count = lambda own, found: own.distinct().join(found, "id", "left").groupBy("kind").agg(F.count_if(F.col("visited")).alias("visited"), F.count_if(F.col("visited").isNull()).alias("skipped"))
    return graph.sliced([ids, left], count).groupBy("kind").agg(F.sum("visited").alias("visited"), F.sum("skipped").alias("skipped"))


@query("WITH " + SQL_A + "SELECT from_id AS id, string_agg(DISTINCT edge_kind || '->' || to_id, '|' ORDER BY edge_kind || '->' || to_id) AS signature FROM ea GROUP BY from_id")
def edge_signature(spark, d):
    return graph.edge_signature(edges(spark, d, "a"))


BASE = "base AS MATERIALIZED (SELECT * FROM fa WHERE kind IN ('region', 'nation') OR split_part(split_part(id, ':', 2), '.', 1)::BIGINT % 5 = 0), k AS (SELECT id, parent_id FROM fa WHERE id NOT IN (SELECT id FROM base) UNION SELECT fa.id, fa.parent_id FROM fa JOIN k ON k.parent_id = fa.id)"


def _subtracted(spark, d):
    a, e = facts(spark, d, "a"), edges(spark, d, "a")
    return view.subtract_baseline(a, e, a.where(f"kind in ('region', 'nation') or {KEY} % 5 = 0"), e)


@query(WITH_A + BASE + "SELECT DISTINCT id FROM k")
def baseline_subtract(spark, d):
    return _subtracted(spark, d)[0].select("id")


@query(WITH_A + BASE + "SELECT from_id, to_id, edge_kind FROM ea WHERE from_id IN (SELECT id FROM k) AND (to_id IN (SELECT id FROM k) OR edge_kind = 'owner')")
def baseline_edges(spark, d):
    return _subtracted(spark, d)[1].select("from_id", "to_id", "edge_kind")


@query(WITH_A + "g AS (SELECT id FROM fa WHERE id = 'region:1' UNION SELECT fa.id FROM fa JOIN g ON fa.parent_id = g.id) SELECT id FROM fa WHERE id NOT IN (SELECT id FROM g)")
def exclude_subtree(spark, d):
    a = facts(spark, d, "a")
    return view.exclude_subtrees(a, edges(spark, d, "a"), a.where("id = 'region:1'").select("id"))[0].select("id")


@query(WITH_A + "g AS (SELECT from_id AS id FROM ea WHERE edge_kind = 'managedBy' UNION SELECT fa.id FROM fa JOIN g ON fa.parent_id = g.id) SELECT id FROM fa WHERE id NOT IN (SELECT id FROM g)")
def provenance_exclude(spark, d):
    """Managed orders go with their lines."""
    a, e = facts(spark, d, "a"), edges(spark, d, "a")
    return view.exclude_subtrees(a, e, view.provenance_roots(e, "managedBy"))[0].select("id")


ROLES = """seg AS (SELECT DISTINCT c_mktsegment AS s FROM customer),
fr AS MATERIALIZED (SELECT id, kind, parent_id FROM fa UNION ALL SELECT 'role:' || s, 'role', NULL FROM seg UNION ALL SELECT 'membership:' || s, 'membership', 'role:' || s FROM seg
  UNION ALL SELECT 'comment:(order:' || o_orderkey || ')', 'comment', 'order:' || o_orderkey FROM oa WHERE o_orderstatus = 'F'),
er AS MATERIALIZED (SELECT * FROM ea UNION ALL SELECT 'membership:' || s, 'role:' || s, 'depends' FROM seg)"""


def _with_roles(spark, d):
    more, links = roles(spark, d)
    return graph.cut(facts(spark, d, "a").unionByName(more)), edges(spark, d, "a").unionByName(links)


@query(WITH_A + ROLES + ", m AS (SELECT id, kind FROM fr WHERE kind IN ('nation', 'customer') AND TRY_CAST(split_part(id, ':', 2) AS BIGINT) % 10 = 3), c AS (SELECT id FROM m WHERE kind <> 'nation' UNION SELECT fr.id FROM fr JOIN c ON fr.parent_id = c.id WHERE fr.kind <> 'comment') SELECT id FROM m UNION SELECT id FROM c")
def member_closure(spark, d):
    """Below members lie orders, lines and comments: nations are a boundary, comments are satellites."""
    a, _ = _with_roles(spark, d)
    members = a.where(f"kind in ('nation', 'customer') and {KEY} % 10 = 3")
    e = members.select(F.col("id").alias("from_id"), F.lit("extension:x").alias("to_id"), F.lit("memberOfExtension").alias("edge_kind"))
    return view.member_closure(a, e, "nation", ["comment", "acl", "securityLabel"])


KEPT = "kf AS (SELECT id FROM fr WHERE kind NOT IN ('role', 'membership'))"


@query(WITH_A + ROLES + "," + KEPT + " SELECT from_id, to_id, edge_kind FROM er WHERE from_id IN (SELECT id FROM kf) AND (to_id IN (SELECT id FROM kf) OR edge_kind = 'owner' AND to_id <> 'role:BUILDING')")
def scope_projection(spark, d):
    """Roles and memberships go; owner edges dangle, but those to the default owner."""
    return view.scoped(*_with_roles(spark, d), "database", "role:BUILDING")[1].select("from_id", "to_id", "edge_kind")


@query(WITH_A + ROLES + "," + KEPT + " SELECT id, kind FROM fr WHERE id IN (SELECT id FROM kf)")
def scope_facts(spark, d):
    return view.scoped(*_with_roles(spark, d), "database", "role:BUILDING")[0].select("id", "kind")


RESOLVED = ROLES + """,
mem AS (SELECT from_id AS id FROM er WHERE edge_kind = 'memberOfExtension'),
base AS (SELECT id FROM fr WHERE kind IN ('region', 'nation')),
up AS (SELECT id, parent_id FROM fr WHERE id NOT IN (SELECT id FROM base) UNION SELECT fr.id, fr.parent_id FROM fr JOIN up ON up.parent_id = fr.id),
s1 AS MATERIALIZED (SELECT fr.* FROM fr WHERE id IN (SELECT id FROM up)),
out2 AS (SELECT id FROM s1 WHERE kind = 'supplier' OR id IN (SELECT from_id FROM er WHERE edge_kind = 'managedBy') OR kind = 'customer' AND split_part(id, ':', 2)::BIGINT % 7 = 0 UNION SELECT s1.id FROM s1 JOIN out2 ON s1.parent_id = out2.id),
s2 AS MATERIALIZED (SELECT * FROM s1 WHERE id NOT IN (SELECT id FROM out2)),
ref AS (SELECT id FROM s2 WHERE kind = 'customer' AND split_part(id, ':', 2)::BIGINT % 5 = 0 UNION SELECT s2.id FROM s2 JOIN ref ON s2.parent_id = ref.id)
"""


def _resolved(spark, d, f=view.resolved, **more):
    a, e = _with_roles(spark, d)
    base = a.where("kind in ('region', 'nation')")
    excluded = policy.excludes(policy.Policy("scope", (policy.Rule({"kind": "customer", "any": [{"idField": {"five": "y"}}, {"idField": {"seven": "y"}}]}, "exclude", "customers"), policy.Rule({"verb": "set"}, "exclude", "skipped"))))
    named = a.withColumns({"five": F.when((F.col("kind") == "customer") & (F.expr(KEY) % 5 == 0), "y"), "seven": F.when((F.col("kind") == "customer") & (F.expr(KEY) % 7 == 0), "y")})
    assumed = (F.col("five") == "y") & F.col("seven").isNull()
    return f(named, e, base=(base, e.where("false")), incapable=F.col("kind") == "supplier", excluded=excluded, assumed=assumed, **more)


@query(WITH_A + RESOLVED + "SELECT id, kind, id IN (SELECT id FROM ref) OR id IN (SELECT id FROM mem) AS ref_only FROM s2")
def resolve_view(spark, d):
    """Baseline, handlers, capability and policy in their order; members and assumed facts stay for reference."""
    return _resolved(spark, d)[0].select("id", "kind", "ref_only")


@query(WITH_A + RESOLVED + "SELECT from_id, to_id, edge_kind FROM er WHERE from_id IN (SELECT id FROM s2 WHERE kind NOT IN ('role', 'membership')) AND (to_id IN (SELECT id FROM s2 WHERE kind NOT IN ('role', 'membership')) OR edge_kind = 'owner' AND to_id <> 'role:MACHINERY')")
def managed_view(spark, d):
    return _resolved(spark, d, view.managed, scope="database", default_owner="role:MACHINERY")[1].select("from_id", "to_id", "edge_kind")


POLICY = policy.Policy("outer", (policy.Rule({"verb": "remove", "kind": "order"}, "exclude", "keep-orders"), policy.Rule({"all": [{"verb": "set"}, {"idField": {"attr": "acct*"}}]}, "exclude", "balances")), (policy.Policy("inner", (policy.Rule({"name": "1*", "not": {"verb": "set"}}, "include", "ones"), policy.Rule({"any": [{"kind": "customer"}, {"name": "*9"}]}, "exclude", "rest"))),))
POLICY_SQL = "CASE WHEN verb = 'remove' AND kind = 'order' THEN 'keep-orders' WHEN verb = 'set' AND attr LIKE 'acct%' THEN 'balances' WHEN name LIKE '1%' AND verb <> 'set' THEN 'ones' WHEN kind = 'customer' OR name LIKE '%9' THEN 'rest' ELSE 'default' END"
NAMED = ", n AS (SELECT *, split_part(id, ':', 1) AS kind, split_part(split_part(id, ':', 2), '.', -1) AS name FROM deltas)"
DECIDED = NAMED + f", r AS MATERIALIZED (SELECT *, {POLICY_SQL} AS reason FROM n)"


def _decided(found):
    named = found.withColumns({"kind": id_kind(F.col("id")), "name": id_name(F.col("id"))})
    policy.validate(POLICY, named.columns)
    action, reason = policy.decide(POLICY)
    return named.withColumns({"action": action, "reason": reason})


@query(WITH + DELTAS + DECIDED + " SELECT verb, id, attr, CASE WHEN reason IN ('ones', 'default') THEN 'include' ELSE 'exclude' END AS action, reason FROM r")
def policy_filter(spark, d):
    return _decided(diff_facts(spark, d)).select("verb", "id", "attr", "action", "reason")


@query(WITH + DELTAS + DECIDED + " SELECT verb, id, attr, CASE WHEN reason IN ('ones', 'default') THEN NULL WHEN reason = 'balances' THEN 'acknowledged' ELSE 'suspicious' END AS attribution FROM r")
def policy_attribution(spark, d):
    return _decided(diff_facts(spark, d)).select("verb", "id", "attr", policy.attribution(POLICY, {"balances"}).alias("attribution"))


@query("WITH " + SQL_A + ", st AS (SELECT id FROM ua WHERE kind = 'order' AND attr = 'status' AND NOT val LIKE '\"O%') SELECT id FROM fa WHERE kind = 'order' AND parent_id LIKE 'customer:1%' AND id IN (SELECT id FROM st) OR id IN (SELECT from_id FROM ea WHERE edge_kind = 'owner' AND to_id LIKE 'role:M%')")
def policy_predicates(spark, d):
    e = edges(spark, d, "a").groupBy(F.col("from_id").alias("id")).agg(F.collect_list(F.struct("edge_kind", "to_id")).alias("edges"))
    named = facts(spark, d, "a").join(e, "id", "left").withColumn("status", F.col("payload")["status"])
    own = {"kind": "order", "parentKind": "customer", "idField": {"parent_id": "customer:1*"}, "not": {"idField": {"status": '"O*'}}}
    return named.where(policy.predicate({"any": [own, {"edgeTo": {"kind": "owner", "to": {"kind": "role", "name": "M*"}}}]})).select("id")


@query(WITH_A + ROLES + """, x AS (SELECT from_id AS id, split_part(to_id, ':', 2) AS x FROM er WHERE edge_kind = 'memberOfExtension'), o AS (SELECT from_id AS id, split_part(to_id, ':', 2) AS owner FROM er WHERE edge_kind = 'owner')
SELECT id, CASE WHEN id IN (SELECT id FROM o WHERE owner LIKE 'BU%') THEN 'owner' WHEN id IN (SELECT id FROM x WHERE x LIKE 'Brand#1%') THEN 'extension' WHEN kind = 'comment' AND split_part(split_part(id, 'order:', 2), ')', 1) LIKE '%7' THEN 'target' ELSE 'none' END AS hit FROM fr""")
def policy_features(spark, d):
    """Owner, extension of the parent chain and target of satellites."""
    a, e = _with_roles(spark, d)
    found = policy.featured(a, e)
    hit = F.when(policy.predicate({"owner": "BU*"}), "owner").when(policy.predicate({"ownedByExtension": "Brand#1*"}), "extension").when(policy.predicate({"target": {"kind": "order", "name": "*7"}}), "target").otherwise("none")
    return found.select("id", hit.alias("hit"))


@query(WITH + DELTAS + DECIDED + " SELECT reason, kind, count(*) AS n, count(*) FILTER (verb = 'set') AS sets FROM r WHERE reason NOT IN ('ones', 'default') GROUP BY ALL")
def projection_audit(spark, d):
    return _decided(diff_facts(spark, d)).where("action = 'exclude'").groupBy("reason", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verb") == "set").alias("sets"))


@query(WITH + DELTAS + DECIDED + """, x AS MATERIALIZED (SELECT * FROM r WHERE reason NOT IN ('ones', 'default')),
kept AS (SELECT id, 'b' AS o, parent_id FROM fb WHERE id NOT IN (SELECT id FROM x WHERE verb = 'add')),
al AS MATERIALIZED (SELECT * FROM kept UNION ALL SELECT id, 'a', parent_id FROM fa WHERE id IN (SELECT id FROM x WHERE verb = 'remove') AND id NOT IN (SELECT id FROM kept)),
t AS (SELECT id FROM al WHERE parent_id IS NULL UNION SELECT al.id FROM al JOIN t ON al.parent_id = t.id),
v AS (SELECT al.id, ub.attr, ub.val FROM al JOIN ub ON o = 'b' AND ub.id = al.id WHERE al.id IN (SELECT id FROM t) UNION ALL SELECT al.id, ua.attr, ua.val FROM al JOIN ua ON o = 'a' AND ua.id = al.id WHERE al.id IN (SELECT id FROM t)),
w AS (SELECT v.id, v.attr, coalesce(x.from_val, v.val) AS val FROM v LEFT JOIN x ON x.verb = 'set' AND x.id = v.id AND x.attr = v.attr)
SELECT id, '{' || string_agg('"' || attr || '":' || val, ',' ORDER BY attr) || '}' AS payload FROM w GROUP BY id""")
def project_target(spark, d):
    undone = _decided(deltas(spark, d)).where("action = 'exclude'").select("verb", "id", "attr", "from_val", "to_val")
    t = view.project_target(facts(spark, d, "b"), undone, facts(spark, d, "a"))
    return t.select("id", canonical_map(F.col("payload")).alias("payload"))


def _lone(spark, d):
    """Removed and added facts of all kinds below common ones or none, with their structural roll-up."""
    a, b = (facts(spark, d, s) for s in "ab")
    found = []
    for side, own, other in (("a", a, b), ("b", b, a)):
        lone = graph.cut(view.lone(own.select("id", "kind", "parent_id", "hash"), other).withColumn("parent_id", F.coalesce("parent_id", F.lit(""))))
        structural = rolled(spark, d, side).select("id", "structural")
        found.append(graph.cut(structural.join(small(lone, lone.count()), "id").select("id", "kind", "parent_id", "hash", "structural")))
    return found


@query()
def rename_candidates(spark, d):
    return view.rename_candidates(*_lone(spark, d), ["kind", "parent_id", "structural"])


@query()
def rename_near_miss(spark, d):
    return view.near_misses(*_lone(spark, d), ["kind", "parent_id", "hash"], "structural")


@query()
def rename_checked(spark, d):
    """Unambiguous renames, and whether the target confirms them."""
    renames = view.accepted(rename_candidates(spark, d), "auto")
    return view.confirmed(renames, rolled(spark, d, "a"), edges(spark, d, "a"), rolled(spark, d, "b"), edges(spark, d, "b"))


@query("WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 19 = 0)), l AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0 AND o_custkey % 11 <> 0) SELECT 'part:' || k AS id FROM p UNION ALL SELECT concat_ws('.', 'line:' || l_orderkey, l_linenumber, l_partkey, l_suppkey, i) FROM l JOIN p ON l_partkey = k")
def rebuild_closure(spark, d):
    """What depends on parts that b lacks or changes."""
    a, parts = facts(spark, d, "a"), F.col("kind") == "part"
    start = diff.fact_deltas(a.where(parts), facts(spark, d, "b").where(parts)).where("verb <> 'add'").select("id").distinct()
    back = edges(spark, d, "a").where("edge_kind = 'depends'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return graph.reach(start, back.unionByName(graph.child_edges(a)).distinct())


@query(WITH_A + "x AS MATERIALIZED (SELECT id, kind, parent_id FROM fa WHERE kind IN ('customer', 'order', 'line') AND split_part(split_part(id, ':', 2), '.', 1)::BIGINT % 3 = 0), c AS (SELECT id, id AS root, parent_id FROM x WHERE kind = 'customer' OR parent_id NOT IN (SELECT id FROM x) UNION ALL SELECT x.id, c.root, x.parent_id FROM x JOIN c ON x.parent_id = c.id) SELECT id, root AS drop_root FROM c")
def drop_roots(spark, d):
    a = facts(spark, d, "a")
    removed = a.where(f"kind in ('customer', 'order', 'line') and {KEY} % 3 = 0")
    return view.drop_roots(a, removed, ["nation", "customer", "order"])


DEPTH = "(CASE kind WHEN 'region' THEN 0 WHEN 'part' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'supplier' THEN 2 WHEN 'order' THEN 3 ELSE 4 END)::INTEGER"


@query("WITH " + SQL_A + f"SELECT id, {DEPTH} AS depth FROM fa")
def fact_depths(spark, d):
    return graph.depths(facts(spark, d, "a"))


@query("WITH " + SQL_A + "SELECT id FROM fa WHERE parent_id IS NULL")
def roots(spark, d):
    return facts(spark, d, "a").where("parent_id is null").select("id")


@query(WITH_A + "x AS (SELECT id, id AS ancestor, 0 AS distance FROM fa UNION ALL SELECT x.id, f.parent_id, distance + 1 FROM x JOIN fa f ON f.id = x.ancestor WHERE f.parent_id IS NOT NULL) SELECT id, ancestor, distance::INTEGER AS distance FROM x")
def ancestor_chain(spark, d):
    return graph.ancestors(facts(spark, d, "a"))


@query("WITH " + SQL_A + f"SELECT id, {DEPTH} AS level FROM fa WHERE parent_id IS NOT NULL OR id IN (SELECT parent_id FROM fa)")
def topo_level(spark, d):
    return graph.levels(graph.child_edges(facts(spark, d, "a")))


@query(WITH_A + "x AS MATERIALIZED (SELECT id, kind, parent_id FROM fa WHERE kind IN ('customer', 'order', 'line') AND split_part(split_part(id, ':', 2), '.', 1)::BIGINT % 3 = 0), c AS (SELECT id FROM x UNION SELECT fa.id FROM fa JOIN c ON fa.parent_id = c.id), b AS (SELECT fa.id FROM fa JOIN x ON fa.parent_id = x.id UNION SELECT fa.id FROM fa JOIN b ON fa.parent_id = b.id) SELECT id FROM x WHERE id NOT IN (SELECT id FROM b)")
def topmost_ids(spark, d):
    """Of some customers, orders and lines those below no other."""
    a = facts(spark, d, "a")
    return graph.topmost(a.where(f"kind in ('customer', 'order', 'line') and {KEY} % 3 = 0").select("id"), a)


@query()
def scc(spark, d):
    """Users are linked to the user of the next event of their event's type and hour."""
    return graph.strong_components(_user_edges(spark, d))


def _user_edges(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", F.date_trunc("hour", F.col("ts"))).orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return graph.cut(e.where("dst is not null").distinct())


@query()
def scc_condensation(spark, d):
    return graph.condensation(_user_edges(spark, d))[1]


@query()
def path_tests(spark, d):
    """Whether each user reaches the next by number."""
    e = _user_edges(spark, d)
    users = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.paths(users.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), e)


@query("WITH " + SQL_A + "SELECT from_id, CASE WHEN to_id = 'role:BUILDING' THEN 'role:HOUSING' ELSE to_id END AS to_id FROM ea WHERE edge_kind = 'owner'")
def identity_normalise(spark, d):
    names = spark.createDataFrame([("role:BUILDING", "role:HOUSING")], "old string, new string")
    return view.normalise_ids(edges(spark, d, "a").where("edge_kind = 'owner'"), names).select("from_id", "to_id")


@query("WITH " + SQL_A + "SELECT id, CASE WHEN val = '\"BUILDING\"' THEN '\"HOUSING\"' ELSE val END AS segment FROM ua WHERE kind = 'customer' AND attr = 'mktsegment'")
def payload_normalise(spark, d):
    new = view.normalise_payloads(facts(spark, d, "a").where("kind = 'customer'"), {'"BUILDING"': '"HOUSING"'}, ["mktsegment"])
    return new.select("id", F.col("payload")["mktsegment"].alias("segment"))


@query(WITH + GONE + ", x AS (SELECT coalesce(fa.id, fb.id) AS id, CASE WHEN fa.id IS NULL THEN 'missing' WHEN fb.id IS NULL THEN 'extra' ELSE 'different' END AS state FROM fa FULL JOIN fb ON fa.id = fb.id WHERE fa.hash IS DISTINCT FROM fb.hash) SELECT * FROM x")
def drift(spark, d):
    """What a database in state a lacks against snapshot b."""
    return proof.drift(facts(spark, d, "a"), facts(spark, d, "b"))


@query("SELECT 0::BIGINT AS drift, 0::BIGINT AS violations, 'proved' AS verdict")
def prove_plan(spark, d):
    """All deltas applied to a, without those on the other chain, give b."""
    a, b = facts(spark, d, "a"), facts(spark, d, "b")
    return proof.proved(a, b, graph.cut(diff.fact_deltas(a, b))).select("drift", "violations", "verdict")
