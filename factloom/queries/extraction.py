"""Shapes of extraction, tables as proof sees them, and exported files."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import export, extraction, proof
from factloom.queries import query
from factloom.sources.tables import multiset_sql, table

GRANTS = "g{0} AS (SELECT 'nation:' || c_nationkey AS object, c_mktsegment AS grantee, o_orderpriority AS privilege, o_orderstatus = 'P' AS grantable FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % {1} <> 0), a{0} AS (SELECT object, grantee, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges, coalesce(string_agg(DISTINCT privilege, ',' ORDER BY privilege) FILTER (grantable), '') AS grantable FROM g{0} GROUP BY ALL)"
ALL = "WITH " + GRANTS.format("a", 11)
BOTH = ALL + "," + GRANTS.format("b", 13)


def _grants(spark, d, skip):
    own = table(spark, d, "orders").where(f"o_orderkey % {skip} <> 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return extraction.grants(own.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("object"), F.col("c_mktsegment").alias("grantee"), F.col("o_orderpriority").alias("privilege"), (F.col("o_orderstatus") == "P").alias("grantable")))


@query(ALL + "SELECT * FROM aa")
def acl_aggregate(spark, d):
    return _grants(spark, d, 11)


@query(ALL + ", r AS (SELECT 'nation:' || n_nationkey AS object FROM nation), x AS (SELECT * FROM aa UNION ALL SELECT object, g, '', '' FROM r, (VALUES ('PUBLIC'), ('BUILDING')) v(g) WHERE NOT EXISTS (SELECT 1 FROM aa WHERE aa.object = r.object AND aa.grantee = g)) SELECT * FROM x")
def acl_revoked_defaults(spark, d):
    """Grants, and an empty row where PUBLIC or the owner lost what a new object gives."""
    objects = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("object"), F.lit("BUILDING").alias("owner"))
    return extraction.with_revoked(_grants(spark, d, 11), objects)


@query(BOTH + "SELECT object, grantee, aa.privileges AS now, ab.privileges AS before FROM aa FULL OUTER JOIN ab USING (object, grantee) WHERE aa.privileges IS DISTINCT FROM ab.privileges")
def acl_delta(spark, d):
    return extraction.grants_against(_grants(spark, d, 11), _grants(spark, d, 13))


@query(BOTH + ", x AS (SELECT object, grantee, aa.privileges FROM aa FULL OUTER JOIN ab USING (object, grantee) WHERE aa.privileges IS DISTINCT FROM ab.privileges) SELECT object, grantee, coalesce(privileges, '') AS privileges FROM x WHERE split_part(object, ':', 2)::INT % 2 = 0 UNION ALL SELECT object, grantee, privileges FROM aa WHERE split_part(object, ':', 2)::INT % 2 <> 0")
def acl_switch(spark, d):
    """Members (even nations) show what differs from their installed grants, all others their grants."""
    members = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("object"))
    return extraction.grants_of_members(_grants(spark, d, 11), _grants(spark, d, 13), members)


@query(BOTH + ", x AS (SELECT * FROM aa WHERE grantee <> 'BUILDING') SELECT object, grantee, x.privileges FROM x LEFT JOIN ab USING (object, grantee) WHERE x.privileges IS DISTINCT FROM ab.privileges UNION ALL SELECT object, grantee, '' FROM ab WHERE object IN (SELECT object FROM x) AND NOT EXISTS (SELECT 1 FROM x WHERE x.object = ab.object AND x.grantee = ab.grantee)")
def default_priv_deviation(spark, d):
    return extraction.deviations(_grants(spark, d, 11).where("grantee <> 'BUILDING'"), _grants(spark, d, 13))


@query("SELECT 'part:' || p_partkey AS role, 'supplier:' || s_suppkey AS member, bool_or(l_returnflag = 'R') AS admin FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def membership_dedupe(spark, d):
    """Many lines grant a supplier a part: one membership, admin if any is."""
    line, part, supp = (table(spark, d, n) for n in ("lineitem", "part", "supplier"))
    roles = part.select(F.col("p_partkey").alias("oid"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("name"))
    members = supp.select(F.col("s_suppkey").alias("oid"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("name"))
    return extraction.memberships(line.select(F.col("l_partkey").alias("role"), F.col("l_suppkey").alias("member"), (F.col("l_returnflag") == "R").alias("admin")), roles, members)


RESOLVE = "p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0), q AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 <> 0)"


def _resolvers(spark, d):
    part, supp = table(spark, d, "part"), table(spark, d, "supplier")
    named = lambda df, c, k, p: df.select(F.lit(c).alias("class"), F.col(k).alias("obj"), F.concat(F.lit(p), F.col(k).cast("string")).alias("id"))
    return [named(part.where("p_partkey % 3 <> 0"), "part", "p_partkey", "part:"), named(part.where("p_partkey % 5 <> 0"), "part", "p_partkey", "spare:"), named(supp.where("s_suppkey % 4 <> 0"), "supplier", "s_suppkey", "supplier:")]


@query(f"WITH e AS (SELECT DISTINCT 'part' AS class, l_partkey AS obj FROM lineitem UNION SELECT 'supplier', l_suppkey FROM lineitem), {RESOLVE} SELECT class, obj, CASE class WHEN 'part' THEN coalesce('part:' || p.k, 'spare:' || q.k) ELSE 'supplier:' || s.k END AS id FROM e LEFT JOIN p ON class = 'part' AND obj = p.k LEFT JOIN q ON class = 'part' AND obj = q.k LEFT JOIN s ON class = 'supplier' AND obj = s.k")
def dependency_resolver(spark, d):
    line = table(spark, d, "lineitem")
    ends = line.select(F.lit("part").alias("class"), F.col("l_partkey").alias("obj")).unionByName(line.select(F.lit("supplier").alias("class"), F.col("l_suppkey").alias("obj")))
    return extraction.resolve(ends, _resolvers(spark, d))


@query(f"WITH {RESOLVE}, e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT DISTINCT coalesce('part:' || p.k, 'spare:' || q.k) AS from_id, 'supplier:' || s.k AS to_id FROM e LEFT JOIN p ON l_partkey = p.k LEFT JOIN q ON l_partkey = q.k JOIN s ON l_suppkey = s.k WHERE coalesce(p.k, q.k) IS NOT NULL")
def dependency_edges(spark, d):
    """Both ends of each dependency joined back to their ids; rows with an unknown end go."""
    rows = table(spark, d, "lineitem").select(F.lit("part").alias("class"), F.col("l_partkey").alias("obj"), F.lit("supplier").alias("ref_class"), F.col("l_suppkey").alias("ref_obj"))
    return extraction.resolved_edges(rows, _resolvers(spark, d))


@query("WITH e AS (SELECT DISTINCT 'order:' || l_orderkey AS f, 'part:' || l_partkey AS t FROM lineitem WHERE l_orderkey % 10 <> 0) SELECT f AS from_id, t AS to_id FROM e WHERE NOT (split_part(f, ':', 2)::BIGINT % 4 = 1 AND split_part(t, ':', 2)::BIGINT % 2 = 0)")
def dependency_cleanup(spark, d):
    """Without system ids (orders divisible by 10), repeated rows, and edges that a default fact stands for."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("to_id"))
    key = lambda c: F.split_part(c, F.lit(":"), F.lit(2)).cast("long")
    shadowed = rows.where((key("from_id") % 4 == 1) & (key("to_id") % 2 == 0))
    return extraction.cleaned_edges(rows, F.col("from_id").endswith("0"), shadowed)


@query("WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part) SELECT p_type, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (i <= 5) AS samples FROM r GROUP BY p_type")
def unmodeled_samples(spark, d):
    return extraction.samples(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@query("WITH k AS (SELECT 'part' AS kind, p_partkey AS id FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'user', user_id FROM (SELECT DISTINCT user_id FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS i FROM k) SELECT kind, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (i <= 5) AS samples FROM r GROUP BY kind")
def unmodeled_probe(spark, d):
    """Count and first five of each unmodeled kind."""
    kinds = {"part": table(spark, d, "part").select(F.col("p_partkey").alias("id")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "user": table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()}
    return extraction.probes(kinds)


@query("SELECT p_type, count(*) AS n FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 = 0 GROUP BY p_type")
def unmodeled_drift(spark, d):
    part = table(spark, d, "part")
    return extraction.unmodeled_drift(part.where("p_partkey % 11 <> 0"), part.where("p_partkey % 13 <> 0"), "p_partkey", "p_type")


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS args, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS first_parent FROM lineitem GROUP BY l_orderkey")
def ordered_args(spark, d):
    return extraction.ordered_arguments(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_suppkey")


@query("SELECT page_id, CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) || '?' || array_to_string(list_transform(string_split(split_part(url, '?', 2), '&'), lambda p: CASE WHEN split_part(p, '=', 1) = 'page' OR NOT contains(p, '=') THEN p ELSE split_part(p, '=', 1) || '=***' END), '&') ELSE url END AS url FROM pages")
def redact_options(spark, d):
    return table(spark, d, "pages").select("page_id", extraction.redact(F.col("url"), ["page"]).alias("url"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS present FROM customer")
def exists_filter(spark, d):
    return extraction.with_presence(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS key, count(*) AS rows FROM {n}" for n in NAMES) + ")")
def table_counts(spark, d):
    return table_fingerprint(spark, d).select("key", "rows")


FLAT = "concat_ws('|', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)"


@query(f"SELECT c_nationkey AS key, count(*) AS rows, {multiset_sql('h')} AS content FROM (SELECT c_nationkey, sha256({FLAT}) AS h FROM customer) GROUP BY 1")
def group_fingerprint(spark, d):
    """Content hash of customers by nation, over their exact columns."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("row"))
    return extraction.fingerprint(rows, "key")


@query()
def table_fingerprint(spark, d):
    """All columns of all rows of each table."""
    out = None
    for name in NAMES:
        own = extraction.statistics(table(spark, d, name), F.lit(name)).select("key", "rows", "content")
        out = own if out is None else out.unionByName(own)
    return out


def _changed(spark, d):
    c = table(spark, d, "customer")
    new = F.when(F.col("c_custkey") % 17 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    b = c.where("c_custkey % 13 <> 0 and c_nationkey <> 7").withColumn("c_acctbal", new)
    return [extraction.statistics(x, F.col("c_nationkey")) for x in (c.where("c_custkey % 11 <> 0"), b)]


ROWS = "a AS (SELECT c_nationkey AS key, count(*) AS n, list(c_custkey || '|' || c_acctbal ORDER BY c_custkey) AS l FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1), b AS (SELECT c_nationkey AS key, count(*) AS n, list(c_custkey || '|' || (c_acctbal + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END) ORDER BY c_custkey) AS l FROM customer WHERE c_custkey % 13 <> 0 AND c_nationkey <> 7 GROUP BY 1)"


@query(f"WITH {ROWS} SELECT key, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n <> b.n THEN 'count' ELSE 'content' END AS violation FROM a LEFT JOIN b USING (key) WHERE b.n IS NULL OR a.n <> b.n OR a.l <> b.l")
def data_violations(spark, d):
    return proof.violations(*_changed(spark, d))


@query(f"WITH {ROWS} SELECT key, coalesce(a.n, b.n) AS rows FROM a FULL JOIN b USING (key)")
def seed_baseline(spark, d):
    return proof.seed_baseline(*_changed(spark, d)).select("key", "rows")


@query(f"WITH {ROWS} SELECT a.key, CASE WHEN a.n <> b.n THEN 'count' ELSE 'content' END AS effect FROM a JOIN b USING (key) WHERE a.n <> b.n OR a.l <> b.l")
def seed_side_effects(spark, d):
    return proof.seed_side_effects(*_changed(spark, d))


@query(f"WITH {ROWS} SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'error' WHEN coalesce(b.n, 0) = 0 THEN 'skipped(no_row)' ELSE 'seeded' END AS outcome FROM nation LEFT JOIN b ON key = n_nationkey")
def seed_outcomes(spark, d):
    seeded = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "error").otherwise("seeded").alias("outcome"))
    return proof.seed_outcomes(seeded, _changed(spark, d)[1])


@query("SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'created' WHEN doc_id % 13 = 0 THEN 'stale' WHEN doc_id % 17 = 0 THEN 'updated' ELSE 'unchanged' END AS state FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0")
def file_classify(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("content"))
    new = docs.where("doc_id % 13 <> 0").withColumn("content", F.when(F.col("doc_id") % 17 == 0, F.lit("new")).otherwise(F.col("content")))
    return export.classified(docs.where("doc_id % 11 <> 0"), new)


@query("SELECT lower(p_name) AS folded, count(DISTINCT p_name) AS spellings, min(p_name) AS canonical, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part) GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def case_collisions(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return export.case_collisions(p, "p_name")


@query("SELECT doc_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 = 0")
def stale_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return export.stale(docs.where("doc_id % 11 <> 0"), docs.where("doc_id % 13 <> 0"), "doc_id")


@query("WITH f AS (SELECT source || '/' || doc_id AS path, doc_id FROM documents) SELECT path, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN -doc_id END NULLS LAST, path) - 1 AS position FROM f")
def manifest_order(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return export.load_order(docs, docs.where("doc_id % 3 = 0").select("path", (-F.col("doc_id")).alias("position")))


@query("SELECT doc_id::VARCHAR AS file, 0 AS place, (doc_id + 1)::VARCHAR AS target FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def directive_lint(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    directives = docs.select(F.col("doc_id").cast("string").alias("file"), F.lit(0).alias("place"), (F.col("doc_id") + 1).cast("string").alias("target"))
    return export.lint(directives, docs.where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path")))
