"""Statements: classes, references, providers and order.

The tables hold no SQL files, so a script is made from them: schemas of
nations, tables of customers, views of orders, and indexes of lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import export, graph, statements
from factloom.queries import query
from factloom.sources.tables import stored, table
from factloom.storage import undisturbed


def _script(spark, d):
    """``file, place, statement`` of a schema made of the tables."""

    def build():
        nation, customer, orders, line = (table(spark, d, n) for n in ("nation", "customer", "orders", "lineitem"))
        text = lambda *parts: F.concat(*[F.lit(p) if p.startswith(" ") or p.endswith(" ") or "(" in p or p.endswith(".") or p.endswith("_") else F.col(p).cast("string") for p in parts])
        schema = nation.select(F.concat(F.lit("cluster/n"), "n_nationkey", F.lit(".sql")).alias("file"), F.lit(0).alias("place"), text("CREATE SCHEMA IF NOT EXISTS n_", "n_nationkey").alias("statement"))
        tables = customer.select(
            F.concat(F.lit("tables/c"), "c_custkey", F.lit(".sql")).alias("file"), F.lit(0).alias("place"),
            F.concat(text("create TABLE n_", "c_nationkey"), text(".c_", "c_custkey"), F.lit(" (id bigint PRIMARY KEY, note text DEFAULT 'references x.y')")).alias("statement"),
        )
        own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        views = own.select(
            F.concat(F.lit("views/o"), "o_orderkey", F.lit(".sql")).alias("file"), F.lit(0).alias("place"),
            F.concat(text("CREATE OR REPLACE VIEW n_", "c_nationkey"), text(".o_", "o_orderkey"), text(" AS SELECT * FROM N_", "c_nationkey"), text(".c_", "c_custkey"), F.lit(" /* from no.where */")).alias("statement"),
        )
        indexes = line.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p")).join(own, F.col("l_orderkey") == F.col("o_orderkey")).where("o_custkey % 7 = 0").select(
            F.concat(F.lit("tables/c"), "c_custkey", F.lit(".sql")).alias("file"), F.col("o_orderkey").cast("int").alias("place"),
            F.concat(text("CREATE INDEX i_", "o_orderkey"), text(" ON n_", "c_nationkey"), text(".c_", "c_custkey"), F.lit(" (id)")).alias("statement"),
        )
        grants = customer.where("c_custkey % 5 = 0").select(
            F.concat(F.lit("tables/c"), "c_custkey", F.lit(".sql")).alias("file"), F.lit(1_000_000_000).alias("place"),
            F.concat(text("GRANT SELECT ON TABLE n_", "c_nationkey"), text(".c_", "c_custkey"), F.lit(" TO reader")).alias("statement"),
        )
        return graph.union([schema, tables, views, indexes, grants])

    return stored(spark, d, "script", build)


def _refs(spark, d):
    node = F.concat_ws("#", "file", F.col("place").cast("string")).alias("node")
    return stored(spark, d, "references", lambda: statements.references(_script(spark, d)).select("*", node))


def _graph(spark, d):
    made = {}

    def emit(part):
        if not made:
            refs = _refs(spark, d)
            external = spark.createDataFrame([("role", None, "reader", None)], "kind string, schema string, name string, signature string")
            # Both parts read what is written on the way: it stays when the first is stored.
            made["edges"], made["diagnostics"] = undisturbed(lambda: statements.provider_graph(refs.where("role = 'requires'"), refs.where("role = 'provides'"), external))
        return made[part]

    return [stored(spark, d, f"statement-{p}", lambda p=p: emit(p)) for p in ("edges", "diagnostics")]


CUSTOMERS = "c AS (SELECT 'tables/c' || c_custkey || '.sql' AS f, * FROM customer), o AS (SELECT 'views/o' || o_orderkey || '.sql' AS v, * FROM orders JOIN c ON o_custkey = c_custkey), i AS (SELECT * FROM o WHERE o_custkey % 7 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))"
EDGES = """e AS (SELECT 'cluster/n' || c_nationkey || '.sql#0' AS src, f || '#0' AS dst, 'requires' AS reason FROM c
UNION ALL SELECT 'cluster/n' || c_nationkey || '.sql#0', v || '#0', 'requires' FROM o UNION ALL SELECT f || '#0', v || '#0', 'requires' FROM o
UNION ALL SELECT f || '#0', f || '#' || o_orderkey, 'requires' FROM i UNION ALL SELECT f || '#0', f || '#1000000000', 'requires' FROM c WHERE c_custkey % 5 = 0)"""


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^\\s*(select|with|values)\\b') THEN 'SELECT' WHEN regexp_matches(lower(text), '^\\s*update\\b') THEN 'UPDATE' WHEN regexp_matches(lower(text), '^\\s*do\\b') THEN 'DO' WHEN regexp_matches(lower(text), '^\\s*(set|reset)\\b') THEN 'VARIABLE_SET' WHEN regexp_matches(lower(text), '^\\s*grant\\b') THEN 'GRANT' WHEN regexp_matches(lower(text), '^\\s*revoke\\b') THEN 'REVOKE' WHEN regexp_matches(lower(text), '^\\s*comment\\s+on\\b') THEN 'COMMENT' ELSE 'UNKNOWN' END AS class FROM conversations")
def classify_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", statements.classify(F.col("text")).alias("class"))


@query(f"WITH {CUSTOMERS} SELECT class, phase, n FROM (SELECT 'CREATE_SCHEMA' AS class, 'bootstrap' AS phase, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'CREATE_TABLE', 'data_structures', (SELECT count(*) FROM c) UNION ALL SELECT 'CREATE_VIEW', 'post_data', (SELECT count(*) FROM o) UNION ALL SELECT 'CREATE_INDEX', 'post_data', (SELECT count(*) FROM i) UNION ALL SELECT 'GRANT', 'privileges', (SELECT count(*) FROM c WHERE c_custkey % 5 = 0)) WHERE n > 0")
def statement_classes(spark, d):
    kind = statements.classify(F.col("statement"))
    return _script(spark, d).select(kind.alias("class"), statements.phase(kind).alias("phase")).groupBy("class", "phase").agg(F.count(F.lit(1)).alias("n"))


@query()
def statement_split(spark, d):
    return statements.split_statements(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("sql")))


@query(f"""WITH {CUSTOMERS}, r AS (SELECT 'schema::n_' || n_nationkey || ':' AS key, 'provides' AS role FROM nation
UNION ALL SELECT 'table:n_' || c_nationkey || ':c_' || c_custkey || ':', 'provides' FROM c UNION ALL SELECT 'schema::n_' || c_nationkey || ':', 'requires' FROM c
UNION ALL SELECT 'view:n_' || c_nationkey || ':o_' || o_orderkey || ':', 'provides' FROM o UNION ALL SELECT 'schema::n_' || c_nationkey || ':', 'requires' FROM o UNION ALL SELECT 'table:n_' || c_nationkey || ':c_' || c_custkey || ':', 'requires' FROM o
UNION ALL SELECT 'index:public:i_' || o_orderkey || ':', 'provides' FROM i UNION ALL SELECT 'table:n_' || c_nationkey || ':c_' || c_custkey || ':', 'requires' FROM i
UNION ALL SELECT 'table:n_' || c_nationkey || ':c_' || c_custkey || ':', 'requires' FROM c WHERE c_custkey % 5 = 0 UNION ALL SELECT 'role::reader:', 'requires' FROM c WHERE c_custkey % 5 = 0)
SELECT role, key, count(*) AS n FROM r GROUP BY ALL""")
def statement_references(spark, d):
    return _refs(spark, d).groupBy("role", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CUSTOMERS}, {EDGES} SELECT * FROM e")
def provider_graph(spark, d):
    return _graph(spark, d)[0].select("src", "dst", "reason")


@query("SELECT NULL::VARCHAR AS node, NULL::VARCHAR AS code, NULL::VARCHAR AS key WHERE false")
def provider_diagnostics(spark, d):
    """Nothing is unresolved or ambiguous: the role is external."""
    return _graph(spark, d)[1]


def _nodes(spark, d):
    node = F.concat_ws("#", "file", F.col("place").cast("string")).alias("node")
    key = statements.statement_key(statements.classify(F.col("statement")), F.col("file"), F.col("place"))
    return _script(spark, d).select(node, F.col("file").alias("path"), "place", key.alias("key"))


@query(f"""WITH {CUSTOMERS}, s AS (SELECT 0 AS p, 1 AS w, 'cluster/n' || n_nationkey || '.sql' AS path, 0 AS place FROM nation UNION ALL SELECT 2, 20, f, 0 FROM c UNION ALL SELECT 4, 40, v, 0 FROM o UNION ALL SELECT 4, 42, f, o_orderkey FROM i UNION ALL SELECT 5, 55, f, 1000000000 FROM c WHERE c_custkey % 5 = 0)
SELECT path || '#' || place AS node, row_number() OVER (ORDER BY p, w, path, place) - 1 AS position FROM s""")
def sorted_statements(spark, d):
    """Phases already put every requirement first here, so the order is that of the keys."""
    return statements.sorted_statements(_nodes(spark, d), _graph(spark, d)[0]).select("node", "position")


@query(f"WITH {CUSTOMERS}, {EDGES}, n AS (SELECT DISTINCT split_part(src, '#', 1) AS fp, split_part(src, '#', 2)::INT AS fi, split_part(dst, '#', 1) AS tp, split_part(dst, '#', 2)::INT AS ti, reason FROM e) SELECT fp AS from_path, fi AS from_place, tp AS to_path, ti AS to_place, reason, row_number() OVER (ORDER BY fp, fi, tp, ti, reason) - 1 AS position FROM n")
def graph_report(spark, d):
    return statements.graph_report(_nodes(spark, d), _graph(spark, d)[0])


@query("WITH e AS (SELECT DISTINCT l_orderkey % 50 AS s, l_partkey % 50 AS t FROM lineitem) SELECT a.s AS a, a.t AS b FROM e a JOIN e b ON a.s = b.t AND a.t = b.s WHERE a.s < a.t")
def mutual_files(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("id"), (F.col("l_partkey") % 50).alias("needs"))
    return statements.mutual(rows)


@query(f"WITH {CUSTOMERS} SELECT f AS file, 1000000000 AS place, 'grant_on_table' AS code FROM c WHERE c_custkey % 5 = 0")
def forbidden_statements(spark, d):
    """Grants are forbidden here; words in comments and literals are not found."""
    return statements.forbidden(_script(spark, d), {"grant_on_table": r"\bgrant\b.*\bon\s+table\b", "nowhere": r"\bno\.where\b", "literal": r"\bx\.y\b"})


@query(f"WITH {CUSTOMERS}, r AS (SELECT f AS file, 0 AS place, 0 AS w FROM c UNION ALL SELECT f, o_orderkey, 1 FROM i UNION ALL SELECT f, 1000000000, 2 FROM c WHERE c_custkey % 5 = 0) SELECT file, place, row_number() OVER (PARTITION BY file ORDER BY w, place) - 1 AS position FROM r WHERE file LIKE 'tables/%'")
def reordered_files(spark, d):
    return statements.by_kind(_script(spark, d)).where("file like 'tables/%'").select("file", "place", F.col("position").cast("long"))


@query("SELECT l_orderkey, l_partkey, CASE WHEN p.n IS NULL THEN 'unresolved' WHEN p.n = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey % 1500 AS k, count(*) AS n FROM part GROUP BY 1) p ON l_partkey = k")
def provider_match(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    parts = table(spark, d, "part").select((F.col("p_partkey") % 1500).alias("key"), F.col("p_partkey").alias("provider"))
    return statements.match_providers(lines.withColumn("key", F.col("l_partkey")), parts).select("l_orderkey", "l_partkey", "state")


@query("SELECT p_name AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_producers(spark, d):
    return statements.duplicate_producers(table(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("node")))


@query("SELECT event_type, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1")
def diagnostic_dedupe(spark, d):
    return statements.latest_diagnostics(table(spark, d, "events").select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, user_id, props, event_id) - 1 AS position FROM events")
def diagnostic_order(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("path"), F.col("user_id").alias("place"), F.col("props").alias("code"), F.col("event_id").alias("message"))
    return statements.sorted_diagnostics(rows).select("event_id", "position")


@query("SELECT c_custkey, 'schemas/n_' || c_nationkey || '/tables/' || 'c_' || c_custkey || '.sql' AS file FROM customer")
def export_routes(spark, d):
    c = table(spark, d, "customer")
    ident = F.concat(F.lit("column:N_"), F.col("c_nationkey").cast("string"), F.lit(".x."), F.lit("C_"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", export.route(ident).alias("file"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS s, (n_nationkey * 7 + n_regionkey) % 25 AS t FROM nation), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s) SELECT n_nationkey AS file, least(n_nationkey, coalesce((SELECT min(x.t) FROM r x JOIN r y ON x.s = n_nationkey AND y.s = x.t AND y.t = n_nationkey), n_nationkey)) AS merged FROM nation")
def merged_cycles(spark, d):
    """Files are nations, each of which needs another: cycles become one file."""
    n = table(spark, d, "nation")
    e = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("dst")).distinct()
    return export.merged_cycles(n.select(F.col("n_nationkey").alias("file")), e)
