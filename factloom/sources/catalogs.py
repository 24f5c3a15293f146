"""Facts and edges of PostgreSQL's catalogs, given as tables (Parquet, JSON or JDBC).

Each family is a function of the catalog tables, named by their catalog names
with their catalog columns; what the server's functions render (definitions,
type names, privileges) is taken as columns of the tables: ``def``,
``type_name``, ``acl`` as an array of ``grantee=privileges``.  ``extract`` runs
the families in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_text, content_hash, entity_id, satellite_id
from factloom.operators import extraction, graph

Tables = dict[str, DataFrame]
#: Letters of the catalog's columns and what they mean.
PERSISTENCE = {"p": "permanent", "u": "unlogged", "t": "temporary"}
REPLICA = {"d": "default", "n": "nothing", "f": "full", "i": "index"}
CONSTRAINTS = {"p": "primary", "u": "unique", "f": "foreign", "c": "check", "x": "exclusion"}
#: Attributes of an aggregate, by their catalog columns.
AGGREGATE = {
    "aggKind": "aggkind", "numDirectArgs": "aggnumdirectargs", "sfunc": "aggtransfn", "stype": "aggtranstype", "finalfunc": "aggfinalfn", "initcond": "agginitval",
    "combinefunc": "aggcombinefn", "serialfunc": "aggserialfn", "deserialfunc": "aggdeserialfn", "msfunc": "aggmtransfn", "minvfunc": "aggminvtransfn", "mstype": "aggmtranstype",
    "msspace": "aggmtransspace", "mfinalfunc": "aggmfinalfn", "minitcond": "aggminitval", "finalfuncExtra": "aggfinalextra", "mfinalfuncExtra": "aggmfinalextra",
    "finalfuncModify": "aggfinalmodify", "mfinalfuncModify": "aggmfinalmodify", "sspace": "aggtransspace", "sortop": "aggsortop", "parallel": "proparallel",
}


def scan(spark: SparkSession, folder: str, names: list[str], format: str = "parquet") -> Tables:
    """Catalog tables stored below ``folder``, one folder or file each."""
    return {n: spark.read.format(format).load(f"{folder}/{n}.{format}") for n in names}


def value(c: Column | str) -> Column:
    """A canonical value: text as JSON; null stays null, which is a JSON null."""
    return canonical_text((F.col(c) if isinstance(c, str) else c).cast("string"))


def flag(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def listed(c: Column | str, in_order: bool = False) -> Column:
    """A list as JSON, sorted unless its order counts."""
    c = F.col(c) if isinstance(c, str) else c
    own = F.coalesce(c, F.array().cast("array<string>"))
    return F.to_json(own if in_order else F.array_sort(own))


def named(c: str, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return value(F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)))


def fact(rows: DataFrame, kind: str | Column, ident: Column, parent: Column | None, **payload: Column) -> DataFrame:
    pairs = [x for k, v in payload.items() for x in (F.lit(k), v)]
    return rows.select(
        ident.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(None).cast("string") if parent is None else parent).alias("parent_id"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("payload"),
    )


def user_schemas(c: Tables) -> DataFrame:
    """Schemas that are not the server's own."""
    return c["pg_namespace"].where(~F.col("nspname").isin("pg_catalog", "information_schema") & ~F.col("nspname").rlike("^pg_(toast|temp)"))


def members(c: Tables) -> DataFrame:
    """``classid, objid, extname``: objects that an extension owns."""
    ext = c["pg_extension"].select(F.col("oid").alias("refobjid"), "extname")
    return c["pg_depend"].where("deptype = 'e' and refclassid = 'pg_extension'").join(ext, "refobjid").select("classid", "objid", "extname")


def without_members(rows: DataFrame, c: Tables, classid: str) -> DataFrame:
    return rows.join(members(c).where(F.col("classid") == classid).select(F.col("objid").alias("oid")), "oid", "left_anti")


def relations(c: Tables, *kinds: str) -> DataFrame:
    """User relations of some kinds with their schema's name."""
    spaces = user_schemas(c).select(F.col("oid").alias("relnamespace"), "nspname")
    return c["pg_class"].where(F.col("relkind").isin(*kinds)).join(spaces, "relnamespace")


RELATION = {"r": "table", "p": "table", "v": "view", "m": "materializedView", "f": "foreignTable", "S": "sequence", "i": "index", "I": "index", "c": "type"}


def relation_id(schema: str = "nspname", name: str = "relname", kind: str = "relkind") -> Column:
    table = F.create_map(*[F.lit(x) for pair in RELATION.items() for x in pair])
    return entity_id(F.try_element_at(table, F.col(kind)), F.col(schema), F.col(name))


def roles(c: Tables) -> DataFrame:
    """Roles but the server's own, with flags and sorted settings."""
    own = c["pg_roles"].where("not rolname like 'pg\\\\_%'")
    config = c["pg_db_role_setting"].where("setdatabase = 0").select(F.col("setrole").alias("oid"), F.explode("setconfig").alias("cfg")).groupBy("oid").agg(F.sort_array(F.collect_list("cfg")).alias("config"))
    flags = F.array_compact(F.array(*[F.when(F.col(x), x[3:]) for x in ("rolsuper", "rolinherit", "rolcreaterole", "rolcreatedb", "rolcanlogin", "rolreplication", "rolbypassrls")]))
    rows = own.join(config, "oid", "left")
    return fact(rows, "role", entity_id("role", F.col("rolname")), None, flags=listed(flags), connectionLimit=flag("rolconnlimit"), validUntil=value("rolvaliduntil"), config=listed("config"))


def memberships(c: Tables) -> DataFrame:
    """One membership whatever its grantors; admin if any grants it."""
    names = c["pg_roles"].select("oid", F.col("rolname").alias("name"))
    once = extraction.memberships(c["pg_auth_members"].select(F.col("roleid").alias("role"), "member", F.col("admin_option").alias("admin")), names, names)
    return fact(once, "membership", entity_id("membership", F.col("role"), F.col("member")), entity_id("role", F.col("role")), admin=flag("admin"))


def default_privileges(c: Tables) -> DataFrame:
    """Grantees whose default privileges differ from the built-in ones, and revoked ones."""
    rows = c["pg_default_acl"].select("rolname", "nspname", "objtype", F.explode("acl").alias("a"))
    explicit = rows.select("*", F.split_part("a", F.lit("="), F.lit(1)).alias("grantee"), F.split_part("a", F.lit("="), F.lit(2)).alias("privileges"))
    key = F.concat_ws("|", "rolname", F.coalesce("nspname", F.lit("")), "objtype")
    built = c["builtin_default_acl"].select(F.concat_ws("|", "rolname", F.coalesce("nspname", F.lit("")), "objtype").alias("object"), F.explode("acl").alias("a"))
    found = extraction.deviations(explicit.select(key.alias("object"), "grantee", "privileges"), built.select("object", F.split_part("a", F.lit("="), F.lit(1)).alias("grantee"), F.split_part("a", F.lit("="), F.lit(2)).alias("privileges")))
    part = lambda i: F.get(F.split("object", r"\|"), F.lit(i))
    return fact(found, "defaultPrivilege", entity_id("defaultPrivilege", part(0), part(1), part(2), F.col("grantee")), entity_id("role", part(0)), privileges=value("privileges"))


def schemas(c: Tables) -> DataFrame:
    """User schemas that no extension owns."""
    return fact(without_members(user_schemas(c), c, "pg_namespace"), "schema", entity_id("schema", F.col("nspname")), None)


def extensions(c: Tables) -> DataFrame:
    """Extensions with their schema; whether they can move is metadata."""
    rows = c["pg_extension"].join(c["pg_namespace"].select(F.col("oid").alias("extnamespace"), "nspname"), "extnamespace")
    return fact(rows, "extension", entity_id("extension", F.col("extname")), None, schema=value("nspname"), _relocatable=flag("extrelocatable"), _version=value("extversion"))


def tables(c: Tables) -> DataFrame:
    """Tables with their first parent, by the order of inheritance."""
    first = c["pg_inherits"].groupBy(F.col("inhrelid").alias("oid")).agg(F.min_by("inhparent", "inhseqno").alias("parent"))
    above = relations(c, "r", "p").select(F.col("oid").alias("parent"), F.concat_ws(".", "nspname", "relname").alias("parent_name"))
    rows = without_members(relations(c, "r", "p"), c, "pg_class").join(first, "oid", "left").join(above, "parent", "left")
    return fact(
        rows, "table", entity_id("table", F.col("nspname"), F.col("relname")), entity_id("schema", F.col("nspname")), persistence=named("relpersistence", PERSISTENCE), rowSecurity=flag("relrowsecurity"),
        forceRowSecurity=flag("relforcerowsecurity"), replicaIdentity=named("relreplident", REPLICA), partitionKey=value("partkeydef"), partitionBound=value("partbound"), parentTable=value("parent_name"), reloptions=listed("reloptions"),
    )


def _columns(c: Tables, *kinds: str) -> DataFrame:
    return c["pg_attribute"].where("attnum > 0 and not attisdropped").join(relations(c, *kinds).select(F.col("oid").alias("attrelid"), "nspname", "relname", "relkind"), "attrelid")


def columns(c: Tables) -> DataFrame:
    """Columns that are the table's own; identity and generation included."""
    rows = _columns(c, "r", "p", "f").where("attislocal or attinhcount = 0")
    defaults = c["pg_attrdef"].select(F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), "expr")
    rows = rows.join(defaults, ["attrelid", "attnum"], "left")
    generated = F.when(F.col("attgenerated") != "", F.col("expr"))
    return fact(
        rows, "column", entity_id("column", F.col("nspname"), F.col("relname"), F.col("attname")), relation_id(), type=value("type_name"), notNull=flag("attnotnull"), identity=value(F.nullif("attidentity", F.lit(""))),
        generatedExpr=value(generated), collation=value("collname"), _position=flag("attnum"),
    )


def defaults(c: Tables) -> DataFrame:
    """Defaults are facts of their own; expressions of generated columns are not defaults."""
    rows = c["pg_attrdef"].join(_columns(c, "r", "p", "f").where("attgenerated = ''").select(F.col("attrelid").alias("adrelid"), F.col("attnum").alias("adnum"), "nspname", "relname", "attname"), ["adrelid", "adnum"])
    own = [F.col(x) for x in ("nspname", "relname", "attname")]
    return fact(rows, "default", entity_id("default", *own), entity_id("column", *own), expr=value("expr"))


def constraints(c: Tables) -> DataFrame:
    """Constraints of tables that are not inherited."""
    rows = c["pg_constraint"].where("conrelid <> 0 and conislocal and contype <> 'n'").join(relations(c, "r", "p", "f").select(F.col("oid").alias("conrelid"), "nspname", "relname", "relkind"), "conrelid")
    return fact(rows, "constraint", entity_id("constraint", F.col("nspname"), F.col("relname"), F.col("conname")), relation_id(), **{"def": value("def")}, type=named("contype", CONSTRAINTS), validated=flag("convalidated"))


def indexes(c: Tables) -> DataFrame:
    """Indexes that neither back a constraint nor belong to a partitioned one."""
    rows = c["pg_index"].join(relations(c, "i", "I").select(F.col("oid").alias("indexrelid"), F.col("relname").alias("name")), "indexrelid")
    rows = rows.join(c["pg_constraint"].where("conindid <> 0").select(F.col("conindid").alias("indexrelid")), "indexrelid", "left_anti").join(c["pg_inherits"].select(F.col("inhrelid").alias("indexrelid")), "indexrelid", "left_anti")
    rows = rows.join(relations(c, "r", "p", "m").select(F.col("oid").alias("indrelid"), "nspname", "relname", "relkind"), "indrelid")
    return fact(rows, "index", entity_id("index", F.col("nspname"), F.col("name")), relation_id(), **{"def": value("def")}, valid=flag("indisvalid"))


def sequences(c: Tables) -> DataFrame:
    """Sequences that no identity column owns, with the column that owns them."""
    own = without_members(relations(c, "S"), c, "pg_class")
    links = c["pg_depend"].where("classid = 'pg_class' and refclassid = 'pg_class' and deptype in ('a', 'i')")
    own = own.join(links.where("deptype = 'i'").select(F.col("objid").alias("oid")), "oid", "left_anti")
    owners = links.where("deptype = 'a'").join(_columns(c, "r", "p").select(F.col("attrelid").alias("refobjid"), F.col("attnum").alias("refobjsubid"), F.concat_ws(".", "nspname", "relname", "attname").alias("owned")), ["refobjid", "refobjsubid"]).select(F.col("objid").alias("oid"), "owned")
    rows = own.join(c["pg_sequence"].withColumnRenamed("seqrelid", "oid"), "oid").join(owners, "oid", "left")
    options = {a: flag(x) for a, x in (("increment", "seqincrement"), ("minValue", "seqmin"), ("maxValue", "seqmax"), ("start", "seqstart"), ("cache", "seqcache"), ("cycle", "seqcycle"))}
    return fact(rows, "sequence", entity_id("sequence", F.col("nspname"), F.col("relname")), entity_id("schema", F.col("nspname")), dataType=value("type_name"), ownedBy=value("owned"), **options)


def views(c: Tables) -> DataFrame:
    """Views and materialized views by their definition."""
    rows = without_members(relations(c, "v", "m"), c, "pg_class").join(c["pg_views_def"], "oid")
    return fact(rows, F.when(F.col("relkind") == "v", "view").otherwise("materializedView"), relation_id(), entity_id("schema", F.col("nspname")), **{"def": value("def")}, reloptions=listed("reloptions"))


def _on_relation(c: Tables, name: str, relation: str, label: str, kind: str, where: str, **payload: Column) -> DataFrame:
    rows = c[name].where(where).join(relations(c, "r", "p", "v", "m", "f").select(F.col("oid").alias(relation), "nspname", "relname", "relkind"), relation)
    return fact(rows, kind, entity_id(kind, F.col("nspname"), F.col("relname"), F.col(label)), relation_id(), **payload)


def triggers(c: Tables) -> DataFrame:
    """X11: triggers that users made."""
    return _on_relation(c, "pg_trigger", "tgrelid", "tgname", "trigger", "not tgisinternal", **{"def": value("def")}, enabled=value("tgenabled"))


def rewrite_rules(c: Tables) -> DataFrame:
    """Rules but those that make a view."""
    return _on_relation(c, "pg_rewrite", "ev_class", "rulename", "rule", "rulename <> '_RETURN'", **{"def": value("def")}, enabled=value("ev_enabled"))


def _routines(c: Tables, *kinds: str) -> DataFrame:
    """Routines with the names of their argument types, in order."""
    own = without_members(c["pg_proc"].where(F.col("prokind").isin(*kinds)), c, "pg_proc").join(user_schemas(c).select(F.col("oid").alias("pronamespace"), "nspname"), "pronamespace")
    each = own.select("oid", F.posexplode("proargtypes").alias("place", "type")).join(c["pg_type"].select(F.col("oid").alias("type"), "type_name"), "type")
    args = each.groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "type_name"))), lambda x: x["type_name"]).alias("args"))
    return own.join(args, "oid", "left").withColumn("signature", F.concat(F.lit("("), F.array_join(F.coalesce("args", F.array().cast("array<string>")), ","), F.lit(")")))


def routines(c: Tables) -> DataFrame:
    """Functions and procedures; of their settings only the names."""
    rows = _routines(c, "f", "p", "w")
    kind = F.when(F.col("prokind") == "p", "procedure").otherwise("function")
    config = F.transform(F.coalesce("proconfig", F.array().cast("array<string>")), lambda s: F.split_part(s, F.lit("="), F.lit(1)))
    return fact(rows, kind, entity_id(kind, F.col("nspname"), F.col("proname"), F.col("signature")), entity_id("schema", F.col("nspname")), **{"def": value("def")}, returnType=value("rettype_name"), argSignature=value("signature"), language=value("lanname"), isWindow=flag(F.col("prokind") == "w"), _config=listed(config))


def aggregates(c: Tables) -> DataFrame:
    """Aggregates with all that defines them."""
    rows = _routines(c, "a").join(c["pg_aggregate"].withColumnRenamed("aggfnoid", "oid"), "oid")
    known = {a: value(x) for a, x in AGGREGATE.items() if x in rows.columns}
    return fact(rows, "aggregate", entity_id("aggregate", F.col("nspname"), F.col("proname"), F.col("signature")), entity_id("schema", F.col("nspname")), **known)


def policies(c: Tables) -> DataFrame:
    """Row policies; role 0 is everyone."""
    each = c["pg_policy"].select("oid", F.explode("polroles").alias("role")).join(c["pg_roles"].select(F.col("oid").alias("role"), "rolname"), "role", "left").where("role = 0 or rolname is not null")
    names = each.groupBy("oid").agg(F.array_sort(F.collect_set(F.when(F.col("role") == 0, "PUBLIC").otherwise(F.col("rolname")))).alias("roles"))
    rows = dict(c) | {"pg_policy": c["pg_policy"].join(names, "oid", "left")}
    return _on_relation(rows, "pg_policy", "polrelid", "polname", "policy", "true", roles=listed("roles"), usingExpr=value("qual"), checkExpr=value("withcheck"), cmd=value("polcmd"), permissive=flag("polpermissive"))


def _types(c: Tables, kind: str) -> DataFrame:
    return without_members(c["pg_type"].where(F.col("typtype") == kind), c, "pg_type").join(user_schemas(c).select(F.col("oid").alias("typnamespace"), "nspname"), "typnamespace")


def domains(c: Tables) -> DataFrame:
    """Domains, and their constraints as facts below them."""
    own = _types(c, "d")
    ident = lambda: entity_id("domain", F.col("nspname"), F.col("typname"))
    checks = c["pg_constraint"].where("contypid <> 0").join(own.select(F.col("oid").alias("contypid"), "nspname", "typname"), "contypid")
    return graph.union([
        fact(own, "domain", ident(), entity_id("schema", F.col("nspname")), baseType=value("basetype_name"), default=value("typdefault"), notNull=flag("typnotnull"), collation=value("collname")),
        fact(checks, "constraint", entity_id("constraint", F.col("nspname"), F.col("typname"), F.col("conname")), ident(), **{"def": value("def")}, type=named("contype", CONSTRAINTS), validated=flag("convalidated")),
    ])


def types(c: Tables) -> DataFrame:
    """Enums with ordered values, composites with their attributes below them, ranges."""
    ident = lambda: entity_id("type", F.col("nspname"), F.col("typname"))
    schema = lambda: entity_id("schema", F.col("nspname"))
    labels = c["pg_enum"].groupBy(F.col("enumtypid").alias("oid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("enumsortorder", "enumlabel"))), lambda x: x["enumlabel"]).alias("labels"))
    composite = _types(c, "c").join(c["pg_class"].where("relkind = 'c'").select(F.col("oid").alias("typrelid")), "typrelid")
    attributes = c["pg_attribute"].where("attnum > 0 and not attisdropped").withColumnRenamed("type_name", "att_type").withColumnRenamed("collname", "att_collation")
    attributes = attributes.join(composite.select(F.col("typrelid").alias("attrelid"), "nspname", "typname"), "attrelid")
    ranges = _types(c, "r").join(c["pg_range"].withColumnRenamed("rngtypid", "oid"), "oid")
    return graph.union([
        fact(_types(c, "e").join(labels, "oid", "left"), "type", ident(), schema(), variant=value(F.lit("enum")), values=listed("labels", in_order=True)),
        fact(composite, "type", ident(), schema(), variant=value(F.lit("composite"))),
        fact(attributes, "typeAttribute", entity_id("typeAttribute", F.col("nspname"), F.col("typname"), F.col("attname")), ident(), type=value("att_type"), collation=value("att_collation"), _position=flag("attnum")),
        fact(ranges, "type", ident(), schema(), variant=value(F.lit("range")), subtype=value("subtype_name"), subtypeOpclass=value("opclass_name"), subtypeDiff=value("subdiff_name"), multirangeTypeName=value("multirange_name")),
    ])


def collations(c: Tables) -> DataFrame:
    """Collations."""
    rows = without_members(c["pg_collation"], c, "pg_collation").join(user_schemas(c).select(F.col("oid").alias("collnamespace"), "nspname"), "collnamespace")
    return fact(rows, "collation", entity_id("collation", F.col("nspname"), F.col("collname")), entity_id("schema", F.col("nspname")), provider=value("collprovider"), deterministic=flag("collisdeterministic"), locale=value("colllocale"), lcCollate=value("collcollate"), lcCtype=value("collctype"))


def event_triggers(c: Tables) -> DataFrame:
    """Event triggers; no tags are an empty list."""
    rows = without_members(c["pg_event_trigger"], c, "pg_event_trigger")
    return fact(rows, "eventTrigger", entity_id("eventTrigger", F.col("evtname")), None, event=value("evtevent"), tags=listed("evttags"), functionSchema=value("func_schema"), functionName=value("func_name"), enabled=value("evtenabled"))


def publications(c: Tables) -> DataFrame:
    """Publications, and what they publish as facts below them."""
    own = c["pg_publication"]
    ident = lambda: entity_id("publication", F.col("pubname"))
    publish = F.array_compact(F.array(*[F.when(F.col(f"pub{x}"), x) for x in ("insert", "update", "delete", "truncate")]))
    pubs = own.select(F.col("oid").alias("pubid"), "pubname")
    rels = c["pg_publication_rel"].join(pubs, F.col("prpubid") == F.col("pubid")).join(relations(c, "r", "p").select(F.col("oid").alias("prrelid"), "nspname", "relname"), "prrelid")
    spaces = c["pg_publication_namespace"].join(pubs, F.col("pnpubid") == F.col("pubid")).join(user_schemas(c).select(F.col("oid").alias("pnnspid"), "nspname"), "pnnspid")
    return graph.union([
        fact(own, "publication", ident(), None, publish=listed(publish), viaRoot=flag("pubviaroot"), allTables=flag("puballtables")),
        fact(rels, "publicationRel", entity_id("publicationRel", F.col("pubname"), F.col("nspname"), F.col("relname")), ident(), columns=listed("columns"), where=value("qual")),
        fact(spaces, "publicationSchema", entity_id("publicationSchema", F.col("pubname"), F.col("nspname")), ident()),
    ])


def subscriptions(c: Tables) -> DataFrame:
    """Subscriptions, without secrets in their connection; options that the server's version lacks are left out."""
    rows = c["pg_subscription"]
    optional = {a: value(x) if a == "twoPhase" else flag(x) for a, x in (("twoPhase", "subtwophasestate"), ("disableOnError", "subdisableonerr"), ("runAsOwner", "subrunasowner"), ("failover", "subfailover")) if x in rows.columns}
    return fact(rows, "subscription", entity_id("subscription", F.col("subname")), None, enabled=flag("subenabled"), publications=listed("subpublications"), conninfo=value(extraction.redacted_conninfo(F.col("subconninfo"))), slotName=value("subslotname"), **optional)


def foreign(c: Tables) -> DataFrame:
    """Wrappers, servers, user mappings and foreign tables; options sorted, secrets hidden."""
    options = lambda x: F.to_json(extraction.redacted_options(F.coalesce(F.col(x), F.array().cast("array<string>"))))
    wrappers = without_members(c["pg_foreign_data_wrapper"], c, "pg_foreign_data_wrapper")
    servers = c["pg_foreign_server"].join(c["pg_foreign_data_wrapper"].select(F.col("oid").alias("srvfdw"), "fdwname"), "srvfdw")
    names = servers.select(F.col("oid").alias("server"), "srvname")
    mappings = c["pg_user_mapping"].join(names, F.col("umserver") == F.col("server")).join(c["pg_roles"].select(F.col("oid").alias("umuser"), "rolname"), "umuser", "left").withColumn("who", F.coalesce("rolname", F.lit("PUBLIC")))
    rels = relations(c, "f").join(c["pg_foreign_table"].withColumnRenamed("ftrelid", "oid"), "oid").join(names, F.col("ftserver") == F.col("server"))
    server = lambda: entity_id("server", F.col("srvname"))
    return graph.union([
        fact(wrappers, "fdw", entity_id("fdw", F.col("fdwname")), None, handler=value("handler_name"), validator=value("validator_name"), options=options("fdwoptions")),
        fact(servers, "server", server(), entity_id("fdw", F.col("fdwname")), type=value("srvtype"), version=value("srvversion"), fdw=value("fdwname"), options=options("srvoptions")),
        fact(mappings.where("umoptions is not null or readable"), "userMapping", entity_id("userMapping", F.col("srvname"), F.col("who")), server(), options=options("umoptions")),
        fact(rels, "foreignTable", entity_id("foreignTable", F.col("nspname"), F.col("relname")), entity_id("schema", F.col("nspname")), server=value("srvname"), options=options("ftoptions")),
    ])


def unreadable_mappings(c: Tables) -> DataFrame:
    """``id`` of the user mappings whose options the reader may not see."""
    names = c["pg_foreign_server"].select(F.col("oid").alias("umserver"), "srvname")
    rows = c["pg_user_mapping"].where("umoptions is null and not readable").join(names, "umserver").join(c["pg_roles"].select(F.col("oid").alias("umuser"), "rolname"), "umuser", "left")
    return rows.select(entity_id("userMapping", F.col("srvname"), F.coalesce("rolname", F.lit("PUBLIC"))).alias("id"))


def security_labels(c: Tables, known: DataFrame) -> DataFrame:
    """Labels whose object is known (``known(classid, objid, objsubid, id)``)."""
    rows = c["pg_seclabel"].join(known, ["classid", "objid", "objsubid"])
    return fact(rows, "securityLabel", satellite_id("securityLabel", F.col("id"), F.col("provider")), F.col("id"), label=value("label"))


def unresolved_labels(c: Tables, known: DataFrame) -> DataFrame:
    """Count and first five objects of the labels of each class that stay unknown."""
    rows = c["pg_seclabel"].join(known, ["classid", "objid", "objsubid"], "left_anti")
    return extraction.samples(rows.select("classid", "objid"), "classid", "objid")


def inheritance(c: Tables) -> DataFrame:
    """``from_id, to_id, edge_kind``: a child depends on its parent."""
    ends = relations(c, "r", "p", "f").select("oid", relation_id().alias("id"))
    rows = c["pg_inherits"].join(ends.select(F.col("oid").alias("inhrelid"), F.col("id").alias("from_id")), "inhrelid").join(ends.select(F.col("oid").alias("inhparent"), F.col("id").alias("to_id")), "inhparent")
    return rows.select("from_id", "to_id", F.lit("depends").alias("edge_kind"))


def member_edges(c: Tables, known: DataFrame) -> DataFrame:
    """Known objects that an extension owns, with its name."""
    rows = members(c).join(known.where("objsubid = 0"), ["classid", "objid"])
    return rows.select(F.col("id").alias("from_id"), entity_id("extension", F.col("extname")).alias("to_id"), F.lit("memberOfExtension").alias("edge_kind")).distinct()


def objects(c: Tables) -> list[DataFrame]:
    """Resolvers ``class, obj, id`` by priority; ``obj`` is ``oid.subid``."""
    key = lambda oid, sub=F.lit(0): F.concat_ws(".", oid.cast("string"), sub.cast("string")).alias("obj")
    own = lambda df, classid, ident, sub=F.lit(0), oid="oid": df.select(F.lit(classid).alias("class"), key(F.col(oid), sub), ident.alias("id"))
    known = [own(_columns(c, "r", "p", "f"), "pg_class", entity_id("column", F.col("nspname"), F.col("relname"), F.col("attname")), F.col("attnum"), "attrelid"), own(relations(c, "r", "p", "v", "m", "f", "S", "i", "I"), "pg_class", relation_id())]
    known.append(own(user_schemas(c), "pg_namespace", entity_id("schema", F.col("nspname"))))
    if "pg_proc" in c:
        kind = F.when(F.col("prokind") == "p", "procedure").when(F.col("prokind") == "a", "aggregate").otherwise("function")
        known.append(own(_routines(c, "f", "p", "w", "a"), "pg_proc", entity_id(kind, F.col("nspname"), F.col("proname"), F.col("signature"))))
    if "pg_type" in c:
        known += [own(_types(c, t), "pg_type", entity_id(k, F.col("nspname"), F.col("typname"))) for t, k in (("d", "domain"), ("e", "type"), ("c", "type"), ("r", "type"))]
    if "pg_extension" in c:
        known.append(own(c["pg_extension"], "pg_extension", entity_id("extension", F.col("extname"))))
    if "pg_roles" in c:
        known.append(own(c["pg_roles"], "pg_authid", entity_id("role", F.col("rolname"))))
    if "pg_rewrite" in c:
        # The rule of a view stands for the view.
        views_ = c["pg_rewrite"].where("rulename = '_RETURN'").select(F.col("oid").alias("rule"), F.col("ev_class").alias("oid")).join(relations(c, "v", "m"), "oid")
        known.append(own(views_, "pg_rewrite", relation_id(), oid="rule"))
    return known


def dependencies(c: Tables) -> DataFrame:
    """``from_id, to_id, edge_kind`` of the known ends of normal and automatic dependencies, each once.

    An expression of a generated column counts for the column, so that edges
    from its default are not kept twice.
    """
    rows = c["pg_depend"].where("deptype in ('n', 'a')")
    end = lambda oid, sub: F.concat_ws(".", F.col(oid).cast("string"), F.col(sub).cast("string"))
    rows = rows.select(F.col("classid").alias("class"), end("objid", "objsubid").alias("obj"), F.col("refclassid").alias("ref_class"), end("refobjid", "refobjsubid").alias("ref_obj"))
    found = extraction.resolved_edges(rows, objects(c))
    none = found.limit(0)
    return extraction.cleaned_edges(found, F.col("to_id").isNull(), none).withColumn("edge_kind", F.lit("depends"))


#: The families in their order, with the tables that each needs.
FAMILIES: tuple[tuple[str, Callable[[Tables], DataFrame], tuple[str, ...]], ...] = (
    ("roles", roles, ("pg_roles", "pg_db_role_setting")), ("memberships", memberships, ("pg_roles", "pg_auth_members")), ("defaultPrivileges", default_privileges, ("pg_default_acl", "builtin_default_acl")),
    ("schemas", schemas, ("pg_namespace", "pg_depend", "pg_extension")), ("extensions", extensions, ("pg_namespace", "pg_extension")), ("tables", tables, ("pg_class", "pg_namespace", "pg_inherits", "pg_depend", "pg_extension")),
    ("columns", columns, ("pg_attribute", "pg_class", "pg_namespace", "pg_attrdef")), ("defaults", defaults, ("pg_attribute", "pg_class", "pg_namespace", "pg_attrdef")), ("constraints", constraints, ("pg_constraint", "pg_class", "pg_namespace")),
    ("indexes", indexes, ("pg_index", "pg_constraint", "pg_inherits", "pg_class", "pg_namespace")), ("sequences", sequences, ("pg_sequence", "pg_class", "pg_namespace", "pg_depend", "pg_attribute", "pg_extension")),
    ("views", views, ("pg_views_def", "pg_class", "pg_namespace", "pg_depend", "pg_extension")), ("triggers", triggers, ("pg_trigger", "pg_class", "pg_namespace")), ("rules", rewrite_rules, ("pg_rewrite", "pg_class", "pg_namespace")),
    ("routines", routines, ("pg_proc", "pg_type", "pg_namespace", "pg_depend", "pg_extension")), ("aggregates", aggregates, ("pg_aggregate", "pg_proc", "pg_type", "pg_namespace", "pg_depend", "pg_extension")),
    ("policies", policies, ("pg_policy", "pg_roles", "pg_class", "pg_namespace")), ("domains", domains, ("pg_type", "pg_constraint", "pg_namespace", "pg_depend", "pg_extension")),
    ("types", types, ("pg_type", "pg_enum", "pg_range", "pg_attribute", "pg_class", "pg_namespace", "pg_depend", "pg_extension")), ("collations", collations, ("pg_collation", "pg_namespace", "pg_depend", "pg_extension")),
    ("eventTriggers", event_triggers, ("pg_event_trigger", "pg_depend", "pg_extension")), ("publications", publications, ("pg_publication", "pg_publication_rel", "pg_publication_namespace", "pg_class", "pg_namespace")),
    ("subscriptions", subscriptions, ("pg_subscription",)), ("foreign", foreign, ("pg_foreign_data_wrapper", "pg_foreign_server", "pg_user_mapping", "pg_foreign_table", "pg_roles", "pg_class", "pg_namespace", "pg_depend", "pg_extension")),
)


def pruned(facts: DataFrame, satellites: tuple[str, ...] = ("comment", "acl", "securityLabel")) -> tuple[DataFrame, DataFrame]:
    """Facts without satellites whose target is missing, and those (``id``)."""
    own = facts.where(F.col("kind").isin(*satellites))
    lost = own.join(facts.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id")
    return facts.join(lost, "id", "left_anti"), lost


def extract(c: Tables) -> tuple[DataFrame, DataFrame]:
    """Facts and edges of all families whose tables are there; the order of the families is fixed."""
    found = [f(c) for _, f, needs in FAMILIES if all(n in c for n in needs)]
    links = []
    if "pg_inherits" in c:
        links.append(inheritance(c))
    if "pg_depend" in c:
        links.append(dependencies(c))
    if "pg_seclabel" in c or "pg_extension" in c:
        known = graph.cut(extraction.known_ids(objects(c)).select(F.col("class").alias("classid"), F.split_part("obj", F.lit("."), F.lit(1)).cast("long").alias("objid"), F.split_part("obj", F.lit("."), F.lit(2)).cast("int").alias("objsubid"), "id"))
        if "pg_seclabel" in c:
            found.append(security_labels(c, known))
        if "pg_extension" in c and "pg_depend" in c:
            links.append(member_edges(c, known))
    facts = graph.union(found).withColumns({"hash": content_hash(F.col("payload")), "ref_only": F.lit(False)})
    empty = graph.empty_like(facts.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.col("id").alias("edge_kind")))
    return graph.cut(facts), graph.cut(graph.union(links).distinct() if links else empty)
