"""Each catalog family on a small database."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_map
from factloom.operators import graph
from factloom.sources import catalogs

T = {
    "pg_namespace": ("oid long, nspname string", [(1, "app"), (2, "pg_catalog"), (3, "ext"), (4, "pg_toast_9"), (5, "pgx")]),
    "pg_extension": ("oid long, extname string, extnamespace long, extrelocatable boolean, extversion string", [(90, "geo", 3, True, "1")]),
    "pg_roles": ("oid long, rolname string, rolsuper boolean, rolinherit boolean, rolcreaterole boolean, rolcreatedb boolean, rolcanlogin boolean, rolreplication boolean, rolbypassrls boolean, rolconnlimit int, rolvaliduntil string", [(10, "me", False, True, False, False, True, False, False, -1, None), (11, "pg_read", False, False, False, False, False, False, False, -1, None), (12, "you", True, True, False, False, False, False, False, 3, "x")]),
    "pg_db_role_setting": ("setdatabase long, setrole long, setconfig array<string>", [(0, 10, ["b=2", "a=1"]), (7, 12, ["z=1"])]),
    "pg_auth_members": ("roleid long, member long, grantor long, admin_option boolean", [(10, 12, 1, False), (10, 12, 2, True)]),
    "pg_default_acl": ("rolname string, nspname string, objtype string, acl array<string>", [("me", None, "f", ["me=X", "you=X"]), ("me", "app", "r", ["you=r"])]),
    "builtin_default_acl": ("rolname string, nspname string, objtype string, acl array<string>", [("me", None, "f", ["me=X", "PUBLIC=X"]), ("me", "app", "r", ["you=r"])]),
    "pg_class": ("oid long, relname string, relnamespace long, relkind string, relpersistence string, relrowsecurity boolean, relforcerowsecurity boolean, relreplident string, reloptions array<string>, partkeydef string, partbound string", [
        (100, "t", 1, "p", "p", True, False, "d", ["b=1", "a=2"], "LIST (x)", None), (101, "t1", 1, "r", "p", False, False, "d", None, None, "FOR VALUES"), (102, "i", 1, "i", "p", False, False, "n", None, None, None),
        (103, "pk", 1, "i", "p", False, False, "n", None, None, None), (104, "s", 1, "S", "p", False, False, "n", None, None, None), (105, "ids", 1, "S", "p", False, False, "n", None, None, None), (106, "v", 1, "v", "p", False, False, "n", None, None, None),
        (107, "ft", 1, "f", "p", False, False, "n", None, None, None), (108, "comp", 1, "c", "p", False, False, "n", None, None, None), (109, "spatial", 3, "r", "p", False, False, "d", None, None, None), (110, "sys", 2, "r", "p", False, False, "d", None, None, None),
    ]),
    "pg_inherits": ("inhrelid long, inhparent long, inhseqno int", [(101, 100, 1), (101, 109, 2)]),
    "pg_attribute": ("attrelid long, attnum int, attname string, type_name string, attnotnull boolean, attidentity string, attgenerated string, collname string, attisdropped boolean, attislocal boolean, attinhcount int", [
        (100, 1, "x", "int4", True, "a", "", None, False, True, 0), (100, 2, "g", "int4", False, "", "s", None, False, True, 0), (100, 3, "d", "text", False, "", "", "C", False, True, 0), (100, 4, "gone", "text", False, "", "", None, True, True, 0),
        (101, 1, "x", "int4", True, "", "", None, False, False, 1), (108, 1, "a", "int4", False, "", "", None, False, True, 0),
    ]),
    "pg_attrdef": ("adrelid long, adnum int, expr string", [(100, 2, "x * 2"), (100, 3, "'d'")]),
    "pg_constraint": ("oid long, conname string, conrelid long, contypid long, conindid long, contype string, def string, convalidated boolean, conislocal boolean", [(200, "pk", 100, 0, 103, "p", "PRIMARY KEY (x)", True, True), (201, "inh", 101, 0, 0, "c", "CHECK", True, False), (202, "pos", 0, 301, 0, "c", "CHECK (VALUE > 0)", True, True)]),
    "pg_index": ("indexrelid long, indrelid long, def string, indisvalid boolean", [(102, 100, "CREATE INDEX i", True), (103, 100, "CREATE UNIQUE INDEX pk", True)]),
    "pg_sequence": ("seqrelid long, type_name string, seqincrement long, seqmin long, seqmax long, seqstart long, seqcache long, seqcycle boolean", [(104, "int8", 1, 1, 9, 1, 1, False), (105, "int8", 1, 1, 9, 1, 1, False)]),
    "pg_depend": ("classid string, objid long, objsubid int, refclassid string, refobjid long, refobjsubid int, deptype string", [
        ("pg_class", 104, 0, "pg_class", 100, 1, "a"), ("pg_class", 105, 0, "pg_class", 100, 1, "i"), ("pg_class", 109, 0, "pg_extension", 90, 0, "e"), ("pg_namespace", 3, 0, "pg_extension", 90, 0, "e"), ("pg_rewrite", 400, 0, "pg_class", 100, 1, "n"),
        ("pg_rewrite", 400, 0, "pg_class", 100, 1, "n"), ("pg_rewrite", 400, 0, "pg_class", 110, 0, "n"), ("pg_proc", 500, 0, "pg_type", 301, 0, "n"),
    ]),
    "pg_views_def": ("oid long, def string", [(106, "SELECT x FROM t")]),
    "pg_trigger": ("oid long, tgrelid long, tgname string, tgisinternal boolean, def string, tgenabled string", [(1, 100, "tr", False, "CREATE TRIGGER", "O"), (2, 100, "ri", True, "x", "O")]),
    "pg_rewrite": ("oid long, ev_class long, rulename string, def string, ev_enabled string", [(400, 106, "_RETURN", "x", "O"), (401, 100, "r1", "CREATE RULE", "O")]),
    "pg_type": ("oid long, typname string, typnamespace long, typtype string, type_name string, typrelid long, basetype_name string, typdefault string, typnotnull boolean, collname string", [(300, "int4", 2, "b", "int4", 0, None, None, False, None), (301, "dom", 1, "d", "app.dom", 0, "int4", "1", True, None), (302, "mood", 1, "e", "app.mood", 0, None, None, False, None), (303, "comp", 1, "c", "app.comp", 108, None, None, False, None), (304, "rng", 1, "r", "app.rng", 0, None, None, False, None), (305, "t", 1, "c", "app.t", 100, None, None, False, None)]),
    "pg_enum": ("enumtypid long, enumsortorder double, enumlabel string", [(302, 2.0, "sad"), (302, 1.0, "ok")]),
    "pg_range": ("rngtypid long, subtype_name string, opclass_name string, subdiff_name string, multirange_name string", [(304, "int4", "int4_ops", None, "mrng")]),
    "pg_proc": ("oid long, proname string, pronamespace long, prokind string, proargtypes array<long>, def string, rettype_name string, lanname string, proconfig array<string>, proparallel string", [(500, "f", 1, "f", [301, 300], "CREATE FUNCTION", "int4", "sql", ["b=secret", "a=1"], "u"), (501, "p", 1, "p", [], "CREATE PROCEDURE", None, "sql", None, "u"), (502, "agg", 1, "a", [300], None, "int4", "internal", None, "s")]),
    "pg_aggregate": ("aggfnoid long, aggkind string, aggtransfn string, aggtranstype string", [(502, "n", "int4pl", "int4")]),
    "pg_policy": ("oid long, polrelid long, polname string, polroles array<long>, qual string, withcheck string, polcmd string, polpermissive boolean", [(1, 100, "all", [0], "true", None, "*", True), (2, 100, "some", [12, 10, 77], "x", "y", "r", False)]),
    "pg_collation": ("oid long, collname string, collnamespace long, collprovider string, collisdeterministic boolean, colllocale string, collcollate string, collctype string", [(1, "c", 1, "i", False, "de", None, None)]),
    "pg_event_trigger": ("oid long, evtname string, evtevent string, evttags array<string>, func_schema string, func_name string, evtenabled string", [(1, "et", "ddl_command_end", None, "app", "f", "O")]),
    "pg_publication": ("oid long, pubname string, pubinsert boolean, pubupdate boolean, pubdelete boolean, pubtruncate boolean, pubviaroot boolean, puballtables boolean", [(1, "pub", True, False, True, False, False, False)]),
    "pg_publication_rel": ("prpubid long, prrelid long, columns array<string>, qual string", [(1, 100, ["x"], "x > 1")]), "pg_publication_namespace": ("pnpubid long, pnnspid long", [(1, 1)]),
    "pg_subscription": ("subname string, subenabled boolean, subpublications array<string>, subconninfo string, subslotname string, subtwophasestate string", [("sub", True, ["b", "a"], "host=h password=p", "slot", "d")]),
    "pg_foreign_data_wrapper": ("oid long, fdwname string, handler_name string, validator_name string, fdwoptions array<string>", [(1, "w", "h", None, None)]),
    "pg_foreign_server": ("oid long, srvname string, srvfdw long, srvtype string, srvversion string, srvoptions array<string>", [(1, "srv", 1, None, "1", ["port=1", "host=h"])]),
    "pg_user_mapping": ("umserver long, umuser long, umoptions array<string>, readable boolean", [(1, 10, ["user=u", "password=p"], True), (1, 0, None, False)]), "pg_foreign_table": ("ftrelid long, ftserver long, ftoptions array<string>", [(107, 1, ["table_name=x"])]),
    "pg_seclabel": ("classid string, objid long, objsubid int, provider string, label string", [("pg_class", 100, 0, "se", "secret"), ("pg_class", 100, 1, "se", "column"), ("pg_odd", 9, 0, "se", "x"), ("pg_odd", 8, 0, "se", "y")]),
}


@pytest.fixture(scope="module")
def c(spark):
    return {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in T.items()}


def found(df):
    return {r["id"]: (r["parent_id"], r["p"]) for r in df.select("id", "parent_id", canonical_map(F.col("payload")).alias("p")).collect()}


WANT = {
    "roles": {"role:me": (None, '{"config":["a=1","b=2"],"connectionLimit":-1,"flags":["canlogin","inherit"],"validUntil":null}'), "role:you": (None, '{"config":[],"connectionLimit":3,"flags":["inherit","super"],"validUntil":"x"}')},
    "memberships": {"membership:me.you": ("role:me", '{"admin":true}')},
    "defaultPrivileges": {'defaultPrivilege:me."".f.you': ("role:me", '{"privileges":"X"}'), 'defaultPrivilege:me."".f.PUBLIC': ("role:me", '{"privileges":""}')},
    "schemas": {"schema:app": (None, "{}"), "schema:pgx": (None, "{}")}, "extensions": {"extension:geo": (None, '{"schema":"ext"}')},
    "tables": {
        "table:app.t": ("schema:app", '{"forceRowSecurity":false,"parentTable":null,"partitionBound":null,"partitionKey":"LIST (x)","persistence":"permanent","reloptions":["a=2","b=1"],"replicaIdentity":"default","rowSecurity":true}'),
        "table:app.t1": ("schema:app", '{"forceRowSecurity":false,"parentTable":"app.t","partitionBound":"FOR VALUES","partitionKey":null,"persistence":"permanent","reloptions":[],"replicaIdentity":"default","rowSecurity":false}'),
    },
    "columns": {
        "column:app.t.x": ("table:app.t", '{"collation":null,"generatedExpr":null,"identity":"a","notNull":true,"type":"int4"}'), "column:app.t.g": ("table:app.t", '{"collation":null,"generatedExpr":"x * 2","identity":null,"notNull":false,"type":"int4"}'),
        "column:app.t.d": ("table:app.t", '{"collation":"C","generatedExpr":null,"identity":null,"notNull":false,"type":"text"}'),
    },
    "defaults": {"default:app.t.d": ("column:app.t.d", '{"expr":"\'d\'"}')}, "constraints": {"constraint:app.t.pk": ("table:app.t", '{"def":"PRIMARY KEY (x)","type":"primary","validated":true}')},
    "indexes": {"index:app.i": ("table:app.t", '{"def":"CREATE INDEX i","valid":true}')},
    "sequences": {"sequence:app.s": ("schema:app", '{"cache":1,"cycle":false,"dataType":"int8","increment":1,"maxValue":9,"minValue":1,"ownedBy":"app.t.x","start":1}')},
    "views": {"view:app.v": ("schema:app", '{"def":"SELECT x FROM t","reloptions":[]}')}, "triggers": {"trigger:app.t.tr": ("table:app.t", '{"def":"CREATE TRIGGER","enabled":"O"}')}, "rules": {"rule:app.t.r1": ("table:app.t", '{"def":"CREATE RULE","enabled":"O"}')},
    "routines": {
        'function:app.f."(app.dom,int4)"': ("schema:app", '{"argSignature":"(app.dom,int4)","def":"CREATE FUNCTION","isWindow":false,"language":"sql","returnType":"int4"}'),
        'procedure:app.p."()"': ("schema:app", '{"argSignature":"()","def":"CREATE PROCEDURE","isWindow":false,"language":"sql","returnType":null}'),
    },
    "aggregates": {'aggregate:app.agg."(int4)"': ("schema:app", '{"aggKind":"n","parallel":"s","sfunc":"int4pl","stype":"int4"}')},
    "policies": {"policy:app.t.all": ("table:app.t", '{"checkExpr":null,"cmd":"*","permissive":true,"roles":["PUBLIC"],"usingExpr":"true"}'), "policy:app.t.some": ("table:app.t", '{"checkExpr":"y","cmd":"r","permissive":false,"roles":["me","you"],"usingExpr":"x"}')},
    "domains": {"domain:app.dom": ("schema:app", '{"baseType":"int4","collation":null,"default":"1","notNull":true}'), "constraint:app.dom.pos": ("domain:app.dom", '{"def":"CHECK (VALUE > 0)","type":"check","validated":true}')},
    "types": {
        "type:app.mood": ("schema:app", '{"values":["ok","sad"],"variant":"enum"}'), "type:app.comp": ("schema:app", '{"variant":"composite"}'), "typeAttribute:app.comp.a": ("type:app.comp", '{"collation":null,"type":"int4"}'),
        "type:app.rng": ("schema:app", '{"multirangeTypeName":"mrng","subtype":"int4","subtypeDiff":null,"subtypeOpclass":"int4_ops","variant":"range"}'),
    },
    "collations": {"collation:app.c": ("schema:app", '{"deterministic":false,"lcCollate":null,"lcCtype":null,"locale":"de","provider":"i"}')},
    "eventTriggers": {"eventTrigger:et": (None, '{"enabled":"O","event":"ddl_command_end","functionName":"f","functionSchema":"app","tags":[]}')},
    "publications": {"publication:pub": (None, '{"allTables":false,"publish":["delete","insert"],"viaRoot":false}'), "publicationRel:pub.app.t": ("publication:pub", '{"columns":["x"],"where":"x > 1"}'), "publicationSchema:pub.app": ("publication:pub", "{}")},
    "subscriptions": {"subscription:sub": (None, '{"conninfo":"host=h password=__REDACTED__","enabled":true,"publications":["a","b"],"slotName":"slot","twoPhase":"d"}')},
    "foreign": {
        "fdw:w": (None, '{"handler":"h","options":[],"validator":null}'), "server:srv": ("fdw:w", '{"fdw":"w","options":["host=h","port=1"],"type":null,"version":"1"}'), "userMapping:srv.me": ("server:srv", '{"options":["password=__REDACTED__","user=u"]}'),
        "foreignTable:app.ft": ("schema:app", '{"options":["table_name=x"],"server":"srv"}'),
    },
}


@pytest.mark.parametrize("name", [n for n, *_ in catalogs.FAMILIES])
def test_family(c, name):
    (own,) = [f for n, f, _ in catalogs.FAMILIES if n == name]
    assert found(own(c)) == WANT[name]


def test_extract(c, spark):
    facts, edges = catalogs.extract(c)
    assert facts.count() == sum(map(len, WANT.values())) + 2 == facts.select("id").distinct().count()
    links = {(r["from_id"], r["to_id"], r["edge_kind"]) for r in edges.collect()}
    assert {("table:app.t1", "table:app.t", "depends"), ("view:app.v", "column:app.t.x", "depends"), ('function:app.f."(app.dom,int4)"', "domain:app.dom", "depends"), ("table:ext.spatial", "extension:geo", "memberOfExtension")} <= links
    assert not any(a == b for a, b, _ in links)
    labels = found(facts.where("kind = 'securityLabel'"))
    assert labels == {"securityLabel:(table:app.t).se": ("table:app.t", '{"label":"secret"}'), "securityLabel:(column:app.t.x).se": ("column:app.t.x", '{"label":"column"}')}
    assert [r["id"] for r in catalogs.unreadable_mappings(c).collect()] == ["userMapping:srv.PUBLIC"]
    known = spark.createDataFrame([("pg_class", 100, 0, "x"), ("pg_class", 100, 1, "y")], "classid string, objid long, objsubid int, id string")
    assert [tuple(r) for r in catalogs.unresolved_labels(c, known).collect()] == [("pg_odd", 2, "8,9")]
    kept, lost = catalogs.pruned(facts.where("id <> 'column:app.t.x'"))
    assert [r["id"] for r in lost.collect()] == ["securityLabel:(column:app.t.x).se"] and kept.where("kind = 'securityLabel'").count() == 1
    assert graph.rollups(facts, edges).count() == facts.count()
    few, none = catalogs.extract({n: c[n] for n in ("pg_roles", "pg_db_role_setting")})
    assert few.count() == 2 and none.count() == 0


def test_scan(c, spark, tmp_path):
    for n in ("pg_roles", "pg_namespace"):
        c[n].write.parquet(f"{tmp_path}/{n}.parquet")
    back = catalogs.scan(spark, str(tmp_path), ["pg_roles", "pg_namespace"])
    assert back["pg_roles"].count() == 3 and catalogs.user_schemas(back).count() == 3
