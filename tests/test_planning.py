"""Rules, emission, order, compaction, providers, snapshots and exports on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import extensions
from factloom.functions import canonical
from factloom.functions.canonical import content_hash
from factloom.operators import diff, export, extraction, graph, policy, proof, statements, view
from factloom.plans import actions, compaction, emission, rules
from factloom.sources import snapshots
from tests.test_operators import snapshot

FACT = "id string, kind string, parent_id string, payload map<string,string>, ref_only boolean"
EDGE = "from_id string, to_id string, edge_kind string"


def facts(spark, rows):
    full = [(i, i.split(":")[0], p, m, False) for i, p, m in rows]
    return spark.createDataFrame(full, FACT).withColumn("hash", content_hash(F.col("payload")))


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


SOURCE = [
    ("schema:s", None, {}), ("table:s.t", "schema:s", {}), ("column:s.t.a", "table:s.t", {"type": '"int"'}), ("column:s.t.b", "table:s.t", {"type": '"text"'}), ("policy:s.t.p", "table:s.t", {"cmd": '"r"'}),
    ("view:s.v", "schema:s", {"def": '"1"'}), ("view:s.w", "schema:s", {"def": '"2"'}), ("comment:(view:s.w)", "view:s.w", {"text": '"c"'}), ("function:s.f", "schema:s", {"def": '"x"'}), ("role:r", None, {}),
]
LINKS = [("view:s.v", "column:s.t.a", "depends"), ("view:s.w", "view:s.v", "depends"), ("function:s.f", "table:s.t", "depends"), ("view:s.w", "role:r", "owner")]


def planned(spark, desired, links=LINKS, renames=None):
    a, b = facts(spark, SOURCE), facts(spark, desired)
    ea, eb = edges(spark, LINKS), edges(spark, links)
    c = emission.changes(a, ea, b, diff.fact_deltas(a, b), rules.Rules())
    own, touches = emission.emit(a, b, eb, c, rules.Rules(), renames)
    depends = lambda e: e.where("edge_kind = 'depends'")
    links_ = actions.action_edges(touches, depends(eb), depends(ea), a.select("id", "parent_id"))
    placed = own.join(actions.ordered(actions.keyed(own), links_, "action"), "action")
    return c, placed, touches, links_


def changed(**new):
    """The source with other payloads by id; None leaves a fact out."""
    return [(i, p, new.get(i.replace(":", "_").replace(".", "_").replace("(", "").replace(")", ""), m)) for i, p, m in SOURCE if new.get(i.replace(":", "_").replace(".", "_").replace("(", "").replace(")", ""), m) is not None]


def test_a_changed_column_type_rebuilds_what_depends_on_it(spark):
    c, placed, touches, links = planned(spark, changed(column_s_t_a={"type": '"bigint"'}))
    # Views are rebuilt, the view on the view too; the function isn't asked for by the column.
    assert ids(c.replaced) == ["view:s.v", "view:s.w"]
    order = [r["action"] for r in placed.orderBy("position").collect()]
    assert order == ["drop|view:s.w|", "drop|view:s.v|", "alter|column:s.t.a|type", "create|view:s.v|", "create|view:s.w|", "owner|view:s.w|owner", "create|comment:(view:s.w)|"]
    assert placed.where("rewrite").count() == 1
    by_level = actions.ordered(actions.keyed(placed.drop("position")), links, "action", most=0)
    at = {r["action"]: r["position"] for r in by_level.collect()}
    assert sorted(at.values()) == list(range(7)) and all(at[r["src"]] < at[r["dst"]] for r in links.collect())
    assert emission.unproduced(c.added, touches).count() == 0


def test_drops_fold_into_the_table_but_not_out_of_it(spark):
    kept = [r for r in SOURCE if not r[0].split(":")[1].startswith("s.t") and r[0] not in ("view:s.v", "view:s.w", "comment:(view:s.w)")]
    c, placed, touches, _ = planned(spark, kept, [("function:s.f", "schema:s", "depends")])
    drops = {r["subject"]: r["destructive"] for r in placed.where("verb = 'drop'").collect()}
    assert drops["table:s.t"] and not drops["view:s.v"] and set(drops) == {"table:s.t", "view:s.v", "view:s.w", "function:s.f"}
    assert ids(touches.where("action = 'drop|table:s.t|' and role = 'destroys'")) == ["column:s.t.a", "column:s.t.b", "policy:s.t.p", "table:s.t"]
    assert placed.where("verb = 'create'").select("subject").first()[0] == "function:s.f"  # rebuilt: it needed the table
    loud = actions.destruction_violations(placed, touches, facts(spark, SOURCE), ("table", "column"))
    quiet = actions.destruction_violations(placed.withColumn("destructive", F.lit(False)), touches, facts(spark, SOURCE), ("table", "column"))
    assert loud.count() == 0 and ids(quiet) == ["table:s.t"]
    assert actions.destruction_violations(placed.withColumn("destructive", F.lit(False)), touches, facts(spark, SOURCE), ("table",), spark.createDataFrame([("table:s.t",)], "id string")).count() == 0


def test_unknown_attributes_are_refused(spark):
    with pytest.raises(ValueError, match="no rule for table.odd"):
        planned(spark, changed(table_s_t={"odd": "1"}))


def test_renames_move_subtrees(spark):
    moved = [(i.replace("s.t", "s.n"), p and p.replace("s.t", "s.n"), m) for i, p, m in SOURCE if not i.startswith(("view", "comment", "function"))]
    rest = [r for r in SOURCE if r[0].startswith(("view", "comment", "function"))]
    a, b = facts(spark, SOURCE), facts(spark, moved + rest)
    e = edges(spark, [])
    found = [graph.rollups(x, e).select("id", "structural") for x in (a, b)]
    lone = [view.lone(x, y).join(s, "id") for x, y, s in ((a, b, found[0]), (b, a, found[1]))]
    candidates = view.rename_candidates(*lone, ["kind", "parent_id", "structural"])
    assert [tuple(r) for r in candidates.collect()] == [("table:s.t", "table:s.n", "unambiguous")]
    assert view.accepted(candidates).count() == 0 and view.accepted(candidates, "auto").count() == 1
    assert view.accepted(candidates, "prompt", candidates).count() == 1
    assert view.confirmed(view.accepted(candidates, "auto"), found[0], e, found[1], e).first()["ok"]
    other = edges(spark, [("view:s.v", "table:s.n", "depends")])
    assert not view.confirmed(view.accepted(candidates, "auto"), found[0], e, found[1], other).first()["ok"]
    c = emission.changes(a, e, b, diff.fact_deltas(a, b), rules.Rules())
    own, touches = emission.emit(a, b, e, c, rules.Rules(), view.accepted(candidates, "auto"))
    assert [r["action"] for r in own.collect()] == ["rename|table:s.t|table:s.n"]
    assert ids(touches.where("role = 'produces'")) == ["column:s.n.a", "column:s.n.b", "policy:s.n.p", "table:s.n"]
    assert emission.unproduced(c.added, touches).count() == 0


def test_a_seed_of_unset_version_is_replaced(spark):
    sets = spark.createDataFrame([("server:x", "version", '"1"', None, "server"), ("server:y", "version", '"1"', '"2"', "server"), ("extensionIntent:a.b.c", "any", "1", "2", "extensionIntent")], "id string, attr string, from_val string, to_val string, kind string")
    assert {r["id"]: r["mode"] for r in rules.modes(sets, rules.Rules()).collect()} == {"server:x": "replace", "server:y": "alter", "extensionIntent:a.b.c": "replace"}


def test_hygiene_revokes_what_defaults_give(spark):
    created = spark.createDataFrame([("table:s.t", "table"), ("function:z.f", "function"), ("schema:s", "schema")], "id string, kind string")
    owners = spark.createDataFrame([("table:s.t", "o"), ("function:z.f", "o")], "id string, role string")
    defaults = spark.createDataFrame([("o", "s", "r", "x"), ("o", None, "r", "y"), ("o", "other", "r", "w"), ("o", None, "r", "o"), ("o", None, "f", "PUBLIC"), ("q", None, "f", "x")], "role string, schema string, objtype string, grantee string")
    acls = spark.createDataFrame([("table:s.t", "y")], "id string, grantee string")
    wanted = emission.hygiene(created, owners, defaults, acls)
    assert sorted(map(tuple, wanted.collect())) == [("function:z.f", "PUBLIC"), ("table:s.t", "x")]
    own, touches = emission.revokes(wanted.join(created, "id"))
    assert sorted(r["text"] for r in own.collect()) == ["REVOKE ALL ON function:z.f FROM PUBLIC", "REVOKE ALL ON table:s.t FROM x"] and ids(touches) == ["function:z.f", "role:x", "table:s.t"]


def plan(spark, rows):
    """``verb, subject, text[, detail]`` in order."""
    full = [(f"{v}|{s}|{i}", i, v, s, s.split(":")[0], d, t, False, False, False, False) for i, (v, s, t, d) in enumerate(rows)]
    return spark.createDataFrame(full, "action string, position long, verb string, subject string, kind string, detail string, text string, new_segment boolean, non_tx boolean, commit_after boolean, destructive boolean")


def touches_of(spark, rows):
    return spark.createDataFrame(rows, "action string, role string, id string")


def texts(df):
    return [r["text"] for r in df.orderBy("position").collect()]


def test_columns_fold_unless_something_they_need_comes_later(spark):
    placed = plan(spark, [("create", "table:s.t", "CREATE TABLE t", ""), ("create", "column:s.t.a", "a int", ""), ("create", "type:s.x", "TYPE x", ""), ("create", "column:s.t.b", "b x", ""), ("create", "column:s.t.c", "c int", "")])
    parents = spark.createDataFrame([(f"column:s.t.{c}", "table:s.t") for c in "abc"], "id string, parent_id string")
    needs = spark.createDataFrame([("create|table:s.t|0", f"create|column:s.t.{c}|{i}") for i, c in ((1, "a"), (3, "b"), (4, "c"))] + [("create|type:s.x|2", "create|column:s.t.b|3")], "src string, dst string")
    none = touches_of(spark, [("x", "produces", "x")])
    assert texts(compaction.fold_columns(placed, none, needs, parents)) == ["CREATE TABLE t (a int, c int)", "TYPE x", "b x"]
    cut = placed.withColumn("new_segment", F.col("position") == 2)
    assert texts(compaction.fold_columns(cut, none, needs, parents)) == ["CREATE TABLE t (a int)", "TYPE x", "b x", "c int"]


def test_a_drop_that_a_create_undoes_goes(spark):
    rows = [("drop", "default:s.t.a", "SET x", ""), ("create", "default:s.t.a", "SET x", ""), ("drop", "default:s.t.b", "SET y", ""), ("create", "default:s.t.b", "SET z", "")]
    placed = plan(spark, rows)
    t = [(f"{v}|{s}|{i}", "destroys" if v == "drop" else "produces", s) for i, (v, s, *_) in enumerate(rows)]
    t += [("drop|default:s.t.a|0", "consumes", "column:s.t.a"), ("create|default:s.t.a|1", "consumes", "column:s.t.a"), ("create|default:s.t.a|1", "consumes", "function:f")]
    parents = spark.createDataFrame([("default:s.t.a", "column:s.t.a")], "id string, parent_id string")
    assert texts(compaction.elide_drops(placed, touches_of(spark, t), parents)) == ["SET x", "SET y", "SET z"]
    # Kept: released, with children, or with a requirement that the create lacks.
    assert compaction.elide_drops(placed, touches_of(spark, [*t, ("q", "releases", "default:s.t.a")]), parents).count() == 4
    assert compaction.elide_drops(placed, touches_of(spark, t), spark.createDataFrame([("comment:(default:s.t.a)", "default:s.t.a")], "id string, parent_id string")).count() == 4
    assert compaction.elide_drops(placed, touches_of(spark, [*t, ("drop|default:s.t.a|0", "consumes", "role:z")]), parents).count() == 4


def test_policy_drops_go_with_their_table_unless_they_bear(spark):
    source = facts(spark, [("table:s.t", None, {}), ("column:s.t.a", "table:s.t", {}), ("policy:s.t.p", "table:s.t", {}), ("policy:s.t.q", "table:s.t", {}), ("view:s.v", None, {}), ("table:s.u", None, {}), ("policy:s.u.r", "table:s.u", {})])
    rows = [("drop", "policy:s.t.p", "p", ""), ("drop", "policy:s.t.q", "q", ""), ("drop", "policy:s.u.r", "r", ""), ("drop", "view:s.v", "v", ""), ("drop", "table:s.t", "t", "")]
    t = [(f"drop|{s}|{i}", "destroys", s) for i, (_, s, *_) in enumerate(rows)] + [("drop|table:s.t|4", "destroys", "column:s.t.a")]
    links = edges(spark, [("policy:s.t.p", "column:s.t.a", "depends"), ("policy:s.t.q", "view:s.v", "depends")])
    assert texts(compaction.elide_policy_drops(plan(spark, rows), touches_of(spark, t), source, links)) == ["q", "r", "v", "t"]


def acl(i, privileges, grantable=(), default=None):
    return (i, i[5:].split(")")[0], {"privileges": json.dumps(list(privileges)), "grantable": json.dumps(list(grantable)), **({"_ownerDefault": json.dumps(list(default))} if default else {})})


def test_default_grants_and_cosmetic_revokes_go(spark):
    found = facts(spark, [acl("acl:(function:s.f).PUBLIC", ["EXECUTE"]), acl("acl:(table:s.t).o", ["SELECT", "INSERT"], (), ["INSERT", "SELECT"]), acl("acl:(table:s.t).x", ["SELECT"]), acl("acl:(table:s.t).y", ["SELECT"], ["SELECT"]), acl("acl:(view:s.v).x", ["SELECT"])])
    acls = compaction.acl_rows(found)
    owners = compaction.owner_rows(edges(spark, [("table:s.t", "role:o", "owner")]))
    rows = [("create", "function:s.f", "F", ""), ("create", "table:s.t", "T", "")]
    t = [("create|function:s.f|0", "produces", "function:s.f"), ("create|table:s.t|1", "produces", "table:s.t")]
    for r in found.orderBy("id").collect():
        n = len(rows)
        rows += [("create", r["id"], f"REVOKE {r['id']}", ""), ("create", r["id"], f"GRANT {r['id']}", "")]
        t += [(f"create|{r['id']}|{n}", "produces", r["id"]), (f"create|{r['id']}|{n + 1}", "consumes", r["id"])]
    placed, t = plan(spark, rows), touches_of(spark, t)
    none = spark.createDataFrame([], "grantee string, objtype string, privilege string")
    left = compaction.elide_default_acls(placed, t, acls, owners, none)
    assert [x for x in texts(left) if "PUBLIC" in x or ").o" in x] == []
    changed_default = spark.createDataFrame([("x", "r", "UPDATE")], "grantee string, objtype string, privilege string")
    assert [x for x in texts(compaction.elide_default_acls(placed, t, acls, owners, changed_default)) if ").o" in x]
    trimmed = texts(compaction.trim_revokes(left, t, acls, none))
    assert trimmed == ["F", "T", "GRANT acl:(table:s.t).x", "REVOKE acl:(table:s.t).y", "GRANT acl:(table:s.t).y", "REVOKE acl:(view:s.v).x", "GRANT acl:(view:s.v).x"]
    # A default that gives more than the grant makes the revoke needed.
    assert "REVOKE acl:(table:s.t).x" in texts(compaction.trim_revokes(left, t, acls, changed_default))


def test_owners_fold_and_grants_merge(spark):
    rows = [("create", "schema:s", "CREATE SCHEMA s", ""), ("alter", "schema:s", "ALTER", "owner"), ("create", "table:s.t", "CREATE TABLE t", ""), ("alter", "table:s.t", "ALTER t", "owner")]
    t = touches_of(spark, [("create|schema:s|0", "produces", "schema:s"), ("create|table:s.t|2", "produces", "table:s.t")])
    owners = spark.createDataFrame([("schema:s", "o"), ("table:s.t", "o")], "id string, role string")
    assert texts(compaction.fold_owners(plan(spark, rows), t, owners)) == ["CREATE SCHEMA s AUTHORIZATION o", "CREATE TABLE t", "ALTER t"]
    assert texts(compaction.fold_owners(plan(spark, rows), t, owners, "o")) == ["CREATE SCHEMA s AUTHORIZATION o", "CREATE TABLE t"]
    grants = plan(spark, [("alter", "table:s.t", "GRANT SELECT", g) for g in ("a", "b")] + [("create", "table:s.u", "U", "")] + [("alter", "table:s.t", "GRANT SELECT", "c")])
    merged = compaction.merge_grants(grants, F.when(F.col("text").startswith("GRANT"), F.concat_ws("|", "subject", "text")))
    assert [(r["text"], r["detail"]) for r in merged.orderBy("position").collect()] == [("GRANT SELECT", "a, b"), ("U", ""), ("GRANT SELECT", "c")]


def test_compaction_as_a_whole(spark):
    _, placed, touches, links = planned(spark, [*SOURCE, ("table:s.n", "schema:s", {}), ("column:s.n.a", "table:s.n", {"type": '"int"'})], [*LINKS, ("table:s.n", "role:r", "owner")])
    a, b = facts(spark, SOURCE), facts(spark, [*SOURCE, ("table:s.n", "schema:s", {}), ("column:s.n.a", "table:s.n", {"type": '"int"'})])
    none = spark.createDataFrame([], "grantee string, objtype string, privilege string")
    owners = spark.createDataFrame([("table:s.n", "r")], "id string, role string")
    got = compaction.compacted(placed, touches, links, graph.union([a, b]).select("id", "kind", "parent_id").distinct(), edges(spark, LINKS), compaction.acl_rows(a), owners, none, "r")
    assert texts(got) == ['CREATE table table:s.n {} (CREATE column column:s.n.a {"type":"int"})'] and got.first()["position"] == 0


def test_evaluators_and_columns_in_order(spark):
    f = facts(spark, [("function:s.f", None, {}), ("domain:s.d", None, {}), ("constraint:s.d.c", "domain:s.d", {}), ("default:s.t.a", None, {}), ("default:s.t.b", None, {}), ("x:1", None, {})])
    links = edges(spark, [("constraint:s.d.c", "function:s.f", "depends"), ("default:s.t.a", "domain:s.d", "depends"), ("x:1", "default:s.t.a", "depends"), ("default:s.t.a", "x:1", "depends")])
    late = actions.evaluators(f.select("id"), links, f)
    assert ids(late) == ["constraint:s.d.c", "default:s.t.a", "domain:s.d", "function:s.f", "x:1"]
    own = plan(spark, [("create", "column:s.t.b", "", ""), ("create", "column:s.t.a", "", ""), ("create", "default:s.t.a", "", ""), ("create", "default:s.t.b", "", "")]).drop("position")
    places = spark.createDataFrame([("column:s.t.b", 1), ("column:s.t.a", 2)], "id string, place int")
    order = actions.ordered(actions.keyed(own, late, places), spark.createDataFrame([], "src string, dst string"), "action")
    assert [r["action"].split("|")[1] for r in order.orderBy("position").collect()] == ["column:s.t.b", "column:s.t.a", "default:s.t.b", "default:s.t.a"]


def test_gates_and_assumptions(spark):
    f = facts(spark, [("schema:auth", None, {}), ("table:auth.t", "schema:auth", {}), ("schema:own", None, {}), ("role:r", None, {})])
    links = edges(spark, [("schema:own", "role:platform", "owner")])
    assert ids(actions.assumed(f, links, ("auth",), ("platform",))) == ["role:platform", "schema:auth", "table:auth.t"]
    assert ids(export.seeds(f, ("auth",))) == ["schema:auth", "table:auth.t"]
    assert actions.preamble(plan(spark, [("create", "function:s.f", "", "")])).first()[0] and not actions.preamble(plan(spark, [("create", "table:s.f", "", "")])).first()[0]
    one, two = (actions.plan_id(plan(spark, [("create", "table:s.a", t, ""), ("create", "table:s.b", "y", "")])).first()[0] for t in "xy")
    assert one != two


@pytest.mark.parametrize(
    "required, provided, fits",
    [
        (None, "(int4)", True), ("(int4)", None, False), ("(bigint)", "(pg_catalog.int8)", True), ("(a.t)", "(b.t)", False), ("(t)", "(b.t)", True), ("(int4)", "(int4,text)", True),
        ("(int4,text)", "(int4)", False), ("(unknown)", "(json)", True), ("(json)", "(anyelement)", True), ("(x => int4)", "(text)", True), ("(int4,int4,int4)", "(int4,variadic int4)", True),
        ("()", "(int4,variadic int4)", False), ("(int4)", "(int4,variadic text)", True), ("(int4,json)", "(int4,variadic text)", False), ("()", "()", True), ("(Double Precision)", "(float8)", True),
    ],
)
def test_signatures(spark, required, provided, fits):
    df = spark.createDataFrame([(required, provided)], "r string, p string")
    assert df.select(statements.signatures_compatible(F.col("r"), F.col("p"))).first()[0] is fits


REF = "node int, kind string, schema string, name string, signature string, key string"


def refs(spark, rows):
    return spark.createDataFrame([(n, k, s, name, sig, f"{k}:{s or ''}:{name}:{sig or ''}") for n, k, s, name, sig in rows], REF)


def test_providers(spark):
    have = refs(spark, [(1, "view", "s", "v", None), (2, "function", "s", "f", "(int4)"), (3, "function", "s", "f", "(int4,text)"), (4, "table", "s", "d", None), (5, "table", "s", "d", None), (6, "constraint", "s", "k", None), (7, "constraint", "s", "k", None), (8, "table", "s", "self", None), (2, "table", "s", "needs9", None)])
    need = refs(spark, [(9, "table", "s", "v", None), (9, "function", "s", "f", "(bigint)"), (9, "function", "s", "f", "(integer)"), (9, "table", "s", "d", None), (9, "constraint", "s", "k", None), (8, "table", "s", "self", None), (9, "table", "s", "gone", None), (9, "role", None, "ext", None), (3, "table", "s", "x9", None)])
    have = have.unionByName(refs(spark, [(9, "table", "s", "x9", None)]))
    external = spark.createDataFrame([("role", None, "ext", None)], "kind string, schema string, name string, signature string")
    got, diagnostics = statements.provider_graph(need, have, external)
    assert {(r["src"], r["dst"], r["reason"]) for r in got.collect()} == {(9, 3, "requires"), (1, 9, "requires_compatible"), (6, 9, "requires_constraint_key"), (7, 9, "requires_constraint_key"), (2, 9, "requires_compatible")}
    assert sorted((r["code"], r["key"]) for r in diagnostics.collect()) == [("CYCLE_EDGE_SKIPPED", "function:s:f:(integer)"), ("DUPLICATE_PRODUCER", "table:s:d:"), ("UNRESOLVED_DEPENDENCY", "function:s:f:(bigint)"), ("UNRESOLVED_DEPENDENCY", "table:s:gone:")]


@pytest.mark.parametrize("seed", range(3))
def test_cycles_come_last(spark, seed):
    rng = random.Random(seed)
    links = [(a, b) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.08] + [(7, 3), (3, 7), (15, 12), (12, 15), (4, 4)]
    nodes = spark.createDataFrame([(n, f"{rng.random():.6f}") for n in range(20)], "node int, key string")
    edges_ = spark.createDataFrame(links, "src int, dst int")
    after = {n: {b for a, b in links if a == n and b != n} for n in range(20)}

    def reached(n):
        seen, todo = set(), list(after[n])
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += after[m]
        return seen

    reach = {n: reached(n) for n in range(20)}
    cyclic = {n for n in range(20) if n in reach[n]}
    late = cyclic | {m for n in cyclic for m in reach[n]}
    for most in (10**6, 0):
        rows = statements.sorted_statements(nodes, edges_, most).orderBy("position").collect()
        order = [r["node"] for r in rows]
        assert sorted(order) == list(range(20)) and set(order[: 20 - len(late)]).isdisjoint(late)
        at = {n: i for i, n in enumerate(order)}
        assert all(at[a] < at[b] for a, b in links if a != b and a not in reach[b])
        assert {r["node"] for r in rows if r["cycle"] is not None} == cyclic


@pytest.mark.parametrize("most", [10**6, 0])
def test_strong_components(spark, most):
    rng = random.Random(9)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(i, i + 1) for i in range(100, 108)] + [(i + 1, i) for i in range(200, 208)]
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reached(n):
        seen, todo = {n}, [n]
        while todo:
            for m in after[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    reach = {n: reached(n) for n in after}
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in after}
    df = spark.createDataFrame(links, "src long, dst long")
    assert {r["id"]: r["component"] for r in graph.strong_components(df, most).collect()} == want
    pairs = [(a, b) for a in list(after)[:8] for b in list(after)[:8]]
    got = graph.paths(spark.createDataFrame(pairs, "src long, dst long"), df)
    assert {(r["src"], r["dst"]): r["reached"] for r in got.collect()} == {(a, b): b in reach[a] for a, b in pairs}


def test_references_of_statements(spark):
    rows = [
        ('CREATE TABLE App."My T" (id int REFERENCES other.P, x text DEFAULT \'references no.pe\') INHERITS (base)', {("provides", "table:app:My T:"), ("requires", "table:other:p:"), ("requires", "table:public:base:"), ("requires", "schema::app:")}),
        ("create or replace function s.f(a integer, VARIADIC b text[] DEFAULT '{}', out c double precision) returns int as $$ select 1 from no.pe $$", {("provides", "function:s:f:(integer,variadic text[],double precision)"), ("requires", "schema::s:")}),
        ("CREATE TRIGGER tr AFTER INSERT ON s.t EXECUTE FUNCTION s.g()", {("provides", "trigger:public:tr:"), ("requires", "table:s:t:"), ("requires", "function:s:g:")}),
        ("ALTER TABLE ONLY s.t OWNER TO boss", {("requires", "table:s:t:"), ("requires", "role::boss:")}), ("CREATE MATERIALIZED VIEW IF NOT EXISTS m AS SELECT * FROM a JOIN s.b ON true", {("provides", "materialized_view:public:m:"), ("requires", "table:public:a:"), ("requires", "table:s:b:")}),
        ("nonsense", set()),
    ]
    df = spark.createDataFrame([("f", i, t) for i, (t, _) in enumerate(rows)], "file string, place int, statement string")
    got = {}
    for r in statements.references(df).collect():
        got.setdefault(r["place"], set()).add((r["role"], r["key"]))
    for i, (_, want) in enumerate(rows):
        assert got.get(i, set()) == want, i


def test_snapshots_and_files_round_trip(spark, tmp_path):
    f, e = facts(spark, SOURCE), edges(spark, LINKS)
    for kind in ("parquet", "json"):
        root = snapshots.write(f, e, f"{tmp_path}/{kind}", kind)
        back = snapshots.read(spark, f"{tmp_path}/{kind}")
        assert back.root == root and diff.fact_deltas(f, back.facts).count() == 0 and diff.edge_deltas(e, back.edges).count() == 0
        assert diff.unequal(graph.rollups(f, e), back.rolled).count() == 0
    (tmp_path / "json" / "edges" / "part-odd.json").write_text('{"from_id":"a","to_id":"role:r","edge_kind":"owner"}\n{"from_id":"view:s.v","to_id":"b","edge_kind":"owner"}\n')
    with pytest.raises(ValueError, match="has root"):
        snapshots.read(spark, f"{tmp_path}/json")
    (tmp_path / "sql" / "deep").mkdir(parents=True)
    (tmp_path / "sql" / "b.sql").write_text("select 1;\nselect 2;")
    (tmp_path / "sql" / "deep" / "a.sql").write_text("create schema s;")
    (tmp_path / "sql" / "c.txt").write_text("no")
    found = snapshots.discover(spark, f"{tmp_path}/sql")
    assert ids(found, "file") == ["b.sql", "deep/a.sql"]
    assert sorted((r["file"], r["statement"]) for r in statements.split_statements(found).collect()) == [("b.sql", "select 1"), ("b.sql", "select 2"), ("deep/a.sql", "create schema s")]
    _, placed, *_ = planned(spark, changed(view_s_v={"def": '"9"'}))
    snapshots.write_plan(placed, f"{tmp_path}/plan")
    assert spark.read.json(f"{tmp_path}/plan").count() == placed.count()
    snapshots.write_scripts(placed.select(export.route(F.col("subject")).alias("file"), "text"), f"{tmp_path}/scripts")
    assert len(list((tmp_path / "scripts").glob("name=*"))) == 2


def test_routes_and_cycles_of_files(spark):
    df = spark.createDataFrame([("column:s.T.a",), ("comment:(view:s.v)",), ("role:r",), ('table:s."Odd Name"',)], "i string")
    assert [r[0] for r in df.select(export.route(F.col("i"))).collect()] == ["schemas/s/tables/a.sql", "schemas/s/views/v.sql", "cluster/roles/r.sql", "schemas/s/tables/odd_name.sql"]
    files = spark.createDataFrame([("t1", "a.sql", False), ("fk1", "a.sql", True), ("t2", "b.sql", False), ("fk2", "b.sql", True), ("t3", "c.sql", True)], "action string, file string, late boolean")
    links = spark.createDataFrame([("t2", "fk1"), ("t1", "fk2"), ("t1", "t3")], "src string, dst string")
    got = {r["action"]: r["file"] for r in export.split_cycles(files, links, F.col("late")).collect()}
    assert got == {"t1": "a.sql", "t2": "b.sql", "fk1": "a_fk.sql", "fk2": "b_fk.sql", "t3": "c.sql"}


def test_policies_look_deep(spark):
    loop = policy.Policy("p", (policy.Rule({"all": [{"any": [{"idField": {"odd": "x"}}]}]}, "exclude"),))
    with pytest.raises(ValueError, match="unknown id field odd"):
        policy.validate(loop, ["id"])
    f = policy.featured(facts(spark, SOURCE), edges(spark, [*LINKS, ("table:s.t", "extension:x", "memberOfExtension")]))
    hit = lambda spec: ids(f.where(policy.predicate(spec)))
    assert hit({"ownedByExtension": "x"}) == ["column:s.t.a", "column:s.t.b", "policy:s.t.p", "table:s.t"]
    assert hit({"owner": "r*"}) == ["view:s.w"] and hit({"target": {"kind": "view", "schema": "s", "name": "w"}}) == ["comment:(view:s.w)"]
    assert hit({"edgeTo": {"kind": "depends", "to": {"kind": "column", "schema": "s", "name": "a"}}}) == ["view:s.v"] and hit({"schema": "s", "name": "f"}) == ["function:s.f"]
    part = facts(spark, [("table:s.p", "table:s.t", {"partitionBound": '"x"'}), ("table:s.q", "table:s.t", {}), ("table:s.t", None, {})])
    assert ids(part.where(policy.predicate({"partitionOf": "t*"}))) == ["table:s.p"]
    column = policy.serialized([({"kind": "view"}, {"a": "1"}), ({"name": "*"}, {"a": "2", "b": "3"})], "a")
    assert {r[0]: r[1] for r in f.select("id", column).collect()}["view:s.v"] == "1" and {r[0]: r[1] for r in f.select("id", column).collect()}["table:s.t"] == "2"


def test_proof_states(spark):
    stat = "key string, rows long, signature string, content string, identity string, storage string"
    before = spark.createDataFrame([("a", 1, "s", "x", "1", "f"), ("b", 1, "s", "x", "1", "f"), ("c", 2, "s", "x", "1", "f"), ("d", 1, "s", "x", "1", "f"), ("e", 1, "s", "x", "1", "f"), ("g", 1, "s", "x", "1", "f"), ("h", 1, "s", "x", "1", "f")], stat)
    after = spark.createDataFrame([("b", 1, "s", "x", "2", "f"), ("c", 1, "s", "x", "1", "f"), ("d", 1, "s", "y", "1", "f"), ("e", 1, "t", "y", "1", "f"), ("g2", 1, "s", "x", "1", "h")], stat)
    renames, destroyed = spark.createDataFrame([("g", "g2")], "key string, to string"), spark.createDataFrame([("h",)], "key string")
    got = lambda **k: {r["key"]: r["violation"] for r in proof.violations(before, after, renames, destroyed, **k).collect()}
    assert got() == {"a": "missing", "b": "recreated", "c": "count", "d": "content", "g": "rewritten"}
    assert got(mode="count") == {"a": "missing", "b": "recreated", "c": "count", "g": "rewritten"} and got(mode="none") == {"a": "missing", "b": "recreated", "g": "rewritten"}
    a, b = snapshot(spark, [("x", None, {"k": "1"}, False)]), snapshot(spark, [("x", None, {"k": "2"}, False), ("y", "x", {}, False)])
    deltas = diff.fact_deltas(a, b)
    assert proof.proved(a, b, deltas).first()["verdict"] == "proved" and proof.proved(a, b, deltas.where("verb = 'add'")).first()["verdict"] == "failed"
    assert proof.proved(a, b, deltas, gates={"source": ("1", "2")}).first()["gate"] == "source"


def test_handlers_and_profiles(spark):
    jobs = spark.createDataFrame([("a", "* * *", "x"), ("a", "0 * *", "y"), (None, "", ""), ("b", "1", None)], "jobname string, schedule string, command string")
    profile = extensions.Profile("p", (extensions.cron_jobs(),), assumed_schemas=("auth",))
    f, e, d = profile.capture({"jobs": jobs})
    assert ids(f) == ["extensionIntent:pg_cron.job.a", "extensionIntent:pg_cron.job.b"] and e.count() == 2
    assert sorted(r["code"] for r in d.collect()) == ["intent_collision", "intent_without_key"]
    own = profile.planner_rules()
    df = spark.createDataFrame([("pg_cron", "job"), ("x", "y")], "e string, i string")
    assert [r[0] for r in df.select(own.intent_weight(F.col("e"), F.col("i"))).collect()] == [90, 90] and own.intents == {("pg_cron", "job"): 90}


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(canonical.clipped(F.lit("aé€x"), 3)) == "aé" and get(canonical.clipped(F.lit("aé€x"), 4)) == "aé" and get(canonical.clipped(F.lit("aé€x"), 6)) == "aé€" and get(canonical.clipped(F.lit("ab"), 9)) == "ab"
    assert len(get(canonical.file_name(F.lit("x" * 100)))) == 60 and get(canonical.file_name(F.lit("x"))) == "x"
    array = lambda *v: F.array(*map(F.lit, v))
    assert get(canonical.same_set(array(1, 2, 2), array(2, 1))) and not get(canonical.same_set(array(1), array(2)))
    assert get(canonical.subsequence(array(1, 3), array(1, 2, 3))) and not get(canonical.subsequence(array(3, 1), array(1, 2, 3)))
    parts = lambda i: get(canonical.id_segments(F.lit(i)))
    assert parts('table:"a.b"."q"""') == ["a.b", 'q"'] and parts("acl:(table:s.t).me") == ["s", "t"] and get(canonical.id_target(F.lit("comment:(acl:(table:s.t).x)"))) == "acl:(table:s.t).x"
    assert get(extraction.redacted_conninfo(F.lit("host=h password='a b' user=u PASSWORD=x"))) == "host=h password=__REDACTED__ user=u PASSWORD=__REDACTED__"
    assert get(extraction.redacted_options(array("user=u", "password=p", "host=h"))) == ["host=h", "password=__REDACTED__", "user=u"]
    df = spark.range(1000).repartition(7)
    assert [r["position"] for r in graph.numbered(df, F.col("id").desc()).orderBy(F.col("id").desc()).collect()] == list(range(1000))


def test_fingerprints_see_every_column(spark):
    rows = spark.createDataFrame([(i, f"x{i}", float(i) / 3) for i in range(50)], "a long, b string, c double")
    content = lambda df: extraction.statistics(df, F.lit("x")).first()["content"]
    assert content(rows) == content(rows.repartition(5)) != content(rows.where("a < 49"))
    assert all(content(rows) != content(rows.withColumn(c, F.when(F.col("a") == 7, v).otherwise(F.col(c)))) for c, v in (("b", F.lit("?")), ("c", F.lit(0.5))))


@pytest.mark.parametrize("most", [400_000, 0])
def test_paths_within_components_are_not_walked(spark, monkeypatch, most):
    """Two dense components with an edge between, a tail, a lone loop and an unknown node; what is written stays near the number of nodes."""
    rng = random.Random(7)
    edges_ = {(i, i + 1) for i in range(59)} | {(59, 0)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(400)}
    edges_ |= {(a + 100, b + 100) for a, b in edges_} | {(5, 105), (130, 200), (200, 201), (300, 300)}
    pairs = [(a, b) for a in (0, 30, 59, 100, 159, 200, 201, 300, 999) for b in (0, 59, 100, 159, 200, 201, 300, 999)] + [(i, (i - 1) % 60) for i in range(60)]
    after = {}
    for a, b in edges_:
        after.setdefault(a, set()).add(b)

    def reached(a, b):
        seen, todo = {a}, [a]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return b in seen

    plain, components, written = graph.cut, graph.strong_components, []
    monkeypatch.setattr(graph, "strong_components", lambda e: components(e, most))
    if most:
        monkeypatch.setattr(graph, "cut", lambda df: written.append(plain(df)) or written[-1])
    got = {(r["src"], r["dst"]): r["reached"] for r in graph.paths(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(sorted(edges_), "src long, dst long")).collect()}
    assert got == {(a, b): reached(a, b) for a, b in pairs}
    assert sum(df.count() for df in written) < 2 * len(edges_) + 5 * len(set(pairs))


def test_edges_are_written_reason_by_reason(spark):
    """Each edge once, though two ids or two links give it; links of untouched facts are left out; levels are walked over numbers."""
    touches = spark.createDataFrame([("p", "produces", "x"), ("p", "produces", "y"), ("c", "consumes", "x"), ("c", "consumes", "y"), ("q", "produces", "z")], "action string, role string, id string")
    links = spark.createDataFrame([("z", "x"), ("z", "y"), ("z", "away"), ("away", "x")], "from_id string, to_id string")
    found = actions.action_edges(touches, links)
    assert sorted(map(tuple, found.collect())) == [("p", "c", "produce"), ("p", "q", "build")]
    assert all("/cut-" in f for f in found.inputFiles())
    own = spark.createDataFrame([("c", "1"), ("p", "3"), ("q", "2"), ("alone", "9")], "idx string, key string")
    placed = {r["idx"]: r["position"] for r in actions.ordered(own, found, most=0).collect()}
    assert placed == {"p": 0, "alone": 1, "c": 2, "q": 3}


#: Plan queries, and their findings of round 3: the driver gathered up to eight pieces of ids at once.
OVER_MEMORY = {
    "action_touches": 1, "destruction_check": 2, "missing_requirement": 3, "plan_identity": 4, "plan_order_check": 5, "create_invariant": 6, "plan_folds": 7,
    "plan_levels": 8, "plan_preamble": 9, "data_losses": 10, "emit_actions": 11, "plan_graph": 12, "plan_order": 13,
}


@pytest.fixture(scope="module")
def fresh(tmp_path_factory):
    """The smallest tables, of which nothing is stored yet: the queries share one plan."""
    import shutil

    return shutil.copytree("/root/testdata/sf0.001", tmp_path_factory.mktemp("fresh") / "t").as_posix()


@pytest.mark.parametrize("name", sorted(OVER_MEMORY, key=OVER_MEMORY.get))
def test_plans_broadcast_no_more_ids_than_the_bound(spark, fresh, monkeypatch, name):
    """With ids beyond the bound a fresh plan gives the same rows, and no table of more rows than that goes by the driver."""
    from factloom import storage
    from factloom.catalogue import QUERIES

    rows = lambda d: sorted((tuple(map(str, r)) for r in QUERIES[name](spark, d).collect()))
    want = rows("/root/testdata/sf0.001")
    sent, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda x: sent.append(x.count()) or plain(x))
    for n, most in (("AMONG_ROWS", 50), ("BROADCAST_ROWS", 50), ("BITS", 1 << 14)):
        monkeypatch.setattr(storage, n, most, raising=False)
    assert rows(fresh) == want and max(sent, default=0) <= 50
