"""Properties and traps of the operators."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_map, canonical_number, content_hash, entity_id, satellite_id
from factloom.operators import diff, graph, policy
from factloom.operators.statements import annotations, split_statements, statements
from factloom.plans import actions, rules

SCHEMA = "id string, parent_id string, payload map<string,string>, ref_only boolean"


def snapshot(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("hash", content_hash(F.col("payload")))


def forest(rng, names):
    rows, known = [], []
    for n in names:
        parent = rng.choice(known) if known and int(n) % 3 else None
        rows.append((n, parent, {"a": str(rng.randint(0, 2)), **({"b": "1"} if rng.random() < 0.5 else {})}, False))
        known.append(n)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_deltas_round_trip_and_swap(spark, seed):
    rng = random.Random(seed)
    rows = forest(rng, [str(i) for i in range(25)])
    parents = {r[0]: r[1] for r in rows}
    keep = lambda gone: [r for r in rows if not any(x in gone for x in chain(r[0]))]

    def chain(x):
        while x is not None:
            yield x
            x = parents[x]

    a = keep({"3", "7"})
    b = [(i, p, m | ({"a": "9"} if int(i) % 4 == 0 else {}), r) for i, p, m, r in keep({"5", "11"})]
    left, right = snapshot(spark, a), snapshot(spark, b)
    deltas = diff.fact_deltas(left, right)
    after = {r["id"]: r["payload"] for r in diff.apply_deltas(left, deltas, right).collect()}
    assert after == {r[0]: r[2] for r in b}
    assert diff.fact_deltas(left, left).count() == 0
    verbs = lambda df, v: {r["id"] for r in df.where(F.col("verb") == v).collect()}
    back = diff.fact_deltas(right, left)
    assert verbs(deltas, "add") == verbs(back, "remove") and verbs(deltas, "remove") == verbs(back, "add")


def test_absent_is_not_null_and_reference_only_is_silent(spark):
    a = snapshot(spark, [("x", None, {"k": None}, False), ("y", None, {"k": "1"}, True)])
    b = snapshot(spark, [("x", None, {}, False), ("y", None, {"k": "2"}, False)])
    assert [tuple(r) for r in diff.fact_deltas(a, b).collect()] == [("set", "x", "k", "null", None)]


def test_reparented_fact_is_removed_and_added(spark):
    a = snapshot(spark, [("p", None, {}, False), ("x", "p", {}, False), ("q", None, {}, False)])
    b = snapshot(spark, [("q", None, {}, False), ("x", "q", {}, False)])
    got = {(r["verb"], r["id"]) for r in diff.fact_deltas(a, b).collect()}
    assert got == {("remove", "p"), ("remove", "x")}


def test_canonical_forms(spark):
    df = spark.range(1).select(
        canonical_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit('"x"'), F.lit("_m"), F.lit("2"))).alias("m"), canonical_number(F.lit(-0.0)).alias("z"),
        entity_id("table", F.lit("a.b"), F.lit('q"')).alias("i"), satellite_id("acl", F.lit("table:a.b"), F.lit("me")).alias("s"),
    )
    assert tuple(df.first()) == ('{"a":"x","b":1}', "0", 'table:"a.b"."q"""', "acl:(table:a.b).me")


def test_rollup_ignores_row_order_and_partitions(spark):
    rows = forest(random.Random(1), [str(i) for i in range(40)])
    edges = spark.createDataFrame([("1", "2", "depends"), ("1", "9", "owner")], "from_id string, to_id string, edge_kind string")
    one = graph.root_hash(graph.rollups(snapshot(spark, rows).coalesce(1), edges)).first()[0]
    two = graph.root_hash(graph.rollups(snapshot(spark, rows[::-1]).repartition(8), edges.repartition(2))).first()[0]
    assert one == two


def test_closures_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r[0] for r in graph.reach(start, e).collect()} == {"a", "b", "c", "d"}
    assert {r["id"]: r["component"] for r in graph.strong_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_exact_order_respects_edges_and_reports_cycles():
    rng = random.Random(3)
    edges = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.1]
    order = graph.kahn([(n, f"{rng.random():.6f}") for n in range(30)], [*edges, (4, 4)])
    assert all(order.index(a) < order.index(b) for a, b in edges)
    with pytest.raises(ValueError, match="cycle"):
        graph.kahn([(0, "a"), (1, "b")], [(0, 1), (1, 0)])


def test_graph_edges_and_missing(spark):
    rows = [(0, ["t"], [], [], []), (1, [], ["t", "u"], [], []), (2, [], [], ["u"], []), (3, [], [], [], ["u"])]
    a = spark.createDataFrame(rows, "idx int, produces array<string>, consumes array<string>, destroys array<string>, releases array<string>")
    assert {tuple(r) for r in actions.graph_edges(a).collect()} == {(0, 1, "produce"), (1, 2, "consume"), (3, 2, "release")}
    assert [tuple(r) for r in actions.missing_requirements(a, spark.createDataFrame([], "id string")).collect()] == [(1, "u")]


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([("k", None), ("k", "a.b")], "kind string, name string")
    assert df.where(policy.predicate({"not": {"name": "a*"}})).count() == 1
    assert df.where(policy.predicate({"name": "a.*"})).count() == 1
    with pytest.raises(ValueError, match="cycle"):
        loop = policy.Policy("p", (), (policy.Policy("q", (), (policy.Policy("p"),)),))
        loop.flat()


def test_statements(spark):
    sql = "-- @phase: late, early\ncreate f as $x$ a; b $x$;\nselect ';' /* ; /* ; */ */ ; -- ;\n;select \"a;b\""
    assert [t for *_, t in statements(sql)] == ["-- @phase: late, early\ncreate f as $x$ a; b $x$", "select ';' /* ; /* ; */ */", "-- ;", 'select "a;b"']
    split = split_statements(spark.createDataFrame([(1, sql), (2, None)], "file int, sql string"))
    assert split.count() == 4
    assert {tuple(r) for r in annotations(split).collect()} == {(1, 0, "phase", "late"), (1, 0, "phase", "early")}


def test_diff_has_no_kinds():
    text = (Path(__file__).parent.parent / "factloom/operators/diff.py").read_text()
    assert not any(f'"{kind}"' in text for kind in rules.WEIGHTS)


def test_both_parts_of_the_statement_graph_can_be_read(spark, tmp_path):
    """What the first part took on the way is there for the second."""
    import shutil

    from factloom.queries import statements

    edges, diagnostics = statements._graph(spark, shutil.copytree("/root/testdata/sf0.001", tmp_path / "t").as_posix())
    assert edges.count() and diagnostics.count() >= 0
