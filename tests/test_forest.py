"""The forest's queries without SQL against brute force."""

import duckdb
import pytest

from factloom.catalogue import QUERIES
from factloom.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    """Facts of both sides, by id."""
    return [{r["id"]: r for r in tables.facts(spark, FOLDER, s).collect()} for s in "ab"]


def pairs(spark, name):
    return {(r["from_id"], r["to_id"]) for r in QUERIES[name](spark, FOLDER).collect()}


def test_renames_are_of_equal_structure(spark, sides):
    a, b = sides
    below = []
    for own in sides:
        children = {}
        for r in own.values():
            children.setdefault(r["parent_id"], []).append(r["id"])

        def shape(i, own=own, children=children):
            return own[i]["hash"], tuple(sorted(shape(c, own, children) for c in children.get(i, [])))

        below.append(shape)
    top = lambda own, other: [i for i in own if i not in other and (own[i]["parent_id"] is None or own[i]["parent_id"] in other)]
    alike = [(i, j) for i in top(a, b) for j in top(b, a) if all(a[i][c] == b[j][c] for c in ("kind", "parent_id", "hash"))]
    same = {(i, j) for i, j in alike if below[0](i) == below[1](j)}
    near = {(i, j) for i, j in alike if (i, j) not in same and i not in {x for x, _ in same}}
    assert same and pairs(spark, "rename_candidates") == same
    assert near and pairs(spark, "rename_near_miss") == near


def test_equal_subtrees_are_skipped(spark, sides):
    """What differs, and all above it, is visited; what lies in equal subtrees isn't."""
    a, b = sides
    edges = [{}, {}]
    for n, s in enumerate("ab"):
        for r in tables.edges(spark, FOLDER, s).collect():
            edges[n].setdefault(r["from_id"], set()).add((r["edge_kind"], r["to_id"]))
    visited = {i for i in a.keys() | b.keys() if i not in a or i not in b or a[i]["hash"] != b[i]["hash"] or edges[0].get(i) != edges[1].get(i)}
    todo = list(visited) + [i for i in a.keys() & b.keys() if a[i]["parent_id"] != b[i]["parent_id"]]
    while todo:
        i = todo.pop()
        for own in sides:
            p = own[i]["parent_id"] if i in own else None
            if p is not None and p not in visited:
                visited.add(p)
                todo.append(p)
    want = {}
    for i in a.keys() | b.keys():
        kind = i.split(":")[0]
        n = want.setdefault(kind, [0, 0])
        n[i not in visited] += 1
    assert {r["kind"]: [r["visited"], r["skipped"]] for r in QUERIES["diff_pruned"](spark, FOLDER).collect()} == want


def test_components_and_paths_of_users(spark):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{FOLDER}/events.parquet'")
    rows = c.sql("SELECT user_id, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events").fetchall()
    after = {}
    for a, b in rows:
        if b is not None:
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
    assert {r["id"]: r["component"] for r in QUERIES["scc"](spark, FOLDER).collect()} == {n: min(m for m in reach[n] if n in reach[m]) for n in after}
    assert {(r["src"], r["dst"]): r["reached"] for r in QUERIES["path_tests"](spark, FOLDER).collect()} == {(n, n + 1): n + 1 in reach[n] for n in after}


def test_snapshots_are_stored_lean(spark, tmp_path, monkeypatch):
    """Roll-ups of leaves are given, not written; wide joins in slices give the same; no shuffle files stay."""
    from factloom import storage
    from factloom.operators import diff, graph

    a, b = (tables.facts(spark, FOLDER, s) for s in "ab")
    found = [{tuple(r) for r in graph.rollups(tables.facts(spark, FOLDER, s), tables.edges(spark, FOLDER, s)).collect()} for s in "ab"]
    rolled = [tables.rolled(spark, FOLDER, s) for s in "ab"]
    assert [{tuple(r) for r in x.select("id", "parent_id", "depth", "rollup", "structural").collect()} for x in rolled] == found
    assert all("line" not in {r["k"] for r in spark.read.parquet(f).selectExpr("split_part(id, ':', 1) as k").distinct().collect()} for f in {f.rpartition("/")[0] for f in rolled[0].inputFiles()} if "/cut-" in f)
    whole = [sorted(map(tuple, x.collect()), key=repr) for x in (diff.unequal(*rolled), diff.fact_deltas(a, b))]
    monkeypatch.setattr(graph, "SLICE_ROWS", 1000)
    assert [sorted(map(tuple, x.collect()), key=repr) for x in (diff.unequal(*rolled), diff.fact_deltas(a, b))] == whole
    # A leaf whose parent no root reaches has no roll-up.
    rows = spark.createDataFrame([("r", None, "h1"), ("p", "r", "h2"), ("q", "lost", "h3")], "id string, parent_id string, hash string")
    leaves = spark.createDataFrame([("x", "p", "h4", None), ("y", "q", "h5", None)], "id string, parent_id string, hash string, e string")
    none = tables.edges(spark, FOLDER, "a").limit(0)
    want = {tuple(r) for r in graph.rollups(rows.unionByName(leaves.drop("e")), none).collect()}
    assert {tuple(r) for r in graph.rollups(rows, none, leaves).collect()} == want and {r[0] for r in want} == {"r", "p", "x"}

    removed = []
    monkeypatch.setattr(spark.conf.__class__, "set", lambda self, k, v, plain=spark.conf.__class__.set: removed.append((k, v)) or plain(self, k, v))
    storage.materialize(spark.range(1000).repartition(3, "id"), lean=True)
    assert removed == [(storage.CLEANUP, "true"), (storage.CLEANUP, "false")]


def test_plan_is_written_once(spark):
    from factloom.queries import planning

    for df in planning._plan(spark, FOLDER):
        assert df.count() and all("/cut-" in f for f in df.inputFiles())


def test_lines_are_stored_once_and_hashed_directly(spark):
    """Facts are not written; their hash is that of their payload, and odd strings are escaped as before."""
    from pyspark.sql import functions as F

    from factloom.functions import canonical

    for side in "ab":
        own = tables.facts(spark, FOLDER, side)
        assert not [f for f in own.inputFiles() if "/facts-" in f] and {f.rpartition("/")[0] for f in own.inputFiles() if "/lines-" in f}
        assert own.where(F.col("hash") != canonical.content_hash(F.col("payload"))).count() == 0
    odd = spark.createDataFrame([(x,) for x in ("", "a b", 'q"', "b\\", "n\n", "é", "\x7f", "\t", "[x]", None)], "t string")
    plain = F.regexp_replace(F.to_json(F.array("t")), r"^\[|\]$", "")
    assert odd.where(~canonical.canonical_text(F.col("t")).eqNullSafe(plain)).count() == 0


def test_ids_are_found_in_pieces(spark):
    from factloom import storage

    df, ids = spark.range(100), spark.range(0, 200, 7)
    want = set(range(0, 100, 7))
    for bound in (1, 10, 1000):
        assert {r["id"] for r in storage.among(df, ids, bound=bound).collect()} == want
        assert {r["id"] for r in storage.without(df, ids, bound=bound).collect()} == set(range(100)) - want


def test_of_very_many_ids_only_a_bitmap_is_broadcast(spark, monkeypatch):
    """Null and repeated keys, and a bitmap so full that it lets all pass, change nothing; its rows are few however many ids there are."""
    from pyspark.sql import functions as F

    from factloom import storage

    df = spark.range(1000).select(F.when(F.col("id") % 10 < 9, F.concat(F.lit("k"), F.col("id") % 300)).alias("id"), F.col("id").alias("_to"))
    ids = spark.range(0, 2000, 7).select(F.concat(F.lit("k"), "id").alias("id"))
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    want = [rows(df.join(ids, "id", how)) for how in ("left_semi", "left_anti")]
    sent, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda x: sent.append(x.count()) or plain(x))
    for bits in (1 << 26, 1 << 13, 64):
        monkeypatch.setattr(storage, "BITS", bits)
        sent.clear()
        assert [rows(f(df, ids, bound=40)) for f in (storage.among, storage.without)] == want
        assert max(sent) <= min(286, max(1, bits // 4096))


def test_scratch_of_a_kept_table_goes(spark):
    from factloom import storage
    from factloom.operators.graph import cut

    inner, outer = [], []

    def build():
        inner.append(cut(spark.range(5)))
        outer.append(storage.kept(lambda: spark.range(3)))
        return inner[0].join(outer[0], "id")

    out = storage.kept(build)
    assert out.count() == 3 and outer[0].count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(inner[0].inputFiles()[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_differing_facts_on_a_parent_cycle_are_not_compared(spark):
    """Only what a root reaches within the common part is compared, by either side's parents."""
    from factloom.operators import diff

    rows = lambda *x: spark.createDataFrame([(i, p, {"k": v}, f"{v}", False) for i, p, v in x], "id string, parent_id string, payload map<string,string>, hash string, ref_only boolean")
    a = rows(("r", None, "1"), ("x", "r", "1"), ("y", "z", "1"), ("z", "y", "1"), ("m", "x", "1"), ("o", "gone", "1"))
    b = rows(("r", None, "1"), ("x", "r", "2"), ("y", "z", "2"), ("z", "y", "2"), ("m", "y", "2"), ("o", "gone", "2"))
    assert {r["id"] for r in diff.fact_deltas(a, b).where("verb = 'set'").collect()} == {"x", "m"}


def test_queries_write_only_the_parts_they_read(spark, tmp_path):
    """Losses, invariants and preambles need no texts; a plan's parts are written once."""
    import shutil

    from factloom.queries import planning

    folder = shutil.copytree(FOLDER, tmp_path / "t").as_posix()
    made = planning._emission(spark, folder)
    parts = lambda: {k for k in vars(made) if k in ("again", "created", "described", "dropped", "folded", "changed", "owned")}
    assert QUERIES["data_losses"](spark, folder).count() and parts() == {"dropped"}
    assert QUERIES["create_invariant"](spark, folder).count() == 0 and parts() == {"dropped", "again", "created"}
    QUERIES["missing_requirement"](spark, folder).collect()
    QUERIES["destruction_check"](spark, folder).collect()
    QUERIES["plan_preamble"](spark, folder).collect()
    assert "described" not in parts() and planning._emission(spark, folder) is made


def test_target_writes_no_payloads(spark):
    """Only ids and deltas are written on the way to a target."""
    own = QUERIES["project_target"](spark, FOLDER)
    seen = {c for f in {f.rpartition("/")[0] for f in own.inputFiles() if "/cut-" in f} for c in spark.read.parquet(f).columns}
    assert "s" in seen and "payload" not in seen
