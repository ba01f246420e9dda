"""Operators of behaviour, reachability, coordination, links, likeness, packs and stores on small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import behaviour, code, coordination, crosslinks, graph, ordered, packs, reachability
from stratagraph.sources import stores
from stratagraph.streaming import telemetry as tel


def test_behaviour_changes(spark):
    schema = "name string, guards array<string>, entities array<string>"
    before = spark.createDataFrame([("kept", ["a"], ["x"]), ("lost", ["a", "b"], []), ("gone", [], []), ("moved", ["a"], ["x"])], schema)
    after = spark.createDataFrame([("kept", ["a"], ["x"]), ("lost", [], []), ("open", [], ["y"]), ("moved", ["b"], ["y"])], schema)
    got = {r.name: (r.change, list(r.what)) for r in behaviour.flow_changes(before, after, ["name"]).collect()}
    assert got == {"lost": ("changed", ["lost guard"]), "gone": ("removed", []), "open": ("added", ["new unguarded"]), "moved": ("changed", ["gained guard b", "new entity y", "removed entity x", "removed guard a"])}
    assert behaviour.flow_changes(before.limit(0), after.limit(0), ["name"]).count() == 0


def test_journeys_begin_where_no_other_leads(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "d")], "source string, target string")
    starts = spark.createDataFrame([("a",), ("b",), ("x",), ("lone",)], "id string")
    got = {}
    for r in behaviour.journeys(links, starts).collect():
        got.setdefault(r.start, {})[r.id] = r.depth
    assert got == {"a": {"a": 0, "b": 1, "c": 2, "d": 3}, "x": {"x": 0, "c": 1, "d": 2}, "lone": {"lone": 0}}


def test_names_are_resolved_by_the_nearest_scope(spark):
    units = spark.createDataFrame([("1", "p", "f", "a"), ("2", "p", "g", "a"), ("3", "p", "g", "b"), ("4", "q", "h", "c"), ("5", "q", "h", "d"), ("6", "q", "h", "d")], "id string, project_id string, file string, name string")
    refs = spark.createDataFrame([("r1", "p", "f", "a"), ("r2", "p", "f", "b"), ("r3", "p", "f", "c"), ("r4", "q", "h", "d"), ("r5", "p", None, "a")], "ref string, project_id string, file string, name string")
    assert {r.ref: (r.id, r.via) for r in behaviour.resolved(refs, units).collect()} == {"r1": ("1", "file"), "r2": ("3", "project"), "r3": ("4", "name"), "r4": (None, None), "r5": (None, None)}


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_equals_a_model(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)})
    pairs = [p for p in pairs if p[0] != p[1]]
    reach = {}
    for x in {y for p in pairs for y in p}:
        seen, todo = {x}, [x]
        while todo:
            here = todo.pop()
            for a, b in pairs:
                if a == here and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[x] = seen
    df = spark.createDataFrame(pairs, "source string, target string")
    asked = [(f"n{i}", f"n{j}") for i in range(14) for j in range(0, 14, 5)] + [("?", "?"), ("?", "n1")]
    got = {(r.source, r.target): r.reaches for r in reachability.can_reach(df, spark.createDataFrame(asked, "source string, target string")).collect()}
    assert got == {(a, b): a == b or b in reach.get(a, ()) for a, b in asked}
    many = [(x,) for x in sorted(reach)] + [(f"lone{i}",) for i in range(130)] + [(None,)]
    assert {r.seed: r.reached for r in graph.reach_counts(df, spark.createDataFrame(many, "id string")).collect()} == {x: len(reach.get(x, {x})) for (x,) in many if x}
    assert graph.reach_counts(df, spark.createDataFrame([], "id string")).count() == 0
    seeds = spark.createDataFrame([(pairs[0][1],)], "id string")
    assert {r.id for r in reachability.affected_components(df, seeds).collect()} == {x for x in reach if pairs[0][1] in reach[x]} - {pairs[0][1]}
    walk = reachability.bounded_walk(df, spark.createDataFrame([(pairs[0][0],)], "id string"), 9, 2).collect()
    assert len(walk) == min(2, len(reach[pairs[0][0]])) and {r.truncated for r in walk} == {len(reach[pairs[0][0]]) > 2}


WORK = [
    ("w", "a1", 1, "src/x.py", "+++ b/src/x.py\n+def load(a):\n-def load():\n+  go(1)"), ("w", "a2", 2, "./src/x.py", "+def save(b):\n+  load(2)"), ("w", "a3", 3, "src/z.py", "+def save(c):"),
    ("w", None, 4, "src/z.py", "+def lost():"), ("w", "a4", 5, None, None), ("v", "a1", 6, "src/x.py", ""), ("w", "a4", 7, "src/only.py", "-class Old:"),
]


def test_agents_meet(spark):
    work = spark.createDataFrame(WORK, "workspace_id string, agent_id string, seq long, path string, patch string")
    changes = coordination.symbol_changes(work)
    assert {(r.agent_id, r.symbol, r.change) for r in changes.collect()} == {("a1", "load", "changed"), ("a2", "save", "added"), ("a3", "save", "added"), ("a4", "Old", "removed")}
    verdicts = {(r.workspace_id, r.agent_id): (r.verdict, r.kind, r.partner) for r in coordination.arbitration(work).collect()}
    assert verdicts == {("w", "a1"): ("conflict", "path", "a2"), ("w", "a2"): ("conflict", "path", "a1"), ("w", "a3"): ("conflict", "symbol", "a2"), ("w", "a4"): ("granted", None, None), ("v", "a1"): ("granted", None, None)}
    assert {(r.symbol, r.plan) for r in coordination.merge_plan(changes).collect()} == {("load", "automatic"), ("save", "ordered"), ("Old", "automatic")}
    conflicts = {(r.symbol, r.kind) for r in coordination.conceptual_conflicts(changes, coordination.added_calls(work)).collect()}
    assert conflicts == {("save", "duplicate-work"), ("load", "contract-divergence")}
    assert {(r.agent_id, r.path, r.later) for r in coordination.drained(work).where("later > 0").collect()} == {("a1", "src/x.py", 1), ("a3", "src/z.py", 1)}
    paths = spark.createDataFrame([("a/.env",), ("k/id_rsa",), ("a/b.pem",), ("a/env.py",), (None,), ("node_modules/a/b.js",)], "path string")
    assert {r.path for r in coordination.shown_files(paths).collect()} == {"a/env.py", None}
    log = spark.createDataFrame([(i,) for i in range(10, 15)], "seq long")
    assert {r.seq for r in coordination.changes_since(log, "e", 12, "e").collect()} == {13, 14}
    assert [r.gap for r in coordination.changes_since(log, "e", 4, "e").collect()] == [True] * 5 == [r.gap for r in coordination.changes_since(log, "e", 12, "f").collect()]


def test_links_through_hubs(spark):
    holds = spark.createDataFrame([("p", "x"), ("q", "x"), ("r", "x"), ("q", "y"), ("p", None), (None, "x")], "repo string, contract string")
    shared = crosslinks.shared(holds, "db", 0.8)
    assert {(r.source_repo, r.target_repo) for r in shared.collect()} == {("p", "q"), ("p", "r")}
    used = crosslinks.used(spark.createDataFrame([("p", "y"), ("q", "y"), ("p", "x")], "repo string, contract string"), holds, "api", 0.95)
    assert [(r.source_repo, r.target_repo, r.contract) for r in used.collect()] == [("p", "q", "y")]
    schemas = spark.createDataFrame([("p", "s", True), ("q", "s", True), ("r", "s", False), ("z", "s", True)], "repo string, contract string, exact boolean")
    more = crosslinks.schemas_under_contract(schemas, shared)
    assert {(r.target_repo, r.confidence) for r in more.collect()} == {("q", 0.93), ("r", 0.81)}
    assert {r.certainty for r in crosslinks.united(used, shared, more).collect()} == {"confirmed", "likely"}


def test_shapes_of_code(spark):
    assert code.shape_tokens("a+1") == code.shape_tokens("b + 2") == ["$id", "+", "$n"]
    assert [code.fnv1a(x) for x in ("", "a", "foobar")] == [2166136261, 0xE40C292C, 0xBF9CF968]
    shingles = code.shape_shingles("def f(x): return x + 1")
    assert code.signature(shingles).tolist() == [min(code.fnv1a(s, j) for s in shingles) for j in range(64)]
    body = "def f(a, b):\n  c = a + b\n  for x in c: d(x)\n  if c > 1: return c\n  return a\n"
    units = [(1, body), (2, body.replace("a", "q").replace("c", "z")), (3, body + "  e = 1\n"), (4, "import os; os.system('x')"), (5, None), (6, "")]
    got = {r.id: r for r in code.clones(spark.createDataFrame(units, "id long, raw string"), "id", "raw").collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].class_id == got[2].class_id == got[3].class_id != got[4].class_id and (got[1].links, got[4].links) == (1, 0)
    docs = spark.createDataFrame([(1, "ledger entry writer"), (2, "parcel sorter"), (3, None)], "id long, text string")
    lexical = spark.createDataFrame([(2, 0)], "id long, rank int")
    found = [(r.id, r.score) for r in code.semantic_search(code.embedded(docs, "id", "text", 4096), lexical, "ledger writer", "id", width=4096).collect()]
    assert found == [(1, 1.0), (2, 1.0)] and [r.id for r in code.semantic_search(code.embedded(docs, "id", "text"), lexical, "?", "id").collect()] == [2]


def test_packs(spark):
    files = spark.createDataFrame([(1, "a/b.py", "def f(x)\ndef g()\ndef f(x)"), (2, "c.go", "func x"), (3, "d.py", None)], "id long, path string, content string")
    pack = {"name": "p", "language": "python", "applies_when": {"import": "def "}, "rules": [{"name": "r", "pattern": r"def (\w+)\((\w*)", "emit": [{"kind": "entity", "name": "$1", "detail": "of $2"}]}]}
    rules = packs.applying(packs.rules_of(spark, [pack, {**pack, "name": "q", "applies_when": {"file": ".rb"}}]), files)
    assert {(r.id, r.pack, r.name, r.detail, r.times) for r in packs.facts(files, rules, "id").collect()} == {(1, "p", "f", "of x", 2), (1, "p", "g", "of ", 1)}
    with pytest.raises(ValueError):
        packs.rules_of(spark, [{**pack, "rules": [{"name": "r", "pattern": "x", "emit": [{"kind": "other", "name": "n"}]}]}])
    with pytest.raises(ValueError):
        packs.rules_of(spark, [{"name": "p"}])


def test_stores(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    stores.write_records(df, f"{tmp_path}/r", "id", 3)
    assert {r.v for r in stores.read_records(spark, f"{tmp_path}/r", "id", [3, 97, 500]).collect()} == {"v3", "v97"}
    with pytest.raises(ValueError):
        stores.read_records(spark, f"{tmp_path}/r", "id", list(range(2000)))
    page = stores.bounded(df.withColumn("n", F.length("v")), ["id"], "n", budget=7).collect()
    assert [r.id for r in page] == [0, 1, 2] and all(r.truncated for r in page)
    assert not any(r.truncated for r in stores.bounded(df.withColumn("n", F.length("v")), ["id"], "n").collect())
    index = bytes([0x92, 0x92, 0xA4]) + b"main" + bytes([0xA2]) + b"fn" + bytes([0x92, 0x93, 0xFF, 0xFE, 0xC0, 0x93, 0xA1]) + b"x" + bytes([0xFE, 0xFF])
    assert stores.unpack(index) == [["main", "fn"], [[-1, -2, None], ["x", -2, -1]]]
    assert stores.unpack(bytes([0x81, 0xA1, 0x61, 0x93, 0xC3, 0xCD, 1, 0, 0xD0, 0x80])) == {"a": [True, 256, -128]}
    files = spark.createDataFrame([("a", bytearray(index)), ("b", bytearray(b"\x92")), ("c", None)], "path string, content binary")
    assert {tuple(r)[:5] for r in stores.interned_nodes(files).collect()} == {("a", 0, "main", "fn", None), ("a", 1, "x", "fn", "main"), ("b", None, None, None, None)}


def test_batches_are_pushed_once(spark, tmp_path):
    path, sent = f"{tmp_path}/in", []
    spark.range(6).repartition(3).write.parquet(path)
    for marks in ("a", "b"):
        stream = tel.read_observations(spark, path, files_per_batch=1)
        tel.push(stream, lambda batch, number: sent.append((number, batch.count())), f"{tmp_path}/{marks}", f"{tmp_path}/journal").awaitTermination()
    assert sum(n for _, n in sent) == 6 and len({number for number, _ in sent}) == len(sent)


def test_exact_percentiles_equal_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.lognormvariate(3, 2), float(rng.randrange(5)), -2.5])) for _ in range(3000)] + [("c", None), ("c", float("nan")), ("one", 7.0)]
    got = {r.g: (r.p5, r.p50, r.p99) for r in ordered.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p5": 0.05, "p50": 0.5, "p99": 0.99}).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        values = sorted(v for k, v in rows if k == g)
        want[g] = tuple(values[max(1, -(-round(s * 100) * len(values) // 100)) - 1] for s in (0.05, 0.5, 0.99))
    assert got == want


@pytest.mark.parametrize(
    "declared, name, many",
    [("Order", "Order", False), ("Order[]", "Order", True), ("Promise<Order[]>", "Order", True), ("List<com.x.Order>", "Order", True), ("Order | null", "Order", False), ("&'a mut Order", "Order", False), ("[Order; 4]", "Order", True), ("Map<string, Order>", None, False), ("Optional[Order]", "Order", False), ("A | B", None, False), ("", None, False), (None, None, False), ("?Order", "Order", False)],
)
def test_type_shapes(spark, declared, name, many):
    row = spark.createDataFrame([(declared,)], "t string").select(fx.type_shape(F.col("t")).alias("s")).first().s
    assert (row.name, row.collection) == (name, many)
