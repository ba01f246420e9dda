"""Graph loops against plain-Python models on random graphs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import graph, history, ordered, select

SCHEMA = "source string, target string"


def random_graph(seed, n=40, m=70):
    rng = random.Random(seed)
    return sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def closure(pairs, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_loops_equal_models(spark, seed):
    pairs = random_graph(seed)
    df = spark.createDataFrame(pairs, SCHEMA)
    ids = {x for p in pairs for x in p}
    reach = {x: closure(pairs, [x]) for x in ids}
    strong = {x: min(y for y in ids if y in reach[x] and x in reach[y]) for x in ids}
    assert {r.id: r.component for r in graph.strong_components(df).collect()} == strong
    either = pairs + [(b, a) for a, b in pairs]
    assert {r.id: r.component for r in graph.components(df).collect()} == {x: min(closure(either, [x])) for x in ids}
    sinks = {strong[x] for x in ids if all(strong[y] == strong[x] for y in reach[x])}
    got = {r.id: r.distance for r in graph.terminality(df).collect()}
    assert {x for x, d in got.items() if d == 0} == {x for x in ids if strong[x] in sinks} and set(got) == ids
    seeds = spark.createDataFrame([(pairs[0][0],), ("unknown",)], "id string")
    assert {r.id for r in graph.reach(df, seeds).collect()} == closure(pairs, [pairs[0][0]]) | {"unknown"}
    assert {r.id for r in graph.reach(df, seeds, 0).collect()} == {pairs[0][0], "unknown"}


def test_small_cases(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "c")], SCHEMA)
    assert {(r.id, r.distance) for r in graph.terminality(line).collect()} == {("a", 2), ("b", 1), ("c", 0), ("d", 0)}
    cycle = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1")], SCHEMA)
    walk = {r.id: (r.depth, r.via) for r in graph.reach(graph.turned(cycle), cycle.where("source = '1'").select(F.col("source").alias("id"))).collect()}
    assert walk == {"1": (0, None), "3": (1, "1"), "2": (2, "3")}
    two = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z")], SCHEMA)
    parts = {}
    for r in graph.communities(two).collect():
        parts.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, parts.values())) == [["a", "b", "c"], ["x", "y", "z"]]
    empty = line.limit(0)
    assert graph.strong_components(empty).count() == graph.components(empty).count() == graph.communities(empty).count() == 0
    tree = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", "x")], "id string, parent string")
    assert {tuple(r) for r in graph.ancestors(tree).collect()} == {("c", "b", 1), ("c", "a", 2), ("b", "a", 1), ("x", "y", 1), ("y", "x", 1)}
    assert graph.colour_batches([("a", "b"), ("b", "c")], ["a", "b", "c", "d"]) == {"a": 0, "b": 1, "c": 0, "d": 0}


def test_running_sum_and_percentile(spark):
    rng = random.Random(4)
    values = [rng.choice([0, 0, 0, 1, 2, 2, 5, 9, 9, 40]) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id long, x long")
    got = {r.id: r.percentile for r in select.percentile_below(df, "x").collect()}
    assert got == {i: 100 * sum(y < x for y in values) // len(values) for i, x in enumerate(values)}
    assert ordered.running_sum(df.limit(0), "id", "x", "before", "total").count() == 0


def test_co_change_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(60), f"f{rng.randrange(15)}") for _ in range(300)} | {(99, f"f{i}") for i in range(60)})
    want = {}
    for commit in range(60):
        files = sorted(p for c, p in rows if c == commit)
        for i, a in enumerate(files):
            for b in files[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    got = {(r.a, r.b): r.together for r in history.co_change(spark.createDataFrame(rows, "commit_id long, path string")).collect()}
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_communities_end_in_a_local_optimum(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(300)]
    label = {r.id: r.community for r in graph.communities(spark.createDataFrame(edges, SCHEMA)).collect()}
    near, whole = {}, 2 * len(edges)
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for x, others in near.items():
        gain = lambda c: sum(label[y] == c for y in others) - len(others) * sum(len(near[y]) for y in near if y != x and label[y] == c) / whole  # noqa: B023, E731
        assert max(gain(label[y]) for y in others) <= max(gain(label[x]), 0 if all(label[y] != label[x] for y in others) else -9) + 1e-8


def test_communities_of_a_graph_with_hubs_end_soon(spark, monkeypatch):
    rng = random.Random(8)
    edges = {(f"n{rng.randrange(3000):04d}", f"n{int(3000 * rng.random() ** 4):04d}") for _ in range(12000)}
    edges = [(a, b) for a, b in sorted(edges) if a != b]
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, real=graph.durable, **k: written.append(1) or real(df, **k))
    label = {r.id: r.community for r in graph.communities(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert label == {r.id: r.community for r in graph.communities(spark.createDataFrame(edges[::-1], SCHEMA).repartition(7)).collect()}
    assert len(written) <= 4
    near, degree, sums = {}, Counter(), Counter()
    for a, b in edges + [(b, a) for a, b in edges]:
        near.setdefault(a, Counter())[label[b]] += 1
        degree[a] += 1
    assert set(label) == set(near)
    for x, k in degree.items():
        sums[label[x]] += k
    for x, inside in near.items():
        gain = lambda c: inside[c] - degree[x] * (sums[c] - (degree[x] if c == label[x] else 0)) / (2 * len(edges))  # noqa: B023, E731
        assert max(map(gain, inside)) <= (gain(label[x]) if label[x] in inside else 0) + 1e-8


def test_communities_of_large_graphs_move_in_rounds(spark):
    two = [(f"{s}{a}", f"{s}{b}") for s in "xy" for a in range(5) for b in range(a)] + [("x0", "y0")]
    df = spark.createDataFrame(two, SCHEMA)
    parts = lambda got: {frozenset(r.id for r in got if r.community == c) for c in {r.community for r in got}}
    assert parts(graph.communities(df, alone=0).collect()) == parts(graph.communities(df).collect()) == {frozenset(f"{s}{a}" for a in range(5)) for s in "xy"}


def test_ancestors_of_any_depth(spark):
    chain = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(150)] + [("150", "149")], "id string, parent string")
    got = {(r.id, r.ancestor): r.distance for r in graph.ancestors(chain).collect()}
    assert got["0", "150"] == 150 and got["150", "149"] == 1 and len(got) == 150 * 151 // 2 + 1
