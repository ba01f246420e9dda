"""Problems 2, 4 and 7 against brute force."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratagraph.operators import shredding, skew, snapshots


def brute_steps(payload):
    """Plain recursion over one payload: (step_path, parent_node_id, node_id)."""
    try:
        doc = json.loads(payload)
        doc = json.loads(doc) if isinstance(doc, str) else doc
    except (TypeError, ValueError):
        return set()
    if not isinstance(doc, dict):
        return set()
    entry = doc.get("entry") or {}
    top = entry.get("handler_node_id") or (entry.get("handler") or {}).get("node_id") or ""
    out = set()

    def walk(steps, parent, path):
        if isinstance(steps, str):
            steps = json.loads(steps)
        if isinstance(steps, dict):
            steps = [steps[k] for k in sorted(steps, key=int)] if steps and all(k.isdigit() for k in steps) else [steps]
        for i, step in enumerate(steps or []):
            here = f"{path}.{i}" if path else str(i)
            if isinstance(step, dict):
                if step.get("node_id"):
                    out.add((here, parent, step["node_id"]))
                walk(step.get("steps"), step.get("node_id") or "", here)

    walk(doc.get("steps"), top, "")
    return out


def make_steps(rng, depth):
    steps = []
    for _ in range(rng.randrange(4)):
        step = {"name": "x", "node_id": rng.choice([None, f"n{rng.randrange(99)}"])}
        if rng.random() < 0.2:
            del step["node_id"]
        if depth < 4 and rng.random() < 0.6:
            step["steps"] = make_steps(rng, depth + 1)
        steps.append(step)
    shape = rng.randrange(6)
    if shape == 0:
        return {str(i): s for i, s in reversed(list(enumerate(steps)))}
    if shape == 1:
        return json.dumps(steps)
    if shape == 2 and steps:
        return steps[0]
    return None if shape == 3 else steps


def test_steps_equal_plain_recursion(spark):
    rng = random.Random(5)
    rows = [(i, None) for i in (900, 901)] + [(902, ""), (903, "{"), (904, "null"), (905, "[]"), (906, '{"steps": [1, null, "a", {"node_id": "q"}]}')]
    for i in range(120):
        entry = rng.choice([{"handler_node_id": f"h{i}"}, {"handler": {"node_id": f"h{i}", "line": 3}}, {"handler_node_id": None}, None])
        text = json.dumps({"id": i, "entry": entry, "steps": make_steps(rng, 0)})
        text = json.dumps(text) if i % 11 == 0 else text
        rows += [(i, text)] * (2 if i % 7 == 0 else 1)
    df = spark.createDataFrame(rows, "record_id long, payload string").withColumns({"node": F.lit(1), "doc": F.lit("x")})
    got = {tuple(r) for r in shredding.flow_steps(df).where("node_id is not null and node_id != ''").select("record", "step_path", "parent_node_id", "node_id").collect()}
    assert got == {(i, *s) for i, t in rows for s in brute_steps(t)}
    assert shredding.flow_steps(df.limit(0)).count() == 0


def test_documents_of_any_depth_and_length(spark):
    """A step chain far beyond the recursion limit, and one object with very many steps, in linear time."""
    depth, many = 3_000, 40_000
    deep = '{"id": "d", "steps": ' + "".join(f'[{{"node_id": "n{i}", "steps": ' for i in range(depth)) + "[]" + "}]" * depth + "}"
    wide = json.dumps({"entry": {"handler": {"node_id": "h"}}, "steps": [{"node_id": "p", "steps": [{"node_id": f"w{i}"} for i in range(many)]}]})
    df = spark.createDataFrame([(1, deep), (2, wide), (3, deep[:-1])], "record_id long, payload string")
    got = {(r.record, r.node_id): r for r in shredding.flow_steps(df).collect()}
    assert len(got) == depth + many + 1
    assert got[1, f"n{depth - 1}"].parent_node_id == f"n{depth - 2}" and got[1, f"n{depth - 1}"].step_path.count(".") == depth - 1
    assert got[2, "p"].parent_node_id == "h" and all(got[2, f"w{i}"].parent_node_id == "p" for i in range(many))
    assert [r.record_id for r in shredding.broken_documents(df).collect()] == [3]
    objects = sum(1 for row in shredding.adjacency_rows('{"steps":[' * 50_000 + "]}" * 50_000, keep=frozenset()) if row[7] == "object")
    assert objects == 50_000


def test_the_deep_parser_equals_the_library():
    rng = random.Random(12)

    def value(depth):
        kind = rng.randrange(9 if depth < 5 else 6)
        if kind >= 6:
            return {f"k{rng.randrange(5)}\n": value(depth + 1) for _ in range(rng.randrange(4))} if kind == 6 else [value(depth + 1) for _ in range(rng.randrange(4))]
        return [None, True, -1.5e3, 12345678901234567890, "ä\u2028\\\"", 0][kind]

    for _ in range(300):
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert shredding.parse_deep(f" {text}\n") == json.loads(text)
        broken = text[: rng.randrange(len(text))] + rng.choice(["", ",", "]", "}", ":", "x", '"'])
        try:
            want = json.loads(broken)
        except ValueError:
            want = ValueError
        try:
            got = shredding.parse_deep(broken)
        except ValueError:
            got = ValueError
        assert got == want, broken


def test_node_numbers_do_not_depend_on_what_is_kept(spark):
    text = json.dumps({"id": "f", "entry": {"x": 1, "handler": {"node_id": "h"}}, "steps": [{"node_id": "a", "note": [1, 2], "steps": [{"node_id": "b", "entities_read": ["e"]}]}], "terminal_effects": {"entities_written": ["t", "u"]}})
    df = spark.createDataFrame([(1, text), (1, text)], "record_id long, payload string")
    whole = shredding.flow_adjacency(df)
    objects = {r.node: r.label for r in whole.where("kind = 'object'").collect()}
    steps = {r.node: (r.node_id, r.owner) for r in shredding.flow_steps(df).collect()}
    assert steps == {r.node: (r.node_id, r.owner) for r in shredding.steps_of(whole).collect()}
    (a,) = [n for n, (x, _) in steps.items() if x == "a"]
    (b,) = [n for n, (x, _) in steps.items() if x == "b"]
    assert steps[b][1] == a and steps[a][1] == 0
    owners = {(r.entity, r.owner) for r in shredding.flow_effects(df).collect()}
    (effects,) = [n for n, label in objects.items() if label == "terminal_effects"]
    assert owners == {("e", b), ("t", effects), ("u", effects)} == {(r.entity, r.owner) for r in shredding.effects_of(whole).collect()}
    assert shredding.flows_of(whole).collect() == shredding.flow_table(df).collect()


def test_deep_nesting_and_long_values(spark):
    deep = {"node_id": "leaf", "note": "y" * 200_000}
    for i in range(60):
        deep = {"node_id": f"d{i}", "steps": [deep]}
    df = spark.createDataFrame([(1, json.dumps({"steps": [deep]}))], "record_id long, payload string")
    assert {tuple(r) for r in shredding.flow_steps(df).select("step_path", "parent_node_id", "node_id").collect()} == brute_steps(df.first().payload)


def brute_changes(rows, entries):
    last = {}
    for p, s, i, at, name, text in rows:
        if (p, s, i) not in last or at > last[p, s, i][0]:
            last[p, s, i] = (at, name, (text or "").strip())
    by = {}
    for (p, s, i), v in last.items():
        by.setdefault((p, s), {})[i] = v[1:]
    complete = sorted(k for k, v in by.items() if (*k, len(v)) in entries)
    out = set()
    for before, after in zip(complete, complete[1:]):
        if before[0] == after[0]:
            a, b = by[before], by[after]
            out |= {(after[0], after[1], i, "added") for i in b.keys() - a.keys()} | {(after[0], after[1], i, "removed") for i in a.keys() - b.keys()}
            out |= {(after[0], after[1], i, "changed") for i in a.keys() & b.keys() if a[i] != b[i]}
    return out


def test_changes_equal_full_comparison(spark):
    rng = random.Random(8)
    start, rows, entries = datetime(2025, 1, 1), [], set()
    for p in ("a", "b", "c"):
        ids = {f"{p}{i}": (f"n{i % 5}", "  text" if i % 3 else None) for i in range(400)}
        for s in range(1, 6):
            for k in rng.sample(sorted(ids), 25):
                ids.pop(k)
            ids |= {f"{p}{rng.randrange(9999)}": ("new", "") for _ in range(20)}
            ids |= {k: (rng.choice("xyz"), rng.choice(["text ", "\tt", None, ""])) for k in rng.sample(sorted(ids), 30)}
            for k, (name, text) in ids.items():
                rows.append((p, s, k, start + timedelta(hours=s), name, text))
                if rng.random() < 0.1:
                    rows.append((p, s, k, start, "old", "old"))
            entries.add((p, s, len(ids) + (7 if (p, s) in {("b", 3), ("c", 1)} else 0)))
    df = spark.createDataFrame(rows, "project_id string, snapshot_no int, id string, recorded_at timestamp, name string, description string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("type", "qualified_name", "category")} | {"level": F.lit(1), "source": F.struct(F.lit("f").alias("file"), F.rand().alias("line")), "change": F.lit("clash")})
    announced = spark.createDataFrame(sorted(entries) * 2 + [("a", 1, None)], "project_id string, snapshot_no int, node_count long")
    got = snapshots.node_changes(df, announced, mean_rows=16)
    found = got.select("project_id", "snapshot_no", "id", "change").collect()
    assert {tuple(r) for r in found} == brute_changes(rows, entries)
    assert len(found) == len(set(found))
    assert snapshots.node_changes(df.limit(0), announced).count() == 0


def test_chunks_depend_on_keys_alone(spark):
    rng = random.Random(3)
    keys = [f"k{rng.randrange(10**6)}" for _ in range(900)]
    rows = [("p", v, k, bytes([rng.randrange(256)])) for v in (1, 2) for k in set(keys)] + [("q", 1, k, b"x") for k in keys[:50]]
    df = spark.createDataFrame(rows, "grp string, version int, key string, digest binary")
    seen = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            seen.append({tuple(r) for r in snapshots.chunked(df, 16).select("grp", "version", "key", "chunk").collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] == seen[1] and len(seen[0]) == len(set(rows)) and len({c for *_, c in seen[0]}) > 20


def test_deliveries_against_a_store_equal_one_comparison(spark, tmp_path):
    rng = random.Random(4)
    state, rows, sizes = {f"k{i}": 0 for i in range(400)}, [], []
    for version in (1, 2, 3, 5):
        for _ in range(12):
            state.pop(rng.choice(sorted(state)))
            state[rng.choice(sorted(state))] = version
            state[f"n{rng.randrange(10**6)}"] = version
        rows += [("p", version, k, bytes([v])) for k, v in state.items()]
        sizes.append(("p", version, len(state) + (version == 3)))
    df = spark.createDataFrame(rows, "grp string, version int, key string, digest binary")
    announced = spark.createDataFrame(sizes, "grp string, version int, size long")
    store = snapshots.SnapshotStore(spark, f"{tmp_path}/store")
    got = set()
    for version in (1, 2, 3, 5, 5):
        found = {tuple(r) for r in store.deliver(df.where(f"version = {version}"), announced, 16).collect()}
        assert version != 3 or not found
        got |= found
    table = snapshots.chunked(df, 16)
    pairs = snapshots.consecutive(df.groupBy("grp", "version").agg(F.count("*").alias("size")), announced).where("before is not null")
    want = {tuple(r) for r in snapshots.classified(table, table, snapshots.unmatched_chunks(snapshots.chunk_digests(table), pairs)).collect()}
    assert got == want and {c for *_, c in got} == {"added", "removed", "changed"}
    kept = spark.read.parquet(f"{tmp_path}/store/rows")
    assert kept.count() < 0.9 * len(rows) and kept.count() == kept.distinct().count()


def test_callers_count_pairs_once(spark):
    edges = [("e1", "a", "t"), ("e1", "a", "t"), ("e2", "a", "t"), ("e3", "b", "t"), ("e4", "t", "t"), ("e5", None, "t"), ("e6", "a", None), (None, "c", "u"), (None, "c", "u")]
    df = spark.createDataFrame(edges, "id string, source string, target string").withColumn("edges", F.lit(9))
    got = {tuple(r) for r in skew.callers_of_target(df).collect()}
    assert got == {("t", 5, 2), ("u", 2, 1)}
    units = spark.createDataFrame([("t", "lib"), ("t", "lib"), (None, "x"), ("unused", "y")], "id string, library string").withColumn("edges", F.lit("clash"))
    named = {r.target: tuple(r) for r in skew.named_callers(df, units).collect()}
    assert {(k, e, n) for k, _, e, n in named.values()} == got and named["t"][1] == "lib" and {v[1] for k, v in named.items() if k != "t"} <= {None}
    assert {r.target for r in skew.heavy_targets(df, units, percent=50).collect()} == {"t"}
    assert skew.heavy_targets(df.limit(0), units).count() == 0


def test_eager_counts_equal_the_joined_rows(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice(["k1", "k2", "k3", None]), rng.randrange(9)) for _ in range(300)], "k string, v long")
    right = spark.createDataFrame([(rng.choice(["k1", "k2", "k4", None]), rng.choice("gh")) for _ in range(60)], "k string, g string")
    want = left.join(right, "k").groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = skew.eager_join_counts(left, right, "k", {"s": "v"}, ["g"])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
