"""Problem 3: evidence by path, header and composition, and containment against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import provenance as p
from stratagraph.llm import transducer

CODE = "import os\n\n\ndef total(rows, limit=10):\n    kept = [row for row in rows if row.size > limit]\n    return sum(row.size for row in kept)\n\n\nclass Reader:\n    def __init__(self, path):\n        self.path = path\n        self.lines = None\n"


@pytest.mark.parametrize(
    "path, kind",
    [("node_modules/a/index.js", "vendored"), (".\\third_party\\a\\b.c", "vendored"), ("vendor/x.example/lib/a.go", "vendored"), ("web/vendor/lib/a.ts", "vendored"), ("app/_vendor/a/b.py", "vendored"), (".venv/lib/site-packages/a/b.py", "vendored"), ("a/b.pb.go", "generated"), ("a/b_pb2.py", "generated"), ("pkg/zz_generated.deep.go", "generated"), ("x/__generated__/a.ts", "generated"), ("packages/a/dist/b.ts", "generated"), ("js/a.min.js", "generated"), ("web/assets/a-fd28b91f.js", "generated"), ("a/package-lock.json", "lock"), ("Cargo.lock", "lock"),
     ("src/vendor/own-vendor-list.ts", None), ("apps/vendors/a.ts", None), ("src/generator/a.ts", None), ("scripts/build/a.ts", None), ("src/bundle/a.ts", None), ("src/distribution/a.py", None), ("tools/minify/a.py", None), ("src/lib/a.py", None), (None, None), ("", None)],
)
def test_paths(path, kind):
    assert p.by_path(path) == kind


@pytest.mark.parametrize("line", ["// Code generated by x v1.2. DO NOT EDIT.", "# @generated by x", "-- <auto-generated> x 1.0 </auto-generated>", "# AUTO-GENERATED FILE - changes are overwritten by x", "# Autogenerated claim bindings (x 1.2.3)", "// Automatisch erzeugt von x 1.2, nicht bearbeiten", "# Fichier genere par x, ne pas modifier", "# Machine-made output of `x emit y`. Hand edits will be lost.", "# This file was automatically produced from a.idl; edit the definition, not this file.", "// Do not modify by hand: run `make a` instead (x)."])
def test_generated_headers(line):
    assert p.by_header(f"// Copyright 2015 the own contributors\n// All rights reserved.\n\n{line}\n{CODE}") == "generated"


@pytest.mark.parametrize("line", ["/*! lib v1.2.3 | (c) 2020 lib contributors | MIT */", "# lib 1.2.3 -- Copyright 2017 the lib contributors", "// Copied verbatim from https://forge.example/lib/a.ts at 12ab", "# Imported from upstream lib, tag v1.2.3", "// SPDX-FileCopyrightText: 2020 lib developers", "# This file is part of lib 1.2.3, (c) its contributors, BSD licence", "// Permission is granted, free of charge, to use this lib copy under the terms in LICENCE"])
def test_copied_headers(line):
    assert p.by_header(f"{line}\n{CODE}") == "vendored"


@pytest.mark.parametrize("line", ["// The report generator calls this for each order.", "# Generates the monthly report; written by hand, see the notes.", "// Not generated: keep the order of the fields.", "# Do not edit the limit without asking the owners.", "// Minified output is compared with this source in the tests.", "# Replaces the vendored helper by our own one.", "// Copyright 2013 the own contributors\n// All rights reserved."])
def test_own_headers(line):
    assert p.by_header(f"{line}\n{CODE}") is None


def test_composition():
    rng = random.Random(2)
    encode = transducer.load().encode
    kind = lambda text: p.by_composition(text, encode)
    minified = "".join(f"!function({rng.choice('abc')}){{var {rng.choice('xyz')}=t[{rng.randrange(99)}],n=!0;e&&r(o,{{k:{rng.randrange(999)},v:!1}})}}(this);" for _ in range(30))
    assert kind(minified) == "minified"
    assert kind("x = [\n" + "\n".join(f"  [{rng.random():.5f}, {rng.random():.5f}, -{rng.random():.5f}]," for _ in range(40)) + "\n]") == "data"
    assert kind("INSERT INTO a VALUES (1, 'k3', 2.5);\n" * 20) == "data"
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900))
    assert kind(f"export const t = '{blob}';\n") == "data"
    assert kind(CODE * 4) is None and kind("") is None and kind("x" * 50) is None
    assert kind(CODE + "# long line kept on purpose: " + " ".join(rng.choice(["cached", "order", "remote", "claims"]) for _ in range(200))) is None
    assert kind(CODE + f'key = "{blob[:400]}"\n') is None


def test_copies_equal_brute_force(spark):
    rng = random.Random(4)
    line = lambda: f"value_{rng.randrange(10**9)} = compute({rng.randrange(10**6)})"
    common = [f"found = self.load(context, key)  # {i}" for i in range(5)]
    vendored = [[line() for _ in range(20)] for _ in range(8)]
    rows, want = [], set()
    for i, body in enumerate(vendored):
        rows.append((i, f"node_modules/lib{i}/a.js", "\n".join(common + body)))
        edited = body[:17] + [line() for _ in range(2)]
        rows.append((100 + i, f"src/own{i}.js", "\r\n".join(edited + common)))
        want.add(100 + i)
        rows.append((200 + i, f"src/other{i}.js", "\n".join(body[:5] + [line() for _ in range(20)] + common)))
    rows += [(300 + i, f"src/many{i}.js", "\n".join(common + [line() for _ in range(9)])) for i in range(40)]
    rows += [(900, None, None), (901, "a", ""), (902, "b", "short"), (100, "src/own0.js", rows[1][2])]
    df = spark.createDataFrame(rows, "diff_id long, path string, content string").withColumns({"line": F.lit("clash"), "text": F.lit(1), "known": F.lit(2)})
    known = df.where("path like 'node_modules%'").select("diff_id", F.regexp_replace("path", "node_modules/", "").alias("library"))
    assert {r.diff_id for r in p.contained_copies(df, known).collect()} == want
    reasons = {r.diff_id: r.reason for r in p.not_hand_written(df).collect()}
    assert {k for k, v in reasons.items() if v == "copied"} == want and {k for k, v in reasons.items() if v == "vendored"} == set(range(8))
    assert p.not_hand_written(df.limit(0)).count() == 0


def test_copies_with_many_versions(spark):
    rng = random.Random(5)
    line = lambda: f"value_{rng.randrange(10**9)} = compute({rng.randrange(10**6)})"
    frames = [f"found = self.load(context, key)  # {i}" for i in range(12)]
    body = [line() for _ in range(20)]
    rows = [(i, f"node_modules/lib/v{i}.js", "\n".join(body + [line()])) for i in range(3)]
    rows += [(100 + i, f"src/own{i}.js", "\n".join(body[:18] + [line() for _ in range(2)])) for i in range(30)]
    # Lines of own files that stand everywhere, each in another third-party file, make no copy.
    rows += [(200 + i, f"node_modules/other{i}/a.js", "\n".join([frames[i]] + [line() for _ in range(9)])) for i in range(12)]
    rows += [(300 + i, f"src/plain{i}.js", "\n".join(frames[:8] + [line()])) for i in range(30)]
    df = spark.createDataFrame(rows, "diff_id long, path string, content string")
    found = {r.diff_id: r.containment for r in p.contained_copies(df, df.where("path like 'node_modules%'").select("diff_id", F.col("path").alias("library"))).collect()}
    assert found == {100 + i: 0.9 for i in range(30)}


@pytest.mark.parametrize("copies", [12, 14, 20, 60])
def test_a_library_that_everybody_edits_is_found_however_often(spark, copies):
    rng = random.Random(6)
    line = lambda: f"value_{rng.randrange(10**9)} = compute({rng.randrange(10**6)})"
    body = [line() for _ in range(20)]
    rows = [(0, "w0", "node_modules/lib/a.js", "\n".join(body))] + [(i, f"w{i}", f"src/own{i}.js", "\n".join([*body, line()])) for i in range(1, copies)]
    df = spark.createDataFrame(rows, "diff_id long, workspace_id string, path string, content string")
    found = {r.diff_id: (r.reason, r.copy_of) for r in p.not_hand_written(df).collect()}
    assert found == {0: ("vendored", None)} | {i: ("copied", "lib/a.js") for i in range(1, copies)}


def test_containment_is_per_library_and_across_repositories(spark):
    rng = random.Random(7)
    line = lambda: f"value_{rng.randrange(10**9)} = compute({rng.randrange(10**6)})"
    bodies = [[line() for _ in range(6)] for _ in range(10)]
    licence = [f"licence term {i} of a text that many libraries carry" for i in range(30)]
    rows = [(i, "a", f"node_modules/lib{i}/a.js", "\n".join(licence + b)) for i, b in enumerate(bodies)]
    # The same library in another repository, a file pieced together from all, and an own file under the common licence.
    rows += [(20, "b", "third_party/lib3/a.js", "\n".join(licence + bodies[3])), (21, "b", "src/pieces.js", "\n".join(b[0] for b in bodies)), (22, "c", "src/own.js", "\n".join(licence + [line() for _ in range(6)]))]
    # Short files: one that stands whole in a library file of its name, and one of another name.
    rows += [(30, "a", "node_modules/tiny/go.js", "go(1)"), (31, "b", "src/go.js", " go(1)\r\n"), (32, "b", "src/other.js", "go(1)")]
    df = spark.createDataFrame(rows, "diff_id long, workspace_id string, path string, content string")
    found = {r.diff_id: r for r in p.not_hand_written(df).collect()}
    assert {k for k, r in found.items() if r.copy_of} == {3, 20, 31} and found[3].reason == "vendored" and found[31].reason == "copied"
    assert found[20].copy_of == "lib3/a.js"
    assert 21 not in found and 22 not in found and 32 not in found


def _broadcast(plan):
    """The lines of a printed plan that stand below a broadcast."""
    below, depth = [], None
    for line in plan.split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            below.append(line)
        else:
            depth = at if "BroadcastExchange" in line else None
    return below


def test_rows_for_each_salt_are_never_broadcast(spark):
    rng = random.Random(8)
    line = lambda: f"value_{rng.randrange(10**9)} = compute({rng.randrange(10**6)})"
    bodies = [[line() for _ in range(20)] for _ in range(30)]
    rows = [(i, "a", f"node_modules/lib{i}/a.js", "\n".join(b)) for i, b in enumerate(bodies)]
    rows += [(100 + i, "b", f"src/own{i}.js", "\n".join([*b, line()])) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "diff_id long, workspace_id string, path string, content string")
    copies = p.contained_copies(df, df.where("diff_id < 100").select("diff_id", F.col("path").alias("library")))
    # Copies of libraries by the thousand make the driver run out of memory long before Spark's limit on estimates is reached.
    assert copies.count() == 30
    plan = copies._jdf.queryExecution().executedPlan()
    assert {r.diff_id for r in copies.collect()} == {100 + i for i in range(30)}
    printed = plan.toString()
    assert "explode" in printed.lower() and not [x for x in _broadcast(printed) if "explode" in x.lower()]


def test_heads_are_read_whole():
    licence = "\n".join(f"// line {i} of a licence" for i in range(60))
    assert p.by_header(f"{licence}\n// Code generated by x v1.2. DO NOT EDIT.\n{CODE}") == "generated"
    assert p.by_header("/*\n" + "\n".join(f"terms {'long ' * 90}{i}" for i in range(40)) + f"\nCode generated by x v1.2. DO NOT EDIT.\n*/\n{CODE}") == "generated"
    assert p.by_header(CODE * 5 + "# Code generated by x v1.2. DO NOT EDIT.") is None


def test_short_minified_files():
    encode = transducer.load().encode
    assert p.by_composition("!function(e,t){var n=t.k;e.x=n?1:0;e.y=function(){return n}}(this,window);", encode) == "minified"
    assert p.by_composition('{"a":1,"b":[2,3],"c":{"d":"e"}}', encode) is None and p.by_composition("const a = require('./a');\nmodule.exports = { a };\n", encode) is None
