"""Problem 5 against brute force, with copies, ties, unusable rows and cut cells."""

from datetime import datetime, timedelta

import numpy as np

from stratagraph.llm import neighbours as nb

SCHEMA = "id long, analysis_id string, node_id string, embedding array<float>, model string, created_at timestamp, key string"


def brute(rows, k=5):
    last = {}
    for i, a, n, v, m, at, _ in rows:
        if (a, n) not in last or (at, i) > last[a, n][:2]:
            last[a, n] = (at, i, v, m)
    good = [(i, np.array(v, np.float32).astype(float), m) for _, i, v, m in last.values() if m is not None and v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for i, v, m in good:
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w, o in good if o == m and j != i)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def rows_of(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 64))
    rows, start = [], datetime(2025, 1, 1)
    same = rng.standard_normal(64)
    for i in range(n):
        v = same if i < copies else centres[rng.integers(6)] + 0.3 * rng.standard_normal(64)
        rows.append((i, "a", f"n{i}", [float(x) for x in v * (1 if i < copies else rng.lognormal())], "m1" if i % 4 or i < copies else "m2", start, "clash"))
    rows.append((n, "a", f"n{n - 1}", [float(x) for x in rng.standard_normal(64)], "m1", start + timedelta(1), None))
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0] * 65]
    rows += [(n + 1 + j, "a", f"bad{j}", v, "m1", start, "") for j, v in enumerate(bad)]
    rows += [(n + 20, "a", "other", [1.0] * 64, None, start, ""), (n + 21, None, None, [1e30] + [1.0] * 63, "m3", start, "")]
    return rows


def recall(found, wanted):
    return len(found & wanted) / len(wanted), len(found & wanted) / max(1, len(found))


def test_pairs_equal_brute_force(spark):
    rows = rows_of(700, 1, copies=230)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nb.nearest_pairs(df, per_cell=60, block=64).collect()
    found = {tuple(r) for r in got}
    assert len(found) == len(got)
    reached, precise = recall(found, brute(rows))
    assert reached >= 0.97 and precise >= 0.97


def test_empty_and_tiny(spark):
    df = spark.createDataFrame(rows_of(3, 2), SCHEMA)
    assert {tuple(r) for r in nb.nearest_pairs(df).collect()} == brute(rows_of(3, 2))
    assert nb.nearest_pairs(df.limit(0)).count() == 0


def test_bounds_keep_the_best():
    rng = np.random.default_rng(4)
    units = nb.unit(rng.standard_normal((500, 64)) * 0.3 + rng.standard_normal(64))
    centre, turn = nb.fit_cells(units, 1)[0], nb.rotation(64)
    parts = list(nb.search_block(units, *nb.codes(units, centre[None], turn), units, centre, turn, 6, 3.0))
    qi, vi, cosine = (np.concatenate(p) for p in zip(*parts))
    exact = units @ units.T
    assert np.allclose(cosine, exact[qi, vi])
    assert len(qi) < 0.8 * exact.size
    kept = set(zip(qi.tolist(), vi.tolist()))
    best = np.argsort(-exact, axis=1)[:, :6]
    assert np.mean([(q, int(v)) in kept for q, row in enumerate(best) for v in row]) > 0.99


def test_crowded_cells_are_split(spark):
    """The number of fitted cells is bound here far below what the vectors need, so each is split where its vectors are."""
    rows = rows_of(1500, 5, copies=300)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nb.nearest_pairs(df, per_cell=40, most_cells=3, largest=80, block=64).collect()
    found = {tuple(r) for r in got}
    reached, precise = recall(found, brute(rows))
    assert len(found) == len(got) and reached >= 0.9 and precise >= 0.9
