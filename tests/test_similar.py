"""Near copies against all pairs."""

import random

from pyspark.sql import functions as F

from stratagraph.operators import similar


def brute(texts):
    sets = {}
    for text in texts:
        words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()]
        if words:
            sets[text] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                out.add(frozenset((a, b)))
    return out


def test_pairs_and_classes_equal_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for text in texts[:30]:
        parts = text.split()
        for _ in range(3):
            edited = list(parts)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append(" ".join(edited))
    rows = [(i, x) for i, x in enumerate(texts + texts[:5])] + [(900, None), (901, ""), (902, " . "), (903, "a b"), (904, "A  b!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"links": F.lit("clash"), "s": F.lit(1)})
    hashes = {r.h: r.text for r in df.where("text is not null").select("text", F.md5("text").alias("h")).collect()}
    got = {frozenset((hashes[r.a], hashes[r.b])) for r in similar.similar_pairs(similar.word_shingles(df, "doc_id", "text")).collect()}
    want = brute({x for _, x in rows if x})
    assert got == want
    classes = {r.doc_id: r for r in similar.similar_classes(df, "doc_id", "text").collect()}
    assert set(classes) == {i for i, x in rows if x and any(c.isalnum() for c in x)}
    for i, x in rows:
        if i in classes:
            assert classes[i].links == sum(x in p for p in want)
    for pair in want:
        ids = [i for i, x in rows if x in pair]
        assert len({classes[i].class_id for i in ids}) == 1
    assert similar.similar_classes(df.limit(0), "doc_id", "text").count() == 0


def test_every_query_vector_gets_its_top_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = {i: rng.standard_normal(8) for i in range(1, 300)} | {300: np.zeros(8)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()] + [(400, None), (420, [1.0, 0.0])], "vec_id long, embedding array<double>")
    want = {(420, 420, 1.0)}
    for q in range(20, 300, 20):
        scores = sorted((-round(float(v @ vectors[q] / np.linalg.norm(v) / np.linalg.norm(vectors[q])), 6), i) for i, v in vectors.items() if v.any())
        want |= {(q, i, -s) for s, i in scores[:20]}
    got = similar.cosine_top(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, block=64).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
