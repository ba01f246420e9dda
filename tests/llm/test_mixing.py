"""Problem 9: supply, tempering and the realised set."""

import math

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import mixing


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(5000)] + [(9000 + i, "small", 20) for i in range(100)] + [(9500, "other", 5), (None, "small", 20)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long").cache()


TARGETS = "source string, target_share double, max_repeats int"


def test_supply_and_short_sources(spark, counted):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.2, 1)], TARGETS)
    weights = mixing.weighted(mixing.source_tokens(counted, targets))
    rows = {r.source: r for r in weights.collect()}
    big = counted.where("source = 'big'").agg(F.sum("tokens")).first()[0]
    assert set(rows) == {"big", "small", "absent"}
    assert rows["big"].total == big + 2020 and not rows["big"].short
    assert rows["small"].short and rows["absent"].short and rows["absent"].tokens == 0 and rows["absent"].weight == 0
    # Normalised weights, of which the short source's is as large as its repeats allow.
    assert math.isclose(sum(r.weight for r in rows.values()), 1) and 0 < rows["big"].exponent < 1
    assert math.isclose(rows["small"].budget, 3 * 2020, rel_tol=1e-9) and rows["small"].budget <= 3 * 2020
    mixed = mixing.realise(counted, weights, block_rows=100).collect()
    assert max(r.copies for r in mixed if r.source == "small") == 3 and max(r.copies for r in mixed if r.source == "big") == 1
    for source in ("big", "small"):
        assert abs(sum(r.copies * r.tokens for r in mixed if r.source == source) - rows[source].budget) <= 10
    shares = {r.source: r for r in mixing.reached_shares(spark.createDataFrame(mixed), weights).collect()}
    assert math.isclose(sum(r.reached_share for r in shares.values()), 1.0) and shares["absent"].reached_share == 0
    assert all(abs(shares[s].reached_share - shares[s].weight) < 1e-3 for s in shares)


def test_targets_that_can_be_met_are_met(spark, counted):
    weights = mixing.weighted(mixing.source_tokens(counted, spark.createDataFrame([("big", 0.93, 1), ("small", 0.07, 4)], TARGETS)))
    rows = {r.source: r for r in weights.collect()}
    assert {r.exponent for r in rows.values()} == {0.0} and math.isclose(rows["small"].weight, 0.07) and not any(r.short for r in rows.values())
    order = mixing.in_order(mixing.realise(counted, weights, block_rows=10), weights, block_rows=10).where("source = 'small'").collect()
    passes = [[r.doc_id for r in sorted((r for r in order if r["pass"] == n), key=lambda r: (r.block, r.place))] for n in (0, 1, 2)]
    assert sorted(passes[0], key=str) == sorted(passes[1], key=str) and passes[0] != passes[1] and len(set(passes[0])) == 101
    assert 0 < len(passes[2]) < 101 and mixing.weighted(mixing.source_tokens(counted.limit(0), spark.createDataFrame([], TARGETS))).count() == 0


@pytest.mark.parametrize("rows", [1, 700, 10_000])
def test_any_cut_into_blocks_meets_the_budget(spark, counted, rows):
    supply = {r.source: (r.t, r.n) for r in counted.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    weights = spark.createDataFrame([("big", 4, *supply["big"], 100_000.0), ("small", 9, *supply["small"], 5000.0)], "source string, max_repeats int, tokens long, documents long, budget double")
    mixed = mixing.realise(counted, weights, block_rows=rows).collect()
    for source, want, width in (("big", 100_000, 16), ("small", 5000, 20)):
        assert abs(sum(r.copies * r.tokens for r in mixed if r.source == source) - want) <= width / 2 + 1
    copies = {r.copies for r in mixed if r.source == "small"}
    assert copies <= {2, 3} and mixing.realise(counted.limit(0), weights).count() == 0


def test_texts_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "", "s"), (4, "a b", None)], "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    assert sorted(map(tuple, mixing.document_tokens(df).collect())) == [(1, "s", 2), (2, "s", 0), (3, "s", 0)]


def test_tempering():
    sizes = {"a": 9000, "b": 900, "c": 100, "none": 0}
    _, flat = mixing.tempered(sizes, entropy=9.0)
    assert all(math.isclose(flat[s], 1 / 3) for s in "abc") and flat["none"] == 0
    _, half = mixing.tempered(sizes, entropy=0.8)
    assert math.isclose(-sum(w * math.log(w) for w in half.values() if w), 0.8, abs_tol=1e-6)
    _, limited = mixing.tempered(sizes, max_repeats=4)
    assert limited["c"] * 10_000 <= 4 * 100 + 1e-6 and limited["c"] * 10_000 > 399
    assert mixing.tempered({}) == (0.0, {})
    exponent, met = mixing.tempered(sizes, max_repeats={"a": 1, "b": 9, "c": 30, "none": 5}, shares={"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0})
    assert exponent == 0 and met == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0})
    exponent, bound = mixing.tempered(sizes, max_repeats={"a": 1, "b": 2, "c": 30, "none": 5}, shares={"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0})
    assert 0 < exponent < 1 and math.isclose(bound["b"] * 10_000, 1800, rel_tol=1e-6) and math.isclose(sum(bound.values()), 1)
