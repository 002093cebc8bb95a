"""Heavy keys by sketch, then exactly: the same rows as a plain count, whatever collides."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.operators import sketch
from faultline.operators.oracles import fails_frame
from faultline.operators.provenance import Trace
from faultline.operators.trigrams import WeightRule, trigram_records, trigram_totals
from faultline.sources.lines import fixture_lines

SF = "/root/testdata/sf0.001"
RULE = WeightRule(doc_pattern="src7:147")


def frame(spark, rows):
    return spark.createDataFrame(rows, "trigram string, weight long")


def plain(rows, limit):
    totals = Counter()
    for k, w in rows:
        totals[k] += w or 0
    return {k: t for k, t in totals.items() if t >= limit and any(w is not None for key, w in rows if key == k)}


@pytest.mark.parametrize("bits, depth", [(20, 2), (3, 1), (2, 3), (6, 2), (10, 6)])
def test_totals_equal_a_plain_count(spark, bits, depth):
    rng = random.Random(bits)
    rows = [(rng.choice([None, "", *(f"k{i}" for i in range(40))]), rng.choice([0, 1, 1, 2, 30])) for _ in range(600)] + [("null weight", None), ("k1", None)]
    df = frame(spark, rows)
    for limit in (1, 25, 90, 200, 10**6):
        got = {r["trigram"]: r["total"] for r in sketch.totals_from(df, limit, bits=bits, depth=depth).collect()}
        assert got == plain(rows, limit)


def test_everything_collides(spark, monkeypatch):
    monkeypatch.setattr(sketch, "_cells", lambda key, bits, depth: [F.lit(5).cast("long")] * depth)
    rows = [(f"k{i % 50}", 1) for i in range(500)] + [("big", 60)]
    got = sketch.totals_from(frame(spark, rows), 60).collect()
    assert [(r["trigram"], r["total"]) for r in got] == [("big", 60)]


def test_a_sketch_leaves_few_candidates(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("trigram"), F.lit(1).alias("weight"))
    heavy = frame(spark, [("hot", 1000)] * 5)
    some = sketch.candidate_rows(rows.unionByName(heavy), "trigram", "weight", 2000)
    assert some.distinct().count() < 2000  # of 200,001 keys: those in the cell of the heavy one
    assert some.where("trigram = 'hot'").count() == 5


def test_cells_follow_the_size_of_the_scan(spark):
    small, large = spark.range(10), spark.range(1 << 40)
    assert sketch.bits_for(small, 10_000) == sketch.FEWEST_BITS and sketch.bits_for(large, 10_000) == sketch.MOST_BITS
    assert sketch.FEWEST_BITS < sketch.bits_for(spark.range(1 << 23), 10_000) < sketch.MOST_BITS


def test_negative_weights_leave_every_key(spark):
    rows = [("a", 10), ("a", -4), ("b", 7), ("c", -1)]
    assert sketch.heavy_cells(frame(spark, rows), "trigram", "weight", 6) is None
    got = {r["trigram"]: r["total"] for r in sketch.totals_from(frame(spark, rows), 6).collect()}
    assert got == {"a": 6, "b": 7}


def test_limits_without_use_for_a_sketch(spark):
    rows = [("a", 0), ("b", 3), ("c", None)]
    assert {r["trigram"] for r in sketch.totals_from(frame(spark, rows), 0).collect()} == {"a", "b"}
    assert sketch.totals_from(frame(spark, []), 5).count() == 0
    assert [r["fails"] for r in fails_frame(frame(spark, []), threshold=5).collect()] == [False]


def test_outputs_of_every_limit(spark):
    records = trigram_records(fixture_lines(spark, SF), RULE)
    totals = {r["trigram"]: r["total"] for r in trigram_totals(records).collect()}
    for limit in (3, 30, 10_000):
        got = {r["trigram"]: r["total"] for r in sketch.totals_from(records, limit + 1).collect()}
        assert got == {k: t for k, t in totals.items() if t > limit}
        bad = Trace(fixture_lines(spark, SF), RULE, limit=limit).bad
        assert {r["trigram"]: r["total"] for r in bad.collect()} == got


def test_first_shuffle_has_cells_and_second_has_candidates(spark, monkeypatch):
    kind = type(spark.range(0))
    plans, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    heavy = sketch.heavy_cells(trigram_records(fixture_lines(spark, SF), RULE), "trigram", "weight", 10_001)
    assert "Python" not in plans[0] and plans[0].count("FileScan") == 1
    exchanges = [x for x in plans[0].splitlines() if "Exchange hashpartitioning" in x]
    assert all("trigram" not in x for x in exchanges) and any("cell" in x for x in exchanges)
    assert heavy.count <= 2 * 80_000 / 10_001 * 2
    counted = sketch.totals_from(trigram_records(fixture_lines(spark, SF), RULE), 10_001)._jdf.queryExecution().executedPlan().toString()
    below = counted[counted.index("Exchange hashpartitioning(trigram"):]
    assert "xxhash64" in below  # records are left out before they are shuffled


def test_more_cells_than_bits(spark, monkeypatch):
    """A low limit over many bytes: heavy cells are rows, few records are left for the exact count."""
    monkeypatch.setattr(sketch, "scan_bytes", lambda rows: 500 << 21)
    rows = spark.createDataFrame([(f"k{i}", 1) for i in range(3000)] + [(None, 300)] * 2 + [("big", 251)] * 2 + [("near", 250)] * 2, "trigram string, weight int")
    some = sketch.candidate_rows(rows, "trigram", "weight", 501)
    assert some.columns == rows.columns and 4 <= some.count() < 20
    assert sorted((r["trigram"] or "", r["total"]) for r in sketch.totals_from(rows, 501).collect()) == [("", 600), ("big", 502)]
    signed = rows.union(spark.createDataFrame([("big", -1)], rows.schema))
    assert sketch.candidate_rows(signed, "trigram", "weight", 501).count() == signed.count()


@pytest.mark.parametrize("each", [1, 4])
@pytest.mark.parametrize("weights", [[1], [1, 2, 9], [-3, 1, 2]])
def test_rows_of_the_largest_totals(spark, monkeypatch, each, weights):
    monkeypatch.setattr(sketch, "_EACH", each)
    rng = random.Random(len(weights))
    heavy = ["a"] * 40 + ["b"] * 30 + ["c"] * 20 + ["d"] * 20 + [None] * 25
    rows = [(i, k, rng.choice(weights)) for i, k in enumerate(heavy + [f"x{rng.randint(0, 900)}" for _ in range(1500)])]
    frame = spark.createDataFrame(rows, "line_id long, trigram string, weight int")
    totals = lambda df: {r[0]: r[1] for r in df.groupBy("trigram").agg(F.sum("weight")).collect()}
    whole = totals(frame)
    some = sketch.rows_of_largest(frame, 4, ["line_id"])
    last = sorted(whole.values())[-4]
    assert {k: v for k, v in totals(some).items() if v >= last} == {k: v for k, v in whole.items() if v >= last}
    if min(weights) > 0:  # others are left out before they are counted
        assert len(totals(some)) < len(whole) / 4
    assert sketch.rows_of_largest(frame, 5000, ["line_id"]).count() == len(rows)
    assert sketch.rows_of_largest(frame.limit(0), 4, ["line_id"]).count() == 0
