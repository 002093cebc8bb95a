"""Tracing over several steps, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import lineage as lineage_module
from faultline.operators.lineage import Lineage


@pytest.fixture(scope="module")
def job(spark):
    """numbers -> (digit of each, place) -> sums by digit -> sums by parity; null numbers and digits included."""
    rng = random.Random(4)
    numbers = [(i, rng.choice([None, str(rng.randint(0, 9999))])) for i in range(60)]
    source = spark.createDataFrame(numbers, "id long, text string")
    digits = source.where("text is not null").select("id", F.posexplode(F.split("text", "")).alias("place", "digit"))
    digits = digits.withColumn("digit", F.when(F.col("digit") != "7", F.col("digit")))
    sums = digits.groupBy("digit").agg(F.count("*").alias("n"))
    parity = sums.withColumn("even", F.col("digit").cast("int") % 2 == 0)
    totals = parity.groupBy("even").agg(F.sum("n").alias("n"))
    lineage = (Lineage(source, ["id"], "numbers").step("digits", digits, ["id", "place"])
               .step("sums", sums, ["digit"], edges=digits).step("totals", totals, ["even"], edges=parity))
    plain = [(i, p, None if d == "7" else d) for i, t in numbers if t is not None for p, d in enumerate(t)]
    return lineage, numbers, plain


def parity_of(d):
    return None if d is None else int(d) % 2 == 0


@pytest.mark.parametrize("even", [True, False, None])
def test_back_over_all_steps(spark, job, even):
    lineage, numbers, plain = job
    start = lineage.at("totals", spark.createDataFrame([(even, "other"), (even, "twice")], "even boolean, x string"))
    assert {r["digit"] for r in start.back().ids.collect()} == {d for *_, d in plain if parity_of(d) == even}
    records = start.back(2)
    assert {tuple(r) for r in records.ids.collect()} == {(i, p) for i, p, d in plain if parity_of(d) == even}
    want = {i for i, _, d in plain if parity_of(d) == even}
    assert {r["id"] for r in start.back_all().ids.collect()} == {r["id"] for r in start.back(3).ids.collect()} == want
    assert {tuple(r) for r in start.back_all().show().collect()} == {x for x in numbers if x[0] in want}
    assert start.back(0) is start


def test_forward_and_there_and_back(spark, job):
    lineage, numbers, plain = job
    some = {3, 17, 21}
    start = lineage.at("numbers", spark.createDataFrame([(i,) for i in some], "id long"))
    digits = {d for i, _, d in plain if i in some}
    assert {r["digit"] for r in start.forward(2).ids.collect()} == digits
    assert {r["even"] for r in start.forward(3).ids.collect()} == {parity_of(d) for d in digits}
    assert {r["id"] for r in start.forward(2).back_all().ids.collect()} == {i for i, _, d in plain if d in digits}
    assert start.forward(3).show().count() == len({parity_of(d) for d in digits})


def test_joins_left_to_spark_give_the_same(spark, job):
    lineage, *_ = job
    ids = spark.createDataFrame([("3",), (None,)], "digit string")
    here = sorted(tuple(r) for r in lineage.at("sums", ids).back().ids.collect())
    lineage.max_broadcast_bytes = 0
    try:
        assert sorted(tuple(r) for r in lineage.at("sums", ids).back().ids.collect()) == here
    finally:
        lineage.max_broadcast_bytes = 32 << 20


def test_steps_that_do_not_fit(spark, job):
    lineage, *_ = job
    ids = spark.createDataFrame([("3",)], "digit string")
    for move in (lambda c: c.back(3), lambda c: c.forward(2), lambda c: c.back(-1), lambda c: c.forward(-1)):
        with pytest.raises(ValueError):
            move(lineage.at("sums", ids))
    with pytest.raises(ValueError):
        Lineage(ids, ["digit"]).step("next", ids, ["other"])
    with pytest.raises(ValueError):
        Lineage(ids, ["digit"]).step("source", ids, ["digit"])
    assert lineage.at(-1, spark.createDataFrame([], "even boolean")).back_all().ids.count() == 0


@pytest.fixture()
def joins(monkeypatch):
    """The number of joins that moves have asked for."""
    made = []
    inner = lineage_module.join_small
    monkeypatch.setattr(lineage_module, "join_small", lambda *a, **b: made.append(1) or inner(*a, **b))
    return made


def made_job(spark):
    """Texts -> their letters -> totals by letter -> totals by case, with repeated ids, null ids and null letters."""
    texts = spark.createDataFrame([(1, "aB"), (2, "bb"), (2, "A"), (None, "C"), (4, None), (5, "-c")], "id long, text string")
    letters = texts.where("text is not null").select("id", F.posexplode(F.split("text", "")).alias("pos", "x"))
    letters = letters.withColumn("x", F.when(F.col("x") != "-", F.col("x")))
    totals = letters.groupBy("x").agg(F.count("*").alias("n"))
    low = F.lower("x")
    words = totals.groupBy(low.alias("low")).agg(F.sum("n").alias("n"))
    start = Lineage(texts, ["id"], "texts").step("letters", letters, ["id", "pos"])
    own = start.step("totals", totals, ["x"], edges=letters)
    return own.step("words", words, ["low"], made={"low": low}), totals.withColumn("low", low)


@pytest.mark.parametrize("low, letters, ids", [
    ("a", {(1, 0), (2, 0)}, {1, 2}), ("c", {(None, 0), (5, 1)}, {None, 5}), (None, {(5, 0)}, {5}), ("z", set(), set())])
def test_a_made_key_leads_back_with_one_join(spark, joins, low, letters, ids):
    job, edges = made_job(spark)
    start = job.at("words", spark.createDataFrame([(low,)] * 2, "low string"))
    assert sorted(map(str, map(tuple, start.back(2).ids.collect()))) == sorted(map(str, letters))
    joins.clear()
    lines = start.back_all()
    assert len(joins) == 1
    assert len(rows := lines.ids.collect()) == len(ids) and {r["id"] for r in rows} == ids
    # the same as over edges of its own
    plain = Lineage(job.stages[0].values, ["id"], "texts").step("letters", job.stages[1].values, ["id", "pos"])
    plain = plain.step("totals", job.stages[2].values, ["x"], edges=job.stages[1].values.select("*")).step("words", job.stages[3].values, ["low"], edges=edges)
    again = plain.at("words", spark.createDataFrame([(low,)], "low string")).back_all()
    assert {r["id"] for r in again.ids.collect()} == ids
    assert sorted(map(str, lines.show().collect())) == sorted(map(str, again.show().collect()))


def test_forward_over_shared_rows_with_one_join(spark, joins):
    job, _ = made_job(spark)
    start = job.at("texts", spark.createDataFrame([(2,), (None,), (2,)], "id long"))
    end = start.forward(3)
    assert len(joins) == 1
    assert sorted(r["low"] for r in end.ids.collect()) == ["a", "b", "c"]
    assert {tuple(r) for r in end.show().collect()} == {("a", 2), ("b", 3), ("c", 2)}
    # a repeated id leads to all letters at its place, also from a letter
    one = job.at("letters", spark.createDataFrame([(2, 0)], "id long, pos int"))
    assert sorted(r["x"] for r in one.forward().ids.collect()) == ["A", "b"]
    # rows chosen by a letter are not all rows of their place
    some = job.at("totals", spark.createDataFrame([("A",)], "x string")).back()
    assert [tuple(r) for r in some.ids.collect()] == [(2, 0)]
    assert sorted(r["x"] for r in some.forward().ids.collect()) == ["A", "b"]


def test_made_keys_that_do_not_fit(spark):
    job, edges = made_job(spark)
    values = job.stages[-1].values
    for wrong in ({"key": ["low"], "made": {"other": F.lit(1)}}, {"key": ["n"], "made": {"n": F.lit(1)}, "edges": edges}, {"key": ["x"], "made": {"x": F.lit(1)}}):
        with pytest.raises(ValueError):
            job.step("next", values, **wrong)
