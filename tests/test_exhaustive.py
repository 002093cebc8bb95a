"""Exhaustive search: branches as rows, against plain Python."""

from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from faultline.operators import minimize as mz
from faultline.operators.merged import ANY, MergeTest
from faultline.operators.oracles import CallableTest, SumThreshold

from test_minimize import frame, py_ddmin_all


def sets_of(res):
    out = defaultdict(list)
    for r in res.items.collect():
        out[r["set_id"]].append(r["id"])
    assert len(out) == res.count and sorted(out) == list(range(res.count))
    return sorted(sorted(v) for v in out.values())


def test_all_branches_through_complements(spark):
    # six items of weight 1, every four of them fail: all 15 sets, reached over and over
    res = mz.minimize_all(frame(spark, [(i, "k", 1) for i in range(6)]), SumThreshold("trigram", "weight", 4), ["id"], start_parts=6)
    assert sets_of(res) == [list(c) for c in combinations(range(6), 4)]
    assert [x[1:4] for x in res.levels] == [(1, 0, 6), (6, 0, 30), (15, 0, 0)]  # branches, parts, complements
    assert [x[6] for x in res.levels] == [0, 15, 0]  # every pair is dropped in two orders
    assert [tuple(r) for r in res.history.drop("micros").orderBy("level").collect()] == [x[:-1] for x in res.levels]


def test_joins_left_to_spark_give_the_same(spark):
    items = [(i, "k", 5 if i in (1, 6, 9) else 1) for i in range(11)]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 11), ["id"], max_broadcast_bytes=0)
    assert sets_of(res) == py_ddmin_all(items, 11)


def test_a_test_that_merges(spark):
    items = [(i, "abcab"[i % 5], 1) for i in range(7)]
    test = MergeTest("trigram", {"seen": (ANY, "yes")}, lambda seen: seen, quorum=3, rows=lambda d, carry: d.withColumn("yes", F.lit(True)))
    found = sets_of(mz.minimize_all(frame(spark, items), test, ["id"]))
    keys = {i: k for i, k, _ in items}
    assert found and all(sorted(keys[i] for i in s) == ["a", "b", "c"] for s in found)


def test_weights_of_both_signs(spark):
    items = [(i, "k", w) for i, w in enumerate([4, -1, 3, -2, 4, 0])]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 7), ["id"])
    assert sets_of(res) == py_ddmin_all(items, 7)


def test_a_splitter(spark):
    items = [(i, "k", 10 if i in (2, 5) else 1) for i in range(8)]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 10), ["id"], split=lambda d, n: F.pmod(F.col("idx"), F.lit(n)))
    assert sets_of(res) == [[2], [5]]
    assert {(r["hi"] - r["lo"]) for r in res.ranges.collect()} == {1}


def test_what_it_does_not_take(spark):
    with pytest.raises(TypeError):
        mz.minimize_all(frame(spark, [(0, "k", 1)]), CallableTest(lambda d: True), ["id"])
    assert mz.minimize_all(frame(spark, []), SumThreshold("trigram", "weight", 1), ["id"]).count == 0
    one = mz.minimize_all(frame(spark, [(7, "k", 3)]), SumThreshold("trigram", "weight", 1), ["id"])
    assert sets_of(one) == [[7]]
