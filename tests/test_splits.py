"""The split table against sums made anew on every level."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.operators import minimize as mz
from faultline.operators.oracles import SumThreshold
from faultline.operators.splits import SplitTable

SCHEMA = "idx long, k struct<key: string>, w long"


def halves(parts):
    return [x for lo, hi in parts for x in (((lo, lo + (hi - lo + 1) // 2), (lo + (hi - lo + 1) // 2, hi)) if hi - lo > 1 else ((lo, hi),))]


def plain(rows, parts):
    sums, first = defaultdict(int), {}
    for idx, (key,), w in sorted(rows, key=lambda r: r[0]):
        part = next(p for p in parts if p[0] <= idx < p[1])
        sums[part, key] += w
        first.setdefault((part, key), idx)
    return {(lo, hi, key, s, first[(lo, hi), key]) for ((lo, hi), key), s in sums.items()}


def seen(sums):
    return {(r["part"], r["hi"], r["k"][0], r["s"], r["first"]) for r in sums.collect()}


@pytest.mark.parametrize("lo,hi,n,density,seed", [(0, 37, 1, 0.6, 1), (100, 2300, 1, 0.1, 2), (0, 50, 7, 0.5, 3), (5, 6, 1, 1.0, 4), (0, 64, 1, 1.0, 5)])
def test_sums_of_every_level(spark, lo, hi, n, density, seed):
    rng = random.Random(seed)
    rows = [(i, (k,), rng.randint(-9, 9)) for i in range(lo, hi) for k in ("a", "b", None) if rng.random() < density]
    edges = [lo + (j * (hi - lo) + n - 1) // n for j in range(n + 1)]
    parts = list(zip(edges, edges[1:]))
    bounds = [F.element_at(F.array(*[F.lit(e) for e in edges]), 1 + F.expr(f"(idx - {lo}L) * {n} DIV {hi - lo}").cast("int") + j) for j in (0, 1)]
    with SplitTable(spark.createDataFrame(rows, SCHEMA), lo, hi, *bounds) as table:
        sums, read = table.roots(), 0
        assert seen(sums) == plain(rows, parts)
        while any(b - a > 1 for a, b in parts):
            parts = halves(parts)
            sums = table.halve(sums).checkpoint()
            read += table.level(table.depth).count()
            assert seen(sums) == plain(rows, parts)
        # a row stands on one level at most: all levels together read no more than the rows
        assert read <= len(rows)
        path = table.path.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_no_rows_and_one_row(spark):
    for rows in ([], [(3, (None,), 5)]):
        with SplitTable(spark.createDataFrame(rows, SCHEMA), 0, 8) as table:
            assert seen(table.halve(table.halve(table.roots()))) == plain(rows, halves(halves([(0, 8)])))


def test_keys_of_any_name_and_type(spark):
    rows = spark.sql("select id idx, named_struct('a b;,{}()=.', array(id % 2, null)) k, 1L w from range(9)")
    with SplitTable(rows, 0, 9) as table:
        got = {(r["part"], tuple(r["k"][0]), r["s"]) for r in table.halve(table.roots()).collect()}
    assert got == {(0, (0, None), 3), (0, (1, None), 2), (5, (0, None), 2), (5, (1, None), 2)}


def test_search_reads_a_row_once_after_the_first_job(spark, monkeypatch):
    """Three items needed together among 500: one table, its levels hold fewer rows than there are candidates."""
    made, read = [], []

    class Counted(SplitTable):
        def __init__(self, rows, *args):
            made.append(rows.count())
            super().__init__(rows, *args)

        def level(self, depth):
            out = super().level(depth)
            read.append(out.count())
            return out

    monkeypatch.setattr(mz, "SplitTable", Counted)
    items = spark.range(500).select("id", F.lit("x").alias("k"), F.when(F.col("id").isin(7, 250, 491), 1000).otherwise(1).alias("w"))
    res = mz.ddmin(items, SumThreshold("k", "w", 3000), ["id"])
    assert sorted(r["id"] for r in res.items.collect()) == [7, 250, 491]
    assert sum(read) <= made[0] and sum(made) < 2 * made[0]
    assert len(read) >= 8
