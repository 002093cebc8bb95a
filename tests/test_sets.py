"""Splits, indexing and set operations."""

import random

from pyspark.sql import functions as F

from faultline.operators import sets


def vals(df, col="v"):
    return sorted((r[col] for r in df.collect()), key=lambda x: (x is None, x))


def test_subtract_by_value(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",)], "v string")
    right = spark.createDataFrame([("a",)], "v string")
    assert vals(sets.subtract_by_value(left, right)) == ["b", "c", "c"]


def test_subtract_by_value_nulls(spark):
    left = spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "v string")
    right = spark.createDataFrame([(None,), ("a",)], "v string")
    assert vals(sets.subtract_by_value(left, right)) == ["b"]


def test_intersect_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",)], "v string")
    assert vals(sets.intersect_distinct(df, df)) == ["a", "b", "c"]


def test_index_items_dense_and_ordered(spark):
    ids = random.Random(1).sample(range(10_000), 777)
    df = spark.createDataFrame([(i, "wide") for i in ids], "k long, text string").repartition(7)
    index = sets.index_items(df, ["k"])
    assert index.count == 777 and index.frame.columns == ["k", "idx"]  # only the key is sorted and kept
    got = sorted((r["idx"], r["k"]) for r in index.frame.collect())
    assert [i for i, _ in got] == list(range(777))
    assert [k for _, k in got] == sorted(ids)
    assert index.indexed().where("idx = 5 and text = 'wide'").count() == 1
    assert sets.index_items(df.limit(0), ["k"]).count == 0


def test_contiguous_bucket_matches_bounds(spark):
    for count, n in [(5, 5), (143, 2), (143, 4), (1000, 7), (10, 3)]:
        df = spark.range(count).withColumnRenamed("id", "idx")
        got = {r["idx"]: r["b"] for r in df.select("idx", sets.contiguous_bucket("idx", n, count).alias("b")).collect()}
        for k in range(n):
            lo, hi = sets.part_bounds(k, n, count)
            assert all(got[i] == k for i in range(lo, hi))
        # every part non-empty, sizes differ by at most one
        sizes = [sets.part_bounds(k, n, count)[1] - sets.part_bounds(k, n, count)[0] for k in range(n)]
        assert sum(sizes) == count and max(sizes) - min(sizes) <= 1


def test_contiguous_bucket_large_values_exact(spark):
    count, n = 3 * 10**12, 10**7
    df = spark.createDataFrame([(count - 1,), (count // 2,)], "idx long")
    got = [r["b"] for r in df.select(sets.contiguous_bucket("idx", n, count).alias("b")).collect()]
    assert got == [((count - 1) * n) // count, ((count // 2) * n) // count]


def test_random_bucket_partitions_all_rows(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    b = sets.random_bucket(["k"], 4, 7)
    parts = sets.split_frames(df, b, 4)
    counts = [p.count() for p in parts]
    assert sum(counts) == 3000 and all(c > 500 for c in counts)
    # same seed, same answer; different partitioning, same answer
    again = df.repartition(5).select("k", b.alias("b")).collect()
    first = df.select("k", b.alias("b")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))


def test_complement_by_part(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    out = sets.complement_by_part(df, sets.contiguous_bucket("idx", 3, 10), 1)
    assert vals(out, "idx") == [0, 1, 2, 3, 7, 8, 9]


def test_index_by_group_equals_sorted_index(spark):
    rnd = random.Random(3)
    groups = spark.createDataFrame([(g, rnd.randint(0, 9)) for g in rnd.sample(range(500), 60)], "g long, n int").repartition(5)
    expand = lambda some: some.where("n > 0").select("g", F.explode(F.expr("sequence(0, n - 1)")).alias("p"))
    index = sets.index_by_group(groups, F.col("n"), "g", "p", expand)
    want = sets.index_items(expand(groups), ["g", "p"])
    assert index.count == want.count
    assert sorted(map(tuple, index.indexed().select("g", "p", "idx").collect())) == \
        sorted(map(tuple, want.frame.select("g", "p", "idx").collect()))


def test_hot_values_are_reduced_before_set_operations(spark):
    left = spark.createDataFrame([("a",)] * 50 + [("b",)], "v string")
    for out in (sets.subtract_by_value(left, left), sets.intersect_distinct(left, left)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        join = plan.index("Join")
        assert "Aggregate" in plan[join:]


def _exchanges(df):
    """Shuffles of a plan, none of them replaced by a broadcast."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = df.select("*")
        df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning")


def test_intersect_shuffles_each_side_once(spark):
    rng = random.Random(3)
    rows = lambda n: [(rng.choice([None, "", "a", "b", "c", "d"]), rng.choice([None, 1, 2])) for _ in range(n)]
    a, b = rows(60), rows(7)
    left, right = spark.createDataFrame(a, "v string, w int"), spark.createDataFrame(b, "x string, w int")
    key = lambda t: tuple((x is None, x) for x in t)
    both = sets.intersect_distinct(left, right)
    assert sorted((tuple(r) for r in both.collect()), key=key) == sorted(set(a) & set(b), key=key)
    assert both.columns == ["v", "w"] and dict(both.dtypes) == dict(left.dtypes)
    assert _exchanges(both) == 2


def test_subtract_shuffles_each_side_once(spark):
    rng = random.Random(5)
    rows = lambda n: [(rng.choice([None, "", "a", "b", "c", "d"]), rng.choice([None, 1, 2])) for _ in range(n)]
    a, b = rows(60), rows(7)
    left, right = spark.createDataFrame(a, "v string, w int"), spark.createDataFrame(b, "v string, w int")
    key = lambda t: tuple((x is None, x) for x in t)
    rest = sets.subtract_by_value(left, right)
    assert sorted((tuple(r) for r in rest.collect()), key=key) == sorted((r for r in a if r not in b), key=key)
    assert rest.columns == ["v", "w"] and dict(rest.dtypes) == dict(left.dtypes)
    assert _exchanges(rest) == 2
    by_v = sets.subtract_by_value(left, right, ["v"])
    assert sorted((tuple(r) for r in by_v.collect()), key=key) == sorted((r for r in a if r[0] not in {v for v, _ in b}), key=key)
