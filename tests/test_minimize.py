"""ddmin: exact agreement with a plain-Python ddmin on small fixtures,
1-minimality by brute force, and the edge rows of FIXTURES.md."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.operators import minimize as mz
from faultline.operators import sets
from faultline.operators.oracles import CallableTest, SumThreshold, records_test
from faultline.operators.provenance import Trace
from faultline.operators.trigrams import WeightRule


# ---- plain-Python model of the same search --------------------------------
def py_fails(items, t):
    tot = defaultdict(int)
    for _, k, w in items:
        tot[k] += w
    return any(v >= t for v in tot.values())


def py_bounds(k, n, c):
    return (k * c + n - 1) // n, ((k + 1) * c + n - 1) // n


def halves(part):
    mid = (len(part) + 1) // 2
    return [part[:mid], part[mid:]] if len(part) > 1 else [part]


def flat(parts):
    return [x for p in parts for x in p]


def py_ddmin(items, t, min_items=1):
    """One test at a time; boundaries of parts are kept until they are halved.
    Returns (kept ids, [(outcome, n_items, n_parts)])."""
    log = []
    if not items or not py_fails(items, t):
        return [], [("pass", len(items), 2)]
    whole, parts = list(items), None
    while True:
        if parts is None:
            parts, n = halves(whole), 2
        c = len(flat(parts))
        if c <= min_items:
            log.append(("done", c, n))
            break
        hit = next((p for p in parts if py_fails(p, t)), None)
        if hit is not None and len(parts) > 1:
            log.append(("part", c, n))
            whole, parts = hit, None
            continue
        before, at, tried = len(parts), 0, 0
        while n > 2 and len(parts) > 2 and tried < len(parts):
            rest = parts[:at] + parts[at + 1:]
            if py_fails(flat(rest), t):
                parts, tried = rest, 0
            else:
                at, tried = at + 1, tried + 1
            at %= len(parts)
        if len(parts) < before:
            log.append(("complement", c, n))
            c, n = len(flat(parts)), len(parts)
        if c <= min_items or all(len(p) == 1 for p in parts):
            log.append(("done", c, n))
            break
        log.append(("refine", c, n))
        parts = [h for p in parts for h in halves(p)]
        n = len(parts)
    return [i for i, _, _ in flat(parts)], log


def rounds(res):
    return [(s.outcome, s.n_items, s.n_parts) for s in res.steps]


def frame(spark, items):
    return spark.createDataFrame(items, "id long, trigram string, weight long")


def run(spark, items, t, **kw):
    res = mz.ddmin(frame(spark, items), SumThreshold("trigram", "weight", t), ["id"], **kw)
    return sorted(r["id"] for r in res.items.collect()), res


# ---- FIXTURES rows -----------------------------------------------------------
def test_three_culprit_conjunction(spark):
    items = [(i, "k", 4000 if i in (5, 30, 61) else 1) for i in range(64)]
    got, res = run(spark, items, 12000)
    assert got == [5, 30, 61]
    assert rounds(res) == py_ddmin(items, 12000)[1]


def test_not_failing_input(spark):
    items = [(i, "k", 1) for i in range(20)]
    got, res = run(spark, items, 10000)
    assert got == [] and len(res.steps) == 1 and res.steps[0].outcome == "pass"
    assert res.history.count() == 1


def test_empty_input(spark):
    got, res = run(spark, [], 10)
    assert got == []


def test_single_heavy_record_fails_at_threshold(spark):
    # one record of 10000: fails the test (>= 10000)
    assert records_test().fails(frame(spark, [(0, "x", 10000)]))
    assert not records_test().fails(frame(spark, [(0, "x", 9999)]))


# ---- agreement with the plain model, and 1-minimality --------------------------
@pytest.mark.parametrize("seed", range(8))
def test_matches_python_model(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(5, 120)
    keys = ["a", "b", "c"][: rnd.randint(1, 3)]
    items = [(i, rnd.choice(keys), rnd.choice([0, 1, 1, 2, 3, 5])) for i in range(n)]
    t = max(3, sum(w for *_, w in items) // rnd.randint(2, 5))
    want_ids, want_steps = py_ddmin(items, t)
    got, res = run(spark, items, t)
    assert got == want_ids
    assert rounds(res) == want_steps
    if got:
        kept = [x for x in items if x[0] in set(got)]
        assert py_fails(kept, t)
        for drop in got:   # 1-minimal: no single removal still fails
            assert not py_fails([x for x in kept if x[0] != drop], t)


def test_negative_weights_keep_all_keys(spark):
    items = [(0, "a", 6), (1, "a", -3), (2, "a", 6), (3, "b", 1), (4, "a", -1)]
    want_ids, want_steps = py_ddmin(items, 10)
    got, res = run(spark, items, 10)
    assert got == want_ids and rounds(res) == want_steps


def test_min_items_stop(spark):
    items = [(i, "k", 10000 if i == 147 else 1) for i in range(143 + 50)]
    got, res = run(spark, items, 10000, min_items=10)
    assert 147 in got and len(got) <= 10
    assert got == py_ddmin(items, 10000, min_items=10)[0]


def test_opaque_test_and_custom_split(spark):
    items = [(i, "k", 4000 if i in (3, 17) else 1) for i in range(40)]
    df = frame(spark, items)

    def fails(d):
        return bool(d.agg(F.coalesce(F.sum("weight"), F.lit(0)) >= 8000).first()[0])

    res = mz.ddmin(df, CallableTest(fails), ["id"])
    assert sorted(r["id"] for r in res.items.collect()) == [3, 17]
    res2 = mz.ddmin(df, SumThreshold("trigram", "weight", 8000), ["id"],
                    split=lambda d, n: F.pmod(F.col("idx"), F.lit(n)))
    assert sorted(r["id"] for r in res2.items.collect()) == [3, 17]


def test_look_ahead_long_path(spark):
    # long "part" path: exercised by the look-ahead job
    n = 5000
    items = [(i, "k", 10000 if i == 3333 else 1) for i in range(n)]
    got, res = run(spark, items, 10000)
    assert got == [3333]
    assert rounds(res) == py_ddmin(items, 10000)[1]


def test_exhaustive_two_culprits(spark):
    items = [(i, "k", 10000 if i in (11, 40) else 1) for i in range(60)]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 10000), ["id"])
    sets_found = sorted(sorted(r["id"] for r in res.items.where(F.col("set_id") == s).collect())
                        for s in range(res.count))
    assert sets_found == [[11], [40]]


def test_part_test_matrix(spark):
    items = [(i, "k", 4000 if i in (1, 9) else 1) for i in range(12)]
    m = mz.part_test_matrix(frame(spark, items), SumThreshold("trigram", "weight", 8000), ["id"], 3)
    got = sorted((r["bucket"], r["n_items"], r["part_fails"], r["complement_fails"]) for r in m.collect())
    # parts [0,4) [4,8) [8,12): culprits 1 and 9 are in parts 0 and 2
    assert got == [(0, 4, False, False), (1, 4, False, True), (2, 4, False, False)]


def test_exhaustive_sets_are_failing_and_minimal(spark):
    # any two of {1, 5, 9} reach the threshold: several minimal sets exist
    items = [(i, "k", 5000 if i in (1, 5, 9) else 1) for i in range(16)]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 10000), ["id"])
    rows = res.items.collect()
    found = {}
    for r in rows:
        found.setdefault(r["set_id"], set()).add(r["id"])
    assert found
    by_id = {i: x for i, *_ in items for x in [next(y for y in items if y[0] == i)]}
    for ids in found.values():
        kept = [by_id[i] for i in ids]
        assert py_fails(kept, 10000)
        for drop in ids:
            assert not py_fails([x for x in kept if x[0] != drop], 10000)
        assert ids <= {1, 5, 9} and len(ids) == 2


def test_exhaustive_not_failing(spark):
    items = [(i, "k", 1) for i in range(10)]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 100), ["id"])
    assert res.items.count() == 0 and res.count == 0 and res.history.count() == 0


def py_ddmin_all(items, t, min_items=1):
    """Plain-Python exhaustive ddmin with deduplicated branch states."""
    ids = lambda xs: tuple(x[0] for x in xs)
    level = [(list(items), min(2, max(len(items), 2)), 0)]
    seen, results = {(ids(items), level[0][1])}, set()
    while level:
        nxt = []
        for cur, n, off in level:
            c = len(cur)
            if c <= min_items:
                results.add(ids(cur))
                continue
            if not py_fails(cur, t):
                continue
            parts = [cur[slice(*py_bounds(k, n, c))] for k in range(n)]
            pushed = [(p, 2, 0) for p in parts if py_fails(p, t)]
            if not pushed and n > 2:
                for i in range(n):
                    rest = [x for k, p in enumerate(parts) if k != i for x in p]
                    if py_fails(rest, t):
                        pushed.append((rest, min(max(n - 1, 2), max(len(rest), 2)), i))
            if not pushed:
                if n >= c:
                    results.add(ids(cur))
                else:
                    pushed.append((cur, min(c, 2 * n), off))
            for ch in pushed:
                key = (ids(ch[0]), ch[1])
                if key not in seen:
                    seen.add(key)
                    nxt.append(ch)
        level = nxt
    return sorted(sorted(r) for r in results)


@pytest.mark.parametrize("seed", range(1))
def test_exhaustive_matches_python_model(spark, seed):
    rnd = random.Random(100 + seed)
    n = rnd.randint(6, 24)
    heavy = set(rnd.sample(range(n), 3))
    items = [(i, "k", 5 if i in heavy else rnd.choice([0, 1])) for i in range(n)]
    t = 10
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", t), ["id"])
    got = {}
    for r in res.items.collect():
        got.setdefault(r["set_id"], []).append(r["id"])
    assert sorted(sorted(v) for v in got.values()) == py_ddmin_all(items, t)


@pytest.mark.parametrize("n_ranges", [1, 5, 3000])
def test_select_ranges(spark, n_ranges):
    rnd = random.Random(n_ranges)
    starts = sorted(rnd.sample(range(0, 200_000, 10), n_ranges))
    iv = [(s, s + rnd.randint(1, 9)) for s in starts] if n_ranges > 1 else [(5, 150_000)]
    df = spark.range(200_000).withColumnRenamed("id", "idx")
    got = sorted(r["idx"] for r in sets.select_ranges(df, mz._ranges(spark, iv)).collect())
    assert got == [i for a, b in iv for i in range(a, b)]


@pytest.mark.parametrize("seed", range(3))
def test_general_path_matches_model(spark, seed):
    rnd = random.Random(200 + seed)
    n = rnd.randint(8, 30)
    heavy = set(rnd.sample(range(n), rnd.randint(2, 3)))
    items = [(i, "k", 5 if i in heavy else rnd.choice([0, 1])) for i in range(n)]
    t = 5 * len(heavy)
    st = SumThreshold("trigram", "weight", t)
    res = mz.ddmin(frame(spark, items), CallableTest(st.fails), ["id"], test_concurrency=2)
    want_ids, want_steps = py_ddmin(items, t)
    assert sorted(r["id"] for r in res.items.collect()) == want_ids
    assert rounds(res) == want_steps


# ---- batched rounds --------------------------------------------------------------
@pytest.mark.parametrize("seed", range(12))
def test_sweeps_with_several_keys_match_model(spark, seed):
    # items hold one of several keys that stay over the threshold together for a while
    rnd = random.Random(300 + seed)
    n = rnd.randint(20, 90)
    items = [(i, rnd.choice("abcd"), rnd.choice([0, 0, 1, 2, 7])) for i in range(n)]
    t = max(2, sorted(sum(w for _, k, w in items if k == key) for key in "abcd")[1] - rnd.randint(0, 6))
    want_ids, want_steps = py_ddmin(items, t)
    got, res = run(spark, items, t)
    assert got == want_ids and rounds(res) == want_steps


def test_identical_keys_take_few_jobs(spark):
    # every item has two keys of the same weights: both survive every removal
    needed = set(random.Random(1).sample(range(300), 12))
    df = spark.createDataFrame([(i, 1000 if i in needed else 1) for i in range(300)], "id long, weight long")
    test = SumThreshold("trigram", "weight", 12_000, lambda d, carry: d.select(*carry, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("trigram"), "weight"))
    res = mz.ddmin(df, test, ["id"])
    assert sorted(r["id"] for r in res.items.collect()) == sorted(needed)
    assert res.steps[-1].job <= 2 * 9 + 10


def test_scattered_needed_items_take_few_jobs(spark):
    needed = set(random.Random(2).sample(range(1000), 10))
    items = [(i, "k", 1000 if i in needed else 1) for i in range(1000)]
    got, res = run(spark, items, 10_000)
    assert got == sorted(needed) and rounds(res) == py_ddmin(items, 10_000)[1]
    assert res.steps[-1].job <= 2 * 10 + 10


def test_many_needed_items(spark):
    needed = set(random.Random(3).sample(range(20_000), 2000))
    items = [(i, "k", 100_000 if i in needed else 1) for i in range(20_000)]
    got, res = run(spark, items, 200_000_000)
    assert got == sorted(needed) and res.steps[-1].job < 100


def test_null_key_is_a_key(spark):
    items = [(i, None, 100 if i == 5 else 1) for i in range(12)]
    assert run(spark, items, 100)[0] == [5]
    st = SumThreshold("trigram", "weight", 100)
    res = mz.ddmin(frame(spark, items), CallableTest(st.fails), ["id"])
    assert [r["id"] for r in res.items.collect()] == [5]
    two = [(i, None, 50 if i in (2, 9) else 0) for i in range(12)]
    assert run(spark, two, 100)[0] == [2, 9] == py_ddmin(two, 100)[0]
    m = mz.part_test_matrix(frame(spark, two), SumThreshold("trigram", "weight", 100), ["id"], 3)
    assert [r["complement_fails"] for r in m.orderBy("bucket").collect()] == [False, True, False]
    both = mz.minimize_all(frame(spark, two), SumThreshold("trigram", "weight", 100), ["id"])
    assert sorted(r["id"] for r in both.items.collect()) == [2, 9]


def test_history_gives_time_once_per_job(spark):
    _, res = run(spark, [(i, "k", 100 if i == 77 else 1) for i in range(200)], 100)
    by_job = {}
    for s in res.steps:
        by_job.setdefault(s.job, []).append(s.micros)
    assert all(m[0] > 0 and all(x is None for x in m[1:]) for m in by_job.values())
    assert [(r["round"], r["outcome"]) for r in res.history.orderBy("round").collect()] == [(s.round, s.outcome) for s in res.steps]


def test_opaque_test_is_called_one_at_a_time(spark):
    calls = []

    def fails(d):
        ids = sorted(r["id"] for r in d.collect())
        calls.append(ids)
        return 1 in ids
    res = mz.ddmin(spark.range(4).withColumn("x", F.lit(0)), CallableTest(fails), ["id"])
    assert [r["id"] for r in res.items.collect()] == [1]
    assert calls == [[0, 1, 2, 3], [0, 1], [0], [1]]


@pytest.mark.parametrize("seed", range(4))
def test_custom_splits_find_minimal_sets(spark, seed):
    rnd = random.Random(400 + seed)
    items = [(i, rnd.choice("ab"), rnd.choice([0, 1, 4])) for i in range(40)]
    t = sum(w for _, k, w in items if k == "a") * 2 // 3
    split = sets.random_split(seed) if seed % 2 else (lambda d, n: F.pmod(F.col("idx"), F.lit(n)))
    got, res = run(spark, items, t, split=split)
    kept = [x for x in items if x[0] in set(got)]
    assert py_fails(kept, t)
    if seed % 2 == 0:  # buckets of one item at the end: nothing more can go
        assert not any(py_fails([x for x in kept if x[0] != i], t) for i in got)


def test_scattered_records_through_a_group_index(spark):
    # a result of 5,000 scattered records: ranges are joined, not spelled out
    lines = spark.range(2500).select(F.col("id").alias("line_id"), F.lit("x").alias("line"))
    expand = lambda some: some.select("line_id", F.posexplode(F.array(*[F.lit(i) for i in range(4)])).alias("pos", "v"))
    index = sets.index_by_group(lines, F.lit(4), "line_id", "pos", expand)
    assert index.count == 10_000
    every_second = spark.range(5000).select((F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 1).alias("hi"))
    got = index.select(every_second)
    assert got.count() == 5000 and {r["pos"] for r in got.select("pos").distinct().collect()} == {0, 2}


def test_many_sets_in_one_plan(spark):
    items = [(i, f"k{i}" if i % 2 else "no", 10 if i % 2 else 0) for i in range(60)]
    res = mz.minimize_all(frame(spark, items), SumThreshold("trigram", "weight", 10), ["id"])
    assert res.count == 30
    assert "Union" not in res.items._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in res.items.collect()) == list(range(1, 60, 2))


def test_records_of_a_trace_are_numbered_without_a_sort(spark):
    words = lambda i: f"n{i}: " + " ".join(f"w{i % 5} w{j}" for j in range(i % 4 + 2)) + (" the 1996 Summer" if i % 3 == 0 else "")
    rows = [(i, words(i)) for i in range(40)]
    rule = WeightRule(doc_pattern="n21")
    columns = ["line_id", "pos", "trigram", "weight"]
    trace = lambda some: Trace(spark.createDataFrame(some, "line_id long, line string"), rule)
    index = trace(rows).forward_index(columns)
    assert isinstance(index, sets.GroupIndex)
    want = sets.index_items(trace(rows).forward_records().select(*columns), ["line_id", "pos"])
    assert index.count == want.count > 40
    assert sorted(index.indexed().collect()) == sorted(want.indexed().collect())
    found = [mz.ddmin(x.items, records_test(), ["line_id", "pos"], index=x) for x in (index, want)]
    assert rounds(found[0]) == rounds(found[1])
    assert [r["line_id"] for r in found[0].items.collect()] == [r["line_id"] for r in found[1].items.collect()] == [21]


def test_records_of_lines_that_share_an_id_are_sorted(spark):
    rows = [(i, f"n{i}: the 1996 Summer") for i in range(6)] + [(3, "n21: the 1996 Summer x")]
    trace = Trace(spark.createDataFrame(rows, "line_id long, line string"), WeightRule(doc_pattern="n21"))
    index = trace.forward_index(["line_id", "pos", "trigram", "weight"])
    assert isinstance(index, sets.ItemIndex)
    assert index.count == 8
