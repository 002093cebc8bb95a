"""Tests with states that merge: the batched search equals a one-by-one model for any test."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.operators import merged
from faultline.operators import minimize as mz
from faultline.operators.merged import ANY, BITS, LARGEST, SMALLEST, SUM, MergeTest
from faultline.operators.oracles import CallableTest, SumThreshold
from faultline.operators.sets import index_items

from test_minimize import flat, halves, py_ddmin


def model(items, fails, min_items=1):
    """ddmin, one test at a time, for any ``fails(list of items)``."""
    log = []
    if not items or not fails(items):
        return [], [("pass", len(items), 2)]
    whole, parts = list(items), None
    while True:
        if parts is None:
            parts, n = halves(whole), 2
        c = len(flat(parts))
        if c <= min_items:
            return [x[0] for x in flat(parts)], [*log, ("done", c, n)]
        hit = next((p for p in parts if fails(p)), None)
        if hit is not None and len(parts) > 1:
            log.append(("part", c, n))
            whole, parts = hit, None
            continue
        before, at, tried = len(parts), 0, 0
        while n > 2 and len(parts) > 2 and tried < len(parts):
            rest = parts[:at] + parts[at + 1:]
            if fails(flat(rest)):
                parts, tried = rest, 0
            else:
                at, tried = at + 1, tried + 1
            at %= len(parts)
        if len(parts) < before:
            log.append(("complement", c, n))
            c, n = len(flat(parts)), len(parts)
        if c <= min_items or all(len(p) == 1 for p in parts):
            return [x[0] for x in flat(parts)], [*log, ("done", c, n)]
        log.append(("refine", c, n))
        parts = [h for p in parts for h in halves(p)]
        n = len(parts)


def by_key(items):
    out = defaultdict(list)
    for _, k, w in items:
        out[k].append(w)
    return out.values()


#: name -> (test, the same on a list of items)
TESTS = {
    "spread": (lambda: MergeTest("k", {"top": (LARGEST, "w"), "low": (SMALLEST, "w")}, lambda top, low: top - low >= 7),
               lambda items: any(max(w) - min(w) >= 7 for w in by_key(items))),
    "distinct keys": (lambda: MergeTest("k", {"seen": (ANY, "yes")}, lambda seen: seen, quorum=3, rows=lambda d, carry: d.withColumn("yes", F.lit(True))),
                      lambda items: len({k for _, k, _ in items}) >= 3),
    "bits": (lambda: MergeTest("k", {"bits": (BITS, "bit")}, lambda bits: F.bit_count(bits) >= 4,
                               rows=lambda d, carry: d.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("w") + 5).cast("int")))),
             lambda items: any(len(set(w)) >= 4 for w in by_key(items))),
    # neither a subset nor a superset of a failing set need fail
    "sum within": (lambda: MergeTest("k", {"s": (SUM, "w")}, lambda s: s.between(9, 14), quorum=2),
                   lambda items: sum(9 <= sum(w) <= 14 for w in by_key(items)) >= 2),
    "odd": (lambda: MergeTest("k", {"n": (SUM, "one")}, lambda n: n % 2 == 1, quorum=3, rows=lambda d, carry: d.withColumn("one", F.lit(1))),
            lambda items: sum(len(w) % 2 for w in by_key(items)) >= 3),
}


def found(spark, items, test, **kw):
    df = spark.createDataFrame(items, "id long, k string, w long")
    res = mz.ddmin(df, test, ["id"], **kw)
    return sorted(r["id"] for r in res.items.collect()), [(s.outcome, s.n_items, s.n_parts) for s in res.steps]


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("name", TESTS)
def test_search_equals_the_model(spark, name, seed):
    rng = random.Random(f"{name}{seed}")
    test, fails = TESTS[name]
    items = []
    for _ in range(200):
        items = [(i, rng.choice(["a", "b", "c", "d", None]), rng.randint(-5, 5)) for i in range(rng.randint(6, 18))]
        if fails(items):
            break
    ids, steps = found(spark, items, test())
    assert (ids, steps) == model(items, fails)
    assert fails([x for x in items if x[0] in set(ids)])


@pytest.mark.parametrize("seed", range(2))
def test_weights_of_any_sign_equal_the_model(spark, seed):
    rng = random.Random(700 + seed)
    items = [(i, rng.choice("abc"), rng.choice([-4, -1, 0, 2, 3, 6])) for i in range(rng.randint(14, 24))]
    t = max(1, max(sum(w) for w in by_key(items)) - rng.randint(0, 5))
    df = spark.createDataFrame(items, "id long, trigram string, weight long")
    res = mz.ddmin(df, SumThreshold("trigram", "weight", t), ["id"])
    want, steps = py_ddmin(items, t)
    assert sorted(r["id"] for r in res.items.collect()) == want
    assert [(s.outcome, s.n_items, s.n_parts) for s in res.steps] == steps


def test_jobs_of_a_level_do_not_grow_with_its_parts(spark, monkeypatch):
    counted = []
    keep = merged.remove_parts

    def counting(*a):
        out = keep(*a)
        counted.append(out[1])
        return out
    monkeypatch.setattr(merged, "remove_parts", counting)
    needed = {37, 98}
    items = [(i, f"n{i}" if i in needed else "other", -1 if i % 3 else 1) for i in range(100)]
    test = MergeTest("k", {"seen": (ANY, "yes")}, lambda seen: seen, quorum=3, rows=lambda d, carry: d.withColumn("yes", F.lit(True)))
    ids, _ = found(spark, items, test)
    assert len(ids) == 3 and needed < set(ids)
    assert max(counted) <= 8  # guesses and a last pass, for up to 10 parts


def test_long_windows_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(merged, "_BLOCKS", 3)
    rng = random.Random(9)
    items = [(i, rng.choice("ab"), rng.choice([-2, 1, 3, 6])) for i in range(16)]
    test, fails = TESTS["spread"]
    assert fails(items) and found(spark, items, test()) == model(items, fails)


def test_merge_test_as_an_opaque_test(spark):
    items = [(i, "a" if i % 2 else "b", 9 if i in (3, 8) else i % 3) for i in range(14)]
    test, fails = TESTS["spread"]
    df = spark.createDataFrame(items, "id long, k string, w long")
    opaque = mz.ddmin(df, CallableTest(test().fails), ["id"])
    assert sorted(r["id"] for r in opaque.items.collect()) == found(spark, items, test())[0] == model(items, fails)[0]
    split = mz.ddmin(df, test(), ["id"], split=lambda d, n: F.pmod(F.col("idx"), F.lit(n)))
    kept = [x for x in items if x[0] in {r["id"] for r in split.items.collect()}]
    assert fails(kept)


def test_stop_size_parts_and_nothing_to_find(spark):
    test, fails = TESTS["distinct keys"]
    items = [(i, "abcde"[i % 5], 1) for i in range(20)]
    assert found(spark, items, test(), min_items=5) == model(items, fails, min_items=5)
    ids, _ = found(spark, items, test(), start_parts=7)
    assert fails([x for x in items if x[0] in ids]) and len(ids) == 3
    assert found(spark, items[:1], test()) == ([], [("pass", 1, 2)])
    assert found(spark, [], test())[0] == []
    with pytest.raises(ValueError):
        MergeTest("k", {"seen": (ANY, "w")}, lambda seen: seen, quorum=0)


@pytest.mark.parametrize("stop", [0, -3])
def test_stop_size_below_one_is_refused(spark, stop):
    df = spark.createDataFrame([(0, "k", 5), (1, "k", 1)], "id long, trigram string, weight long")
    with pytest.raises(ValueError):
        mz.ddmin(df, SumThreshold("trigram", "weight", 5), ["id"], min_items=stop)
    with pytest.raises(ValueError):
        mz.minimize_all(df, SumThreshold("trigram", "weight", 5), ["id"], min_items=stop)


def kept_keys(spark, monkeypatch, items, test, key="k"):
    """Keys of the rows that the search gets, and what is found."""
    keys, search = set(), merged.search

    def spy(index, rows, *a):
        keys.update(r[0][0] for r in rows.select("k").distinct().collect())
        return search(index, rows, *a)
    monkeypatch.setattr(merged, "search", spy)
    df = spark.createDataFrame(items, f"id long, {key} string, w long")
    res = mz.ddmin(df, test, ["id"])
    return keys, (sorted(r["id"] for r in res.items.collect()), [(s.outcome, s.n_items, s.n_parts) for s in res.steps])


@pytest.mark.parametrize("monoid, pick", [(LARGEST, max), (SMALLEST, min)])
def test_rows_of_keys_that_never_hold_are_left_out(spark, monkeypatch, monoid, pick):
    rng = random.Random(5)
    items = [(i, f"x{i % 40}", rng.choice([0, 1])) for i in range(120)]
    # two keys whose extreme is 3 in parts of the items only: 9 and -9 hide it
    for i, k, w in ((7, "a", 3), (30, "a", 3), (64, "a", 9), (65, "a", -9), (90, None, 3), (101, None, -9), (110, None, 9)):
        items[i] = (i, k, w)
    test = MergeTest("k", {"s": (monoid, "w")}, lambda s: s == 3)
    fails = lambda some: any(pick(w) == 3 for w in by_key(some))
    some = [x for x in items if x[2] != (9 if pick is max else -9)]
    keys, got = kept_keys(spark, monkeypatch, some, test)
    assert keys == {"a", None}
    assert fails(some) and got == model(some, fails)


def test_keys_that_hold_without_rows_are_kept(spark):
    items = [(i, "abcdef"[i % 6], i % 2) for i in range(18)]
    test = MergeTest("k", {"s": (ANY, "yes")}, lambda s: ~s, quorum=2, rows=lambda d, carry: d.withColumn("yes", F.col("w") == 1))
    index = index_items(spark.createDataFrame(items, "id long, k string, w long"), ["id"])
    assert {r[0][0] for r in merged.candidate_states(index, test).select("k").collect()} == set("abcdef")


def test_signed_weights_keep_keys_with_enough_positive_ones(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, f"x{i % 30}", rng.choice([-1, 0, 1])) for i in range(90)]
    for i, k, w in ((4, "a", 6), (33, "a", -5), (60, "a", 6), (75, "b", 4), (80, "b", -1)):
        items[i] = (i, k, w)
    df_test = SumThreshold("k", "w", 7)
    keys, got = kept_keys(spark, monkeypatch, items, df_test)
    assert keys == {"a"}
    want, steps = py_ddmin(items, 7)
    assert got == (want, steps)


def test_a_key_below_the_threshold_in_all_can_reach_it_in_a_part(spark, monkeypatch):
    items = [(i, "z" if i < 8 else "a", w) for i, w in enumerate([1, 1, 1, 1, 1, 1, 1, 1, -9, 5, 4, 0, -9, 0, 0, 1])]
    keys, got = kept_keys(spark, monkeypatch, items, SumThreshold("k", "w", 8))
    assert keys == {"z", "a"}  # "a" has 10 in positive weights and -8 in all
    assert got == py_ddmin(items, 8)
