"""Delta debugging (ddmin): shrink a failing dataset to a 1-minimal failing
subset (D1-D5, X1-X2).

Items get a dense ``idx``; a part is a range of it.  Each round tests the
parts of the kept items and, if none fails, removes parts one after another as
long as what is left still fails (the complements); if nothing can go, every
part is halved.  Boundaries of parts are kept until they are halved.

Batched path (``SumThreshold`` with weights that are not negative): a key
whose total over *all* items is below the threshold can never make a subset
fail, so only rows ``(idx, key, weight)`` of the remaining keys are kept (exact,
and usually a tiny fraction).

* While a half fails, one job answers up to ``DEPTH`` rounds: each row is
  summed into its node on every halving level, and the failing nodes (at most
  ``2 ** (DEPTH + 1)``, whatever the data) are returned.
* Otherwise a round is the sums ``S(part, key)``, read from a table that holds
  the sums of all halving levels in one row per candidate row (``splits``): no
  level reads the rows of another.  Failing parts are
  ``S >= t``.  Removing parts in order is a *sweep*: a key can lose
  ``slack = total - t``; a part that every surviving key blocks (``S > slack``)
  stays, the others go until the running sums of all keys exceed their slack,
  and the part where the last of them does stays.  One step of the sweep is a
  windowed job over S; keys that fell below the threshold drop out.  A part
  that stayed never becomes removable later, so one sweep per level is the same
  as removing one part at a time.

Every null key is one key.  The driver receives counts and positions only.

With a custom splitter the same rounds run on buckets.  Tests whose states can
be merged (``merged.MergeTest``), and weights below zero, are batched, too, see
``merged``.  Opaque tests take the general path: one job per
tested part or complement, first failure wins, as in the reference.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import merged
from faultline.operators.exhaustive import ALL_HISTORY, AllResult, search_all
from faultline.operators.merged import MergeTest
from faultline.operators.oracles import CallableTest, SumThreshold
from faultline.operators.sets import GroupIndex, ItemIndex, contiguous_bucket, index_items, part_bounds
from faultline.operators.sketch import heavy_cells
from faultline.operators.splits import SplitTable
from faultline.session import MAX_BROADCAST_BYTES, join_small, materialize, measured_bytes, settle

HISTORY_SCHEMA = "round int, n_items long, n_parts int, outcome string, removed long, job int, micros long"
# halving rounds that one look-ahead job answers
DEPTH = 6
# a key's parts are summed in so many blocks of the index
_BLOCKS = 1024


@dataclass
class Step:
    """One round.  Rounds that one job answered share ``job``; its time stands
    at the first of them, ``micros`` of the others is None.  ``removed`` is the
    number of parts that a complement round removed."""
    round: int
    n_items: int
    n_parts: int
    outcome: str  # pass | part | complement | refine | done
    removed: int
    job: int
    micros: int | None


class _Log(list):
    def __init__(self):
        super().__init__()
        self.job, self.began, self.timed = 0, time.perf_counter(), True

    def next_job(self) -> None:
        self.job, self.began, self.timed = self.job + 1, time.perf_counter(), False

    def add(self, n_items: int, n_parts: int, outcome: str, removed: int = 0) -> None:
        micros = None if self.timed else int((time.perf_counter() - self.began) * 1e6)
        self.timed = True
        self.append(Step(len(self) + 1, n_items, n_parts, outcome, removed, self.job, micros))


@dataclass
class MinimizeResult:
    items: DataFrame          # the minimal failing subset, original columns
    history: DataFrame        # HISTORY_SCHEMA
    steps: list[Step]
    count: int


def _history(spark, steps):
    return spark.createDataFrame([(s.round, s.n_items, s.n_parts, s.outcome, s.removed, s.job, s.micros) for s in steps],
                                 HISTORY_SCHEMA)


def _ranges(spark, iv: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in iv], "lo long, hi long")


# ----------------------------------------------------------------------------
# batched path
@dataclass
class _Rows:
    """Candidate rows ``(idx, k, w)``; ``k`` is a struct, so that a null key joins."""
    df: DataFrame
    n_hot: int       # keys whose total reaches the threshold
    nonneg: bool


def _candidates(index: ItemIndex | GroupIndex, test: SumThreshold, max_bytes: int, every_sign: bool = False) -> _Rows:
    """Rows of the keys that can reach the threshold: those that a sketch of
    all weights leaves open, then those whose total does.  With a negative weight
    (``nonneg`` tells) a subset's total can be above that of all items, but not above
    the sum of the key's positive weights, which stands for it then; no rows unless
    ``every_sign``."""
    t = test.threshold
    raw = index.rows(test)
    positive = F.greatest(F.col("w"), F.lit(0))
    # a sketch has no use for limits that every key reaches
    heavy = heavy_cells(raw, "k", "w", max(t, 1))
    nonneg = heavy is not None
    if not nonneg:
        if not every_sign:
            return _Rows(raw.limit(0), 0, False)
        heavy = heavy_cells(raw.withColumn("w", positive), "k", "w", max(t, 1)) if t > 0 else None
    if t > 0:
        raw = raw.where(heavy.may_reach(F.col("k"))) if heavy.count else raw.limit(0)
    rows = materialize(index.attach(raw).groupBy("idx", "k").agg(F.sum("w").alias("w")))
    totals = rows.groupBy("k").agg(F.sum("w").alias("T"), F.sum(positive).alias("most"))
    if heavy is None:
        return _Rows(rows, totals.where(F.col("T") >= t).count(), False)
    hot = materialize(totals.where(F.col("T" if nonneg else "most") >= t).select("k", (F.col("T") >= t).alias("reaches")))
    rows = materialize(join_small(rows, hot.select("k"), "k", "left_semi", measured_bytes(hot.select("k.*")), max_bytes))
    return _Rows(rows, hot.where("reaches").count(), nonneg)


def _look_ahead(rows: DataFrame, lo: int, hi: int, t: int, min_items: int, log: _Log) -> tuple[int, int, str]:
    """Rounds with two parts, from one job: the range that is left, and
    ``part`` (go on), ``refine`` or ``done``."""
    log.next_job()
    start = F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(1).cast("long").alias("node"),
                     F.expr("cast(array() as array<bigint>)").alias("path"))

    def down(at, _):
        mid = at["lo"] + F.shiftright(at["hi"] - at["lo"] + 1, 1)
        right = F.col("idx") >= mid
        node = at["node"] * 2 + F.when(right, 1).otherwise(0)
        return F.struct(F.when(right, mid).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(mid).alias("hi"),
                        node.cast("long").alias("node"), F.concat(at["path"], F.array(node.cast("long"))).alias("path"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, down, lambda at: at["path"])
    nodes = rows.select(F.explode(path).alias("node"), "k", "w").groupBy("node", "k").agg(F.sum("w").alias("s"))
    failing = {r["node"] for r in nodes.where(F.col("s") >= t).select("node").distinct().collect()}
    node = 1
    for _ in range(DEPTH):
        size = hi - lo
        if size <= min_items or size < 2:
            break
        mid = lo + (size + 1) // 2
        if 2 * node in failing:
            hi, node = mid, 2 * node
        elif 2 * node + 1 in failing:
            lo, node = mid, 2 * node + 1
        elif size <= 2:
            log.add(size, 2, "done")
            return lo, hi, "done"
        else:
            log.add(size, 2, "refine")
            return lo, hi, "refine"
        log.add(size, 2, "part")
    return lo, hi, "part"


def _sweep(sums: DataFrame, t: int, count: int) -> DataFrame:
    """Remove parts in order while the rest still fails.  ``sums`` is
    ``(part, hi, k, s, ...)`` of parts that do not fail; the rows of the parts that
    stay, and of the keys that still reach ``t``, are returned."""
    columns = sums.columns
    sums = sums.withColumn("open", F.lit(True))
    width = max(1, -(-count // _BLOCKS))
    while True:
        totals = sums.groupBy("k").agg(F.sum("s").alias("T"), F.count_if("open").alias("o")).where(F.col("T") >= t)
        alive, n_open = totals.agg(F.count(F.lit(1)), F.sum("o")).first()
        rows = sums.join(totals.select("k", "T"), "k").withColumn("slack", F.col("T") - t)
        if not n_open:
            return materialize(rows.select(*columns))
        stuck = (rows.groupBy("part").agg(F.count_if(F.col("s") > F.col("slack")).alias("n")).where(F.col("n") == alive)
                 .select("part", F.lit(True).alias("stuck")))
        rows = rows.join(stuck, "part", "left").withColumn("free", F.col("open") & F.col("stuck").isNull())
        rows = rows.withColumn("blk", F.expr(f"part DIV {width}")).withColumn("loss", F.when(F.col("free"), F.col("s")).otherwise(0))
        blocks = rows.groupBy("k", "blk").agg(F.sum("loss").alias("loss"))
        earlier = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("k", "blk", F.coalesce(F.sum("loss").over(earlier), F.lit(0)).alias("before"))
        within = Window.partitionBy("k", "blk").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        run = F.col("before") + F.sum("loss").over(within)
        rows = materialize(rows.join(blocks, ["k", "blk"]).withColumn("run", run))
        ends = rows.groupBy("k").agg(F.min(F.when(F.col("free") & (F.col("run") > F.col("slack")), F.col("part"))).alias("end"))
        last, lasting = ends.agg(F.max("end"), F.count_if(F.col("end").isNull())).first()
        if lasting:  # some key outlasts the removal of every free part
            sums = rows.where(~F.col("free")).withColumn("open", F.lit(False))
        else:
            sums = rows.where(~F.col("free") | (F.col("part") >= last)).withColumn("open", F.col("free") & (F.col("part") > last))
        sums = sums.select(*columns, "open")


def _ddmin_ranges(index, rows: DataFrame, t: int, min_items: int, start_parts: int, log: _Log) -> DataFrame:
    """The kept ranges ``(lo, hi)`` of the index."""
    spark, count = rows.sparkSession, index.count
    lo, hi, c = 0, count, count
    n = min(max(2, start_parts), max(c, 2))
    while True:
        if c <= min_items:
            log.next_job()
            log.add(c, n, "done")
            return _ranges(spark, [(lo, hi)])
        if n > 2:
            b = contiguous_bucket("idx", n, c)
            edge = lambda k: F.floor((k * c + n - 1) / n)
            table, halvings = SplitTable(rows, lo, hi, edge(b), edge(b + 1)), 0
        else:
            a, b, outcome = _look_ahead(rows, lo, hi, t, min_items, log)
            if (a, b) != (lo, hi):
                rows = materialize(rows.where((F.col("idx") >= a) & (F.col("idx") < b)))
                lo, hi, c = a, b, b - a
            if outcome == "done":
                return _ranges(spark, [(lo, hi)])
            if outcome == "part":
                continue
            table, halvings, n = SplitTable(rows, lo, hi), 2, min(c, 4)
        with table:
            part, kept = _levels(table, halvings, t, min_items, c, n, count, log)
        if part is None:
            return kept
        lo, hi = part
        rows = materialize(rows.where((F.col("idx") >= lo) & (F.col("idx") < hi)).select("idx", "k", "w"))
        c, n = hi - lo, 2


def _levels(table: SplitTable, halvings: int, t: int, min_items: int, c: int, n: int, count: int,
            log: _Log) -> tuple[tuple[int, int] | None, DataFrame | None]:
    """Rounds on the parts of a level, then on their halves, from the written sums:
    the first part that fails alone, or else the ranges that are left at the end."""
    sums = table.roots()
    for _ in range(halvings):
        sums = table.halve(sums)
    while True:
        log.next_job()
        sums = settle(sums)
        part = sums.where(F.col("s") >= t).agg(F.min(F.struct("part", "hi"))).first()[0]
        if part is not None:
            log.add(c, n, "part")
            return (part["part"], part["hi"]), None
        kept = _sweep(sums, t, count)
        size = F.col("hi") - F.col("part")
        parts = kept.select("part", "hi").distinct()
        left, items, largest, large = parts.agg(F.count(F.lit(1)), F.sum(size), F.max(size), F.count_if(size > 1)).first()
        if left < n:
            log.add(c, n, "complement", n - left)
            c, n = items, left
        if c <= min_items or largest == 1:
            log.add(c, n, "done")
            return None, parts.select(F.col("part").alias("lo"), "hi")
        log.add(c, n, "refine")
        n = left + large
        sums = table.halve(kept)


def _ddmin_buckets(index, rows: DataFrame, t: int, split, min_items: int, start_parts: int, log: _Log) -> DataFrame:
    """The same rounds on the buckets of a custom splitter; the kept ``idx`` as ranges of one."""
    items = index.indexed()
    place = materialize(items.select("idx", F.col("idx").alias("cur")))
    c, n = index.count, min(max(2, start_parts), max(index.count, 2))
    while True:
        log.next_job()
        if c <= min_items:
            log.add(c, n, "done")
            break
        # the splitter sees a dense idx over the kept items
        seen = items.join(place, "idx").withColumnRenamed("idx", "_all").withColumnRenamed("cur", "idx")
        tagged = materialize(seen.select(F.col("_all").alias("idx"), split(seen, n).cast("long").alias("part")))
        used = tagged.select("part").distinct().count()
        sums = materialize(rows.join(tagged, "idx").groupBy("part", "k").agg(F.sum("w").alias("s")).withColumn("hi", F.col("part") + 1))
        first = sums.where(F.col("s") >= t).agg(F.min("part")).first()[0]
        keep = None
        if first is not None and used > 1:
            log.add(c, n, "part")
            keep, left = tagged.where(F.col("part") == first), 0
        elif first is None and used > 2:
            stay = _sweep(sums, t, n).select("part").distinct()
            left = stay.count()
            if left < used:
                log.add(c, n, "complement", used - left)
                keep, n = tagged.join(stay, "part", "left_semi"), left
        if keep is not None:
            numbered = index_items(keep.select(F.col("idx").alias("all")), ["all"])
            place, c = numbered.frame.select(F.col("all").alias("idx"), F.col("idx").alias("cur")), numbered.count
            if not left:
                n = min(2, max(c, 2))
                continue
        if c <= min_items or n >= c:
            log.add(c, n, "done")
            break
        log.add(c, n, "refine")
        n = min(c, 2 * n)
    return place.select(F.col("idx").alias("lo"), (F.col("idx") + 1).alias("hi"))


# ----------------------------------------------------------------------------
# general path
def _first_failing(order, fails, concurrency: int):
    """First element of ``order`` whose test fails.  With ``concurrency`` over
    1 tests run as concurrent Spark jobs in waves (in order): the answer is
    the same, and at most one wave is evaluated past it."""
    if concurrency <= 1:
        return next((i for i in order if fails(i)), None)
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        for start in range(0, len(order), concurrency):
            wave = order[start:start + concurrency]
            for i, bad in zip(wave, pool.map(fails, wave)):
                if bad:
                    return i
    return None


def _ddmin_general(index, test, split, min_items: int, start_parts: int, concurrency: int, log: _Log) -> DataFrame:
    """One test per part or complement; the driver lists the parts it tests."""
    cur, c = index.indexed(), index.count
    cols = [x for x in cur.columns if x != "idx"]
    log.next_job()
    n = min(max(2, start_parts), max(c, 2))
    if not c or not test.fails(cur.select(*cols)):
        log.add(c, n, "pass")
        return cur.limit(0).select(*cols)
    whole, parts = (0, c), None
    while True:
        log.next_job()
        if c <= min_items:
            log.add(c, n, "done")
            break
        if split is None:
            if parts is None:
                lo, hi = whole
                parts = [(lo + a, lo + b) for a, b in (part_bounds(k, n, c) for k in range(n))]
            sizes = {a: b - a for a, b in parts}
            # the part of an item: the last start at or below its idx
            starts = F.expr("array(" + ", ".join(f"{a}L" for a in sizes) + ")")
            tagged = materialize(cur.withColumn("_b", F.array_max(F.filter(starts, lambda a: a <= F.col("idx")))))
        else:
            tagged = materialize(cur.withColumn("_b", split(cur, n).cast("long")))
            sizes = {r["_b"]: r["n"] for r in tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
        order = sorted(sizes)
        hit = _first_failing(order, lambda p: test.fails(tagged.where(F.col("_b") == p).select(*cols)), concurrency) if len(order) > 1 else None
        if hit is not None:
            log.add(c, n, "part")
            cur, c, n, whole, parts = tagged.where(F.col("_b") == hit).drop("_b"), sizes[hit], 2, (hit, hit + sizes[hit]), None
        else:
            removed, at = [], 0
            while len(order) > 2:
                going = order[at:] + order[:at]
                hit = _first_failing(going, lambda p: test.fails(tagged.where(~F.col("_b").isin(*removed, p)).select(*cols)), concurrency)
                if hit is None:
                    break
                at = order.index(hit)
                order.remove(hit)
                removed.append(hit)
                at %= len(order)
            if removed:
                log.add(c, n, "complement", len(removed))
                cur = materialize(tagged.where(~F.col("_b").isin(*removed)).drop("_b"))
                c, n = c - sum(sizes[p] for p in removed), len(order)
            if c <= min_items or n >= c:
                log.add(c, n, "done")
                break
            log.add(c, n, "refine")
            if split is None:
                parts = [x for p in order for x in _halves(p, p + sizes[p])]
                n = len(parts)
            else:
                n = min(c, 2 * n)
        if split is not None:
            numbered = index_items(cur.withColumnRenamed("idx", "_all").select("_all"), ["_all"])
            cur = cur.withColumnRenamed("idx", "_all").join(numbered.frame, "_all").drop("_all")
    return cur.select(*cols)


def _halves(lo: int, hi: int) -> list[tuple[int, int]]:
    mid = lo + (hi - lo + 1) // 2
    return [(lo, mid), (mid, hi)] if hi - lo > 1 else [(lo, hi)]


# ----------------------------------------------------------------------------
def ddmin(items: DataFrame, test, order_by: list[str],
          split: Callable[[DataFrame, int], Column] | None = None,
          min_items: int = 1, start_parts: int = 2,
          max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
          index: ItemIndex | GroupIndex | None = None,
          test_concurrency: int = 1) -> MinimizeResult:
    """Minimal failing subset of ``items`` under ``test``.

    ``order_by`` fixes the item order; the columns must be unique (rows that
    share them would be taken for each other).  ``test`` is a ``SumThreshold``
    or a ``MergeTest`` (batched) or a ``CallableTest``/any object with
    ``fails(df) -> bool``.  ``split(items_with_idx, n) -> bucket Column``
    replaces the contiguous split (X2).  Stops at the first round that has
    ``min_items`` (1 or more) or fewer.  ``index`` supplies a ready index of the items
    (see ``sets.index_by_group``).  An opaque test is called once at a time
    unless ``test_concurrency`` asks for more.  Returns an empty DataFrame
    when the input does not fail.
    """
    if callable(test) and not hasattr(test, "fails"):
        test = CallableTest(test)
    if min_items < 1:
        raise ValueError("min_items must be 1 or more")
    spark, log = items.sparkSession, _Log()
    index = index if index is not None else index_items(items, order_by)
    rows = None
    if isinstance(test, SumThreshold) and test.threshold > 0:
        log.next_job()
        rows = _candidates(index, test, max_broadcast_bytes, every_sign=split is None)
        if rows.nonneg and (not rows.n_hot or not index.count):
            log.add(index.count, min(max(2, start_parts), max(index.count, 2)), "pass")
            return MinimizeResult(index.items.limit(0), _history(spark, log), log, 0)
    batched = merged.sum_test(test) if rows is not None and not rows.nonneg else test
    if isinstance(batched, MergeTest) and split is None:
        if rows is None:
            log.next_job()
            states = merged.candidate_states(index, batched)
        else:
            states = settle(rows.df.select("idx", "k", F.col("w").alias("s0")))
        if not index.count or batched.keys_that_hold(states) < batched.quorum:
            log.add(index.count, min(max(2, start_parts), max(index.count, 2)), "pass")
            return MinimizeResult(index.items.limit(0), _history(spark, log), log, 0)
        kept = materialize(merged.search(index, states, batched, min_items, start_parts, log))
        result = index.select(kept, ranges_bytes=measured_bytes(kept))
    elif rows is None or not rows.nonneg:
        log.clear()
        result = _ddmin_general(index, test, split, min_items, start_parts, test_concurrency, log)
    else:
        if split is None:
            kept = _ddmin_ranges(index, rows.df, test.threshold, min_items, start_parts, log)
        else:
            kept = _ddmin_buckets(index, rows.df, test.threshold, split, min_items, start_parts, log)
        kept = materialize(kept)
        result = index.select(kept, ranges_bytes=measured_bytes(kept))
    final = log[-1].n_items if log[-1].outcome == "done" else 0
    return MinimizeResult(result, _history(spark, log), log, final)


def minimize_all(items: DataFrame, test, order_by: list[str], min_items: int = 1, start_parts: int = 2,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                 split: Callable[[DataFrame, int], Column] | None = None,
                 index: ItemIndex | GroupIndex | None = None) -> AllResult:
    """Exhaustive ddmin (D3): follow every failing part (and, when no part
    fails, every failing complement) as its own branch; each distinct minimal
    set gets a ``set_id``.  ``test`` is a ``SumThreshold`` or a ``MergeTest``,
    ``split`` as in ``ddmin``; see ``exhaustive`` for how branches are kept."""
    if min_items < 1:
        raise ValueError("min_items must be 1 or more")
    if not isinstance(test, SumThreshold | MergeTest):
        raise TypeError("the exhaustive search takes a SumThreshold or a MergeTest")
    spark = items.sparkSession
    index = index if index is not None else index_items(items, order_by)
    if isinstance(test, SumThreshold):
        rows, batched = _candidates(index, test, max_broadcast_bytes, every_sign=True).df, merged.sum_test(test)
        states = rows.select("idx", "k", F.col("w").alias("s0"))
    else:
        batched, states = test, merged.candidate_states(index, test)
    if not index.count or batched.keys_that_hold(states) < batched.quorum:
        none = index.items.limit(0)
        ranges = spark.createDataFrame([], "set_id int, lo long, hi long")
        return AllResult(none.select(F.lit(0).alias("set_id"), *none.columns), ranges, 0, spark.createDataFrame([], ALL_HISTORY), [])
    return search_all(index, states, batched, min_items, start_parts, split, max_broadcast_bytes)


def part_test_matrix(items: DataFrame, test: SumThreshold, order_by: list[str], n: int,
                     max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Outcome of the test on every part and every complement of a
    contiguous ``n``-way split, from one grouped job.

    ``(bucket, n_items, part_fails, complement_fails)``, one row per part.
    """
    t = test.threshold
    index = index_items(items, order_by)
    rows, count = _candidates(index, test, max_broadcast_bytes, every_sign=True), index.count
    b = contiguous_bucket("idx", n, count)
    S = rows.df.groupBy(b.alias("bucket"), F.col("k")).agg(F.sum("w").alias("s"))
    # a key has n sums at most
    S = S.withColumn("T", F.sum("s").over(Window.partitionBy("k")))
    per_b = S.groupBy("bucket").agg(
        F.max(F.col("s") >= t).alias("_pf"),
        F.max(F.col("s") <= F.col("T") - t).alias("_cp"),
        F.sum(F.when((F.col("T") >= t) & (F.col("s") > F.col("T") - t), 1).otherwise(0)).alias("_blk"))
    size = (F.expr(f"((id + 1) * {int(count)} + {int(n) - 1}) DIV {int(n)}")
            - F.expr(f"(id * {int(count)} + {int(n) - 1}) DIV {int(n)}"))
    parts = items.sparkSession.range(n).select(F.col("id").alias("bucket"), size.alias("n_items"))
    out = parts.join(per_b, "bucket", "left")
    return out.select(
        "bucket", "n_items",
        F.coalesce(F.col("_pf"), F.lit(False)).alias("part_fails"),
        (F.coalesce(F.col("_cp"), F.lit(False)) | (F.coalesce(F.col("_blk"), F.lit(0)) < rows.n_hot))
        .alias("complement_fails"))
