"""Delta debugging with tests whose states can be merged (X1), batched.

A ``MergeTest`` folds the rows of a set of items into one small state a key, and
the states of two sets into that of their union.  So the states of n parts give
those of all n complements in one job: what stands before a part, merged with
what stands after it, by window functions.  Nothing is subtracted, so merges that
cannot be undone (largest value, any, bits) work like sums, and sums may have
weights of any sign.

The search is ddmin as in ``minimize``, one removed part after another in order,
round and round until no complement fails.  Which parts go is found without a job
per part: a job evaluates every part against a *guess* of the removals before it.
Up to the first part whose outcome differs from the guess, the guess is what the
one-by-one search does, and that part's outcome is right, too; the next guess
takes the outcomes just seen.  A pass without removal ends a level.  The result
is that of the one-by-one search for any test; the jobs of a level grow with the
number of wrong guesses, not with the number of parts.

Where a state is always that of one row (largest, smallest, any) and no rows do not
hold, a key of which no row holds never does, and its rows are left out: the keys of
the rows that hold are kept as bits of fixed size (``sketch``), in which a collision
only keeps rows that change nothing.

Windows run within one of 1024 blocks of the index and over the blocks, so a key
that every item has is not one group.  The driver gets counts and positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.sets import contiguous_bucket
from faultline.operators.sketch import MOST_BITS, heavy_cells
from faultline.session import settle

_BLOCKS = 1024


@dataclass(frozen=True)
class Monoid:
    """``add`` folds a column of values or states, ``merge`` two states; both
    must not depend on order.  ``zero`` is the state of no rows.  ``undo`` takes a
    state out of another, where that can be done.  ``one_of``: the state of rows is
    always that of one of them (or ``zero``)."""
    zero: object
    add: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    undo: Callable[[Column, Column], Column] | None = None
    one_of: bool = False


SUM = Monoid(0, F.sum, lambda a, b: a + b, lambda a, b: a - b)
LARGEST = Monoid(None, F.max, lambda a, b: F.greatest(a, b), one_of=True)
SMALLEST = Monoid(None, F.min, lambda a, b: F.least(a, b), one_of=True)
ANY = Monoid(False, F.bool_or, lambda a, b: a | b, one_of=True)
BITS = Monoid(0, F.bit_or, lambda a, b: a.bitwiseOR(b))


@dataclass
class MergeTest:
    """Fails iff at least ``quorum`` keys have a state that ``holds``.

    ``states``: name -> (monoid, column of the rows that it folds).  ``holds``
    gets the states by name and returns a boolean column (null: false).
    ``rows(items, carry)`` maps items to rows with the key and those columns, as
    in ``SumThreshold``; with none, an item is its own row."""
    key: str
    states: dict[str, tuple[Monoid, str]]
    holds: Callable[..., Column]
    quorum: int = 1
    rows: Callable[[DataFrame, list[str]], DataFrame] | None = None

    def __post_init__(self):
        if self.quorum < 1:
            raise ValueError("quorum must be 1 or more: no items must not fail")

    def state_rows(self, items: DataFrame, carry: list[str] = ()) -> DataFrame:
        """``(*carry, k, s0, s1, ...)`` of the items; ``k`` is a struct, so that a null key is a key."""
        made = items if self.rows is None else self.rows(items, list(carry))
        return made.select(*carry, F.struct(F.col(self.key)).alias("k"), *[F.col(c).alias(f"s{i}") for i, (_, c) in enumerate(self.states.values())])

    def fold(self, rows: DataFrame, *by) -> DataFrame:
        return rows.groupBy(*by).agg(*[m.add(F.col(f"s{i}")).alias(f"s{i}") for i, (m, _) in enumerate(self.states.values())])

    def holding(self, states: list[Column]) -> Column:
        return F.coalesce(self.holds(**dict(zip(self.states, states, strict=True))), F.lit(False))

    def holding_now(self) -> Column:
        return self.holding([F.col(f"s{i}") for i in range(len(self.states))])

    def keys_that_hold(self, rows: DataFrame) -> int:
        return self.fold(rows, "k").where(self.holding_now()).count()

    def fails(self, items: DataFrame) -> bool:
        return self.keys_that_hold(self.state_rows(items)) >= self.quorum


def sum_test(test) -> MergeTest:
    """A ``SumThreshold`` with weights of any sign."""
    def rows(items, carry):
        return test.item_rows(items, carry).withColumn(test.weight, F.col(test.weight).cast("long"))
    return MergeTest(test.key, {"total": (SUM, test.weight)}, lambda total: total >= test.threshold, 1, rows)


def _sides(rows: DataFrame, test: MergeTest, width: int, key: tuple[str, ...]) -> DataFrame:
    """Adds ``p0, p1, ...`` (what is kept before the part) and ``x0, x1, ...`` (all after it), within a key."""
    monoids = [m for m, _ in test.states.values()]
    rows = rows.withColumn("blk", F.expr(f"part DIV {width}L"))
    kept = [F.when(~F.col("go"), F.col(f"s{i}")) for i in range(len(monoids))]

    def around(frame, by, order, before, after, names):
        w = Window.partitionBy(*by).orderBy(order)
        earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        return frame.withColumns({f"{names[0]}{i}": m.add(before[i]).over(earlier) for i, m in enumerate(monoids)}
                                 | {f"{names[1]}{i}": m.add(after[i]).over(later) for i, m in enumerate(monoids)})

    blocks = rows.groupBy(*key, "blk").agg(*[m.add(kept[i]).alias(f"kept{i}") for i, m in enumerate(monoids)],
                                           *[m.add(F.col(f"s{i}")).alias(f"all{i}") for i, m in enumerate(monoids)])
    blocks = around(blocks, key, "blk", [F.col(f"kept{i}") for i in range(len(monoids))], [F.col(f"all{i}") for i in range(len(monoids))], ("bp", "bx"))
    rows = around(rows, [*key, "blk"], "part", kept, [F.col(f"s{i}") for i in range(len(monoids))], ("wp", "wx"))
    rows = rows.join(blocks.select(*key, "blk", *[f"{n}{i}" for n in ("bp", "bx") for i in range(len(monoids))]), [*key, "blk"])
    both = lambda m, a, b: m.merge(F.coalesce(F.col(a), F.lit(m.zero)), F.coalesce(F.col(b), F.lit(m.zero)))
    return rows.withColumns({f"p{i}": both(m, f"bp{i}", f"wp{i}") for i, m in enumerate(monoids)}
                            | {f"x{i}": both(m, f"bx{i}", f"wx{i}") for i, m in enumerate(monoids)})


def with_gain(rows: DataFrame, test: MergeTest, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``gain``: 1 if the key of a row (within ``by``) holds without the row's
    part only, -1 if it holds with it only, else 0; parts before it with ``go`` are gone."""
    monoids = [m for m, _ in test.states.values()]
    rows = _sides(rows, test, width, (*by, "k"))
    without = [m.merge(F.col(f"p{i}"), F.col(f"x{i}")) for i, m in enumerate(monoids)]
    whole = [m.merge(w, F.coalesce(F.col(f"s{i}"), F.lit(m.zero))) for i, (m, w) in enumerate(zip(monoids, without, strict=True))]
    return rows.withColumn("gain", test.holding(without).cast("long") - test.holding(whole).cast("long"))


def _outcomes(sums: DataFrame, flags: DataFrame, test: MergeTest, base: int, width: int) -> DataFrame:
    """``(part, go, fails)``: whether what is left fails without the part, when the parts before it with ``go`` are gone."""
    parts = with_gain(sums.join(flags, "part"), test, width).groupBy("part", "go").agg(F.sum("gain").alias("gain"))
    # keys that hold when a part is reached: those of the whole, changed by the parts that went before
    parts = parts.withColumn("blk", F.expr(f"part DIV {width}L")).withColumn("gone", F.when(F.col("go"), F.col("gain")).otherwise(0))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("blk").agg(F.sum("gone").alias("gone"))
    blocks = blocks.select("blk", F.coalesce(F.sum("gone").over(earlier(Window.orderBy("blk"))), F.lit(0)).alias("past"))
    here = F.coalesce(F.sum("gone").over(earlier(Window.partitionBy("blk").orderBy("part"))), F.lit(0))
    parts = parts.withColumn("here", here).join(blocks, "blk")
    return parts.select("part", "go", (F.col("past") + F.col("here") + F.col("gain") + base >= test.quorum).alias("fails"))


def remove_parts(sums: DataFrame, test: MergeTest, count: int) -> tuple[DataFrame, int]:
    """Remove parts one after another, in order and round and round, while the
    rest still fails.  ``sums`` is ``(part, hi, k, s0, ...)``; returned are the
    rows of the parts that stay, and the number of evaluations."""
    width, jobs = max(1, -(-count // _BLOCKS)), 0
    while True:
        base = test.keys_that_hold(sums)
        flags = sums.select("part").distinct().withColumn("go", F.lit(False))
        while True:
            seen = settle(_outcomes(sums, flags, test, base, width))
            jobs += 1
            first = seen.where("go <> fails").agg(F.min("part")).first()[0]
            if first is None:
                break
            flags = seen.select("part", F.when(F.col("part") < first, F.col("go")).otherwise(F.col("fails")).alias("go"))
        if not seen.where("go").count():
            return sums, jobs
        sums = settle(sums.join(seen.where("NOT go").select("part"), "part", "left_semi"))


def first_failing_part(sums: DataFrame, test: MergeTest):
    """``(part, hi)`` of the first part that fails by itself, or None."""
    bad = sums.where(test.holding_now()).groupBy("part", "hi").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {test.quorum}")
    return bad.agg(F.min(F.struct("part", "hi"))).first()[0]


def _of_keys_that_can_hold(raw: DataFrame, test: MergeTest) -> DataFrame:
    """The rows without those of keys that hold for no set of items, where that can be told."""
    monoids = [m for m, _ in test.states.values()]
    if len(monoids) > 1 or not monoids[0].one_of:
        return raw
    zero = F.lit(monoids[0].zero).cast(raw.schema["s0"].dataType)
    if raw.sparkSession.range(1).select(test.holding([zero])).first()[0]:
        return raw
    cells = heavy_cells(raw.where(test.holding_now()).select("k", F.lit(1).alias("one")), "k", "one", 1, MOST_BITS)
    return raw.where(cells.may_reach(F.col("k"))) if cells.count else raw.limit(0)


def candidate_states(index, test: MergeTest) -> DataFrame:
    """``(idx, k, s0, ...)`` of all items, without keys that can be told never to
    hold; with other merges any key can matter."""
    raw = _of_keys_that_can_hold(test.state_rows(index.items, index.keys), test)
    return settle(test.fold(index.attach(raw), "idx", "k"))


def halve(rows: DataFrame) -> DataFrame:
    """Every part ``[lo, hi)`` of two or more items becomes two."""
    mid, large = F.expr("lo + (hi - lo + 1) DIV 2"), F.col("hi") - F.col("lo") > 1
    right = large & (F.col("idx") >= mid)
    return rows.withColumns({"lo": F.when(right, mid).otherwise(F.col("lo")), "hi": F.when(large & ~right, mid).otherwise(F.col("hi"))})


def _within(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    return rows.withColumns({"lo": F.lit(lo).cast("long"), "hi": F.lit(hi).cast("long")})


def search(index, rows: DataFrame, test: MergeTest, min_items: int, start_parts: int, log) -> DataFrame:
    """The kept ranges ``(lo, hi)`` of the index; ``rows`` as of ``candidate_states``."""
    count = index.count
    lo, hi, c = 0, count, count
    n = min(max(2, start_parts), max(c, 2))
    if n > 2:
        b = contiguous_bucket("idx", n, c)
        edge = lambda k: F.floor((k * c + n - 1) / n).cast("long")
        rows = rows.withColumns({"lo": edge(b), "hi": edge(b + 1)})
    else:
        rows = halve(_within(rows, lo, hi))
    while True:
        log.next_job()
        if c <= min_items:
            log.add(c, n, "done")
            return _within(rows.sparkSession.range(1), lo, hi).select("lo", "hi")
        sums = settle(test.fold(rows.withColumnRenamed("lo", "part"), "part", "hi", "k"))
        part = first_failing_part(sums, test)
        if part is not None:
            log.add(c, n, "part")
            lo, hi = part["part"], part["hi"]
            c, n = hi - lo, 2
            rows = halve(_within(settle(rows.where(F.col("lo") == lo)), lo, hi))
            continue
        kept = remove_parts(sums, test, count)[0] if n > 2 else sums
        parts = kept.select("part", "hi").distinct()
        size = F.col("hi") - F.col("part")
        left, items, largest, large = parts.agg(F.count(F.lit(1)), F.sum(size), F.max(size), F.count_if(size > 1)).first()
        if left < n:
            log.add(c, n, "complement", n - left)
            c, n = items, left
        if c <= min_items or largest == 1:
            log.add(c, n, "done")
            return parts.select(F.col("part").alias("lo"), "hi")
        log.add(c, n, "refine")
        n = left + large
        rows = settle(halve(rows.join(parts.select(F.col("part").alias("lo")), "lo", "left_semi")))
