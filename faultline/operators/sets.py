"""Item indexing, splits and set operations used by delta debugging.

* ``index_items`` gives every item a dense ``idx`` in ``0..count-1`` without
  funnelling rows through one task: a range-partitioned sort of the key
  columns alone, per-partition counts and their prefix offsets as a literal.
* Splits return a *bucket column*, so all parts live in one DataFrame and one
  grouped job can look at all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import join_small, materialize, measured_bytes

_LONG_MAX = (1 << 63) - 1
# index positions per block of a range join
_BLOCK = 1 << 16


def _offsets(per_part: list[tuple[int, int]]) -> Column:
    """Rows before each partition, looked up by the column ``_pid``: one
    number per partition goes through the driver."""
    sizes = dict(per_part)
    starts, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(i, 0)
    if not starts:
        return F.lit(0).cast("long")
    return F.element_at(F.expr("array(" + ", ".join(f"{x}L" for x in starts) + ")"), F.col("_pid") + 1)


@dataclass
class ItemIndex:
    """A dense index over items: ``frame`` holds ``(*key, idx)`` only."""
    items: DataFrame
    frame: DataFrame
    key: list[str]
    count: int

    @property
    def keys(self) -> list[str]:
        return self.key

    def rows(self, test) -> DataFrame:
        """``(*key, k, w)``: the test's rows; ``attach`` adds the idx to those that are kept."""
        return test.item_rows(self.items, self.key).select(
            *self.key, F.struct(F.col(test.key)).alias("k"), F.col(test.weight).cast("long").alias("w"))

    def attach(self, rows: DataFrame) -> DataFrame:
        return _null_safe_join(rows, self.frame, self.key)

    def frame_of_idx(self) -> DataFrame:
        return self.frame.select("idx")

    def indexed(self) -> DataFrame:
        """The items with ``idx``."""
        return _null_safe_join(self.items, self.frame, self.key)

    def select(self, ranges: DataFrame, extra: tuple[str, ...] = (), ranges_bytes: int | None = None) -> DataFrame:
        """The items whose idx lies in a range ``(lo, hi)`` of ``ranges``."""
        hit = select_ranges(self.frame, ranges, extra, ranges_bytes)
        return _null_safe_join(self.items, hit.drop("idx"), self.key).select(*extra, *self.items.columns)


@dataclass
class GroupIndex:
    """A dense index over records ``(group, pos)`` that ``expand`` makes from
    ``groups`` rows, kept as ``starts``: ``(group, _start, _n)``, one row per
    group.  Records are neither sorted nor written to be indexed."""
    groups: DataFrame
    expand: Callable[[DataFrame], DataFrame]
    starts: DataFrame
    group: str
    pos: str
    count: int

    @property
    def items(self) -> DataFrame:
        return self.expand(self.groups)

    @property
    def keys(self) -> list[str]:
        return [self.group, self.pos]

    def rows(self, test) -> DataFrame:
        return test.item_rows(self.items, [self.group, self.pos]).select(
            self.group, self.pos, F.struct(F.col(test.key)).alias("k"), F.col(test.weight).cast("long").alias("w"))

    def attach(self, rows: DataFrame) -> DataFrame:
        return (_null_safe_join(rows, self.starts, [self.group])
                .withColumn("idx", (F.col("_start") + F.col(self.pos)).cast("long")).drop("_start", "_n"))

    def frame_of_idx(self) -> DataFrame:
        return self.items.sparkSession.range(self.count).withColumnRenamed("id", "idx")

    def indexed(self) -> DataFrame:
        return self.attach(self.items)

    def select(self, ranges: DataFrame, extra: tuple[str, ...] = (), ranges_bytes: int | None = None) -> DataFrame:
        """Ranges are joined with the groups first, so that only groups with a
        wanted record are expanded."""
        some = self.starts.where(F.col("_n") > 0)
        spans = some.select(self.group, "_start", "_n", F.explode(F.sequence(
            F.expr(f"_start DIV {_BLOCK}"), F.expr(f"(_start + _n - 1) DIV {_BLOCK}"))).alias("_blk"))
        hit = join_small(spans, _blocks(ranges, extra), "_blk", "inner", ranges_bytes).where("_start < _hi AND _start + _n > _lo")
        hit = hit.select(self.group, *extra, (F.greatest("_lo", "_start") - F.col("_start")).alias("_from"),
                         (F.least("_hi", F.col("_start") + F.col("_n")) - F.col("_start")).alias("_to")).distinct()
        hit = materialize(hit)
        size = measured_bytes(hit)
        wanted = join_small(self.groups, hit.select(self.group).distinct(), self.group, "left_semi", size)
        items = self.expand(wanted)
        out = join_small(items, hit, self.group, "inner", size).where(f"`{self.pos}` >= _from AND `{self.pos}` < _to")
        return out.select(*extra, *items.columns)


def _null_safe_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    on = reduce(lambda a, b: a & b, [F.col(f"_l.`{c}`").eqNullSafe(F.col(f"_r.`{c}`")) for c in key])
    rest = [c for c in right.columns if c not in key]
    return left.alias("_l").join(right.alias("_r"), on).select(*[F.col(f"_l.`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`") for c in rest])


def _blocks(ranges: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return ranges.select(*extra, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(
        F.expr(f"lo DIV {_BLOCK}"), F.expr(f"(hi - 1) DIV {_BLOCK}"))).alias("_blk"))


def select_ranges(indexed: DataFrame, ranges: DataFrame, extra: tuple[str, ...] = (), ranges_bytes: int | None = None) -> DataFrame:
    """Rows of ``indexed`` whose ``idx`` lies in a (non-empty) range ``(lo, hi)``
    of ``ranges``, with the range's ``extra`` columns: an equi-join on blocks
    of the index, whatever the number of ranges."""
    joined = join_small(indexed.withColumn("_blk", F.expr(f"idx DIV {_BLOCK}")), _blocks(ranges, extra), "_blk", "inner", ranges_bytes)
    return joined.where("idx >= _lo AND idx < _hi").select(*indexed.columns, *extra)


def index_items(df: DataFrame, order_by: list[str]) -> ItemIndex:
    """Number the items densely by ``order_by``, which must be unique.

    Only those columns are sorted and written; other columns are joined back
    where they are needed.  One row per partition reaches the driver."""
    keys = df.select(*order_by).orderBy(*order_by)
    keys = materialize(keys.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")))
    per_part = [tuple(r) for r in keys.groupBy("_pid").agg(F.count(F.lit(1)), F.min("_mid")).collect()]
    first = {pid: m for pid, _, m in per_part}
    in_part = F.col("_mid") - F.element_at(F.expr("array(" + ", ".join(f"{first.get(i, 0)}L" for i in range(max(first, default=0) + 1)) + ")"),
                                           F.col("_pid") + 1)
    frame = keys.select(*order_by, (in_part + _offsets([(p, n) for p, n, _ in per_part])).cast("long").alias("idx"))
    return ItemIndex(df, frame, list(order_by), sum(n for _, n, _ in per_part))


def index_by_group(groups: DataFrame, sizes: Column, group: str, pos: str, expand: Callable[[DataFrame], DataFrame]) -> GroupIndex:
    """Number the records that ``expand(groups)`` makes, in (group, pos) order.

    ``sizes`` is the number of records of a group row (positions run from 0),
    so the index needs no record: one narrow row per group is range-partitioned
    and kept.  ``group`` must be unique in ``groups``."""
    ranged = materialize(groups.select(group, sizes.cast("long").alias("_n")).repartitionByRange(group)
                         .select("*", F.spark_partition_id().alias("_pid")))
    per_part = [(r[0], int(r[1] or 0)) for r in ranged.groupBy("_pid").agg(F.sum("_n")).collect()]
    before = Window.partitionBy("_pid").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.select(group, "_n", (_offsets(per_part) + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_start"))
    return GroupIndex(groups, expand, starts, group, pos, sum(n for _, n in per_part))


def contiguous_bucket(idx: str, n: int, count: int) -> Column:
    """Part of ``idx`` when ``0..count-1`` is cut into ``n`` contiguous ranges
    of (near) equal size: ``floor(idx * n / count)`` in exact integer
    arithmetic (K2).  Decimal is used when the product could overflow."""
    if count <= 0:
        return F.lit(0).cast("long")
    if (count - 1) * n <= _LONG_MAX:
        return F.expr(f"(`{idx}` * {int(n)}L) DIV {int(count)}L")
    return F.expr(f"CAST((CAST(`{idx}` AS DECIMAL(38,0)) * {int(n)}) DIV {int(count)} AS BIGINT)")


def part_bounds(k: int, n: int, count: int) -> tuple[int, int]:
    """``[lo, hi)`` of contiguous part ``k``: the idx with ``floor(idx*n/count) == k``."""
    lo = (k * count + n - 1) // n
    hi = ((k + 1) * count + n - 1) // n
    return lo, hi


def random_bucket(cols: list[str], n: int, seed: int) -> Column:
    """Seeded random part in ``0..n-1`` with equal probabilities (K1).

    Computed from a hash of the columns, so it does not depend on partitioning
    or task retries; parts may be empty, as with a random split.  The columns
    must be unique per item (such as ``idx``): rows equal in them share a part.
    """
    h = F.xxhash64(F.lit(int(seed)), *[F.col(c) for c in cols])
    u = (F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53))
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("long")


def random_split(seed: int) -> Callable[[DataFrame, int], Column]:
    """K1 as a splitter for ``ddmin``: a new assignment for every number of parts."""
    return lambda df, n: random_bucket(["idx"], n, seed + n)


def split_frames(df: DataFrame, bucket: Column, n: int) -> list[DataFrame]:
    """The parts as separate DataFrames (each a filter of one input)."""
    tagged = df.withColumn("_bucket", bucket)
    return [tagged.where(F.col("_bucket") == i).drop("_bucket") for i in range(n)]


def complement_by_part(df: DataFrame, bucket: Column, i: int) -> DataFrame:
    """Everything except part ``i``."""
    return df.where(bucket != i)


def subtract_by_value(left: DataFrame, right: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop every left row equal (null-safe) to some right row; left
    duplicates of surviving values are kept (U1, as RDD ``subtract``)."""
    cols = cols or left.columns
    types = [{f.name: (f.dataType, f.nullable) for f in df.schema} for df in (left, right)]
    if all(types[0][c][0] == types[1][c][0] for c in cols):
        # right values are shuffled for their distinct rows and stay there for the join
        nullable = {c for c in cols if types[0][c][1] or types[1][c][1]}
        # a value that many right rows share is one row after partial aggregation
        l, r = left.alias("_l"), _keyed(right, cols, nullable).distinct().alias("_r")
        key = lambda c: F.struct(F.col(f"_l.`{c}`").alias("v")) if c in nullable else F.col(f"_l.`{c}`")
        cond = reduce(lambda a, b: a & b, [key(c) == F.col(f"_r.k{i}") for i, c in enumerate(cols)])
    else:
        l, r = left.alias("_l"), right.select(*cols).distinct().alias("_r")
        cond = reduce(lambda a, b: a & b,
                      [F.col(f"_l.`{c}`").eqNullSafe(F.col(f"_r.`{c}`")) for c in cols])
    return l.join(r, cond, "left_anti").select([F.col(f"_l.`{c}`").alias(c) for c in left.columns])


def _keyed(df: DataFrame, columns: list[str], nullable: set[str]) -> DataFrame:
    """``columns`` as ``k0, k1, ...`` that equal each other as values do; a struct
    where a null may stand.  Such a key is grouped and joined by the same partitions,
    a null-safe condition would have both sides shuffled once more."""
    return df.select(*[(F.struct(F.col(f"`{c}`").alias("v")) if c in nullable else F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)])


def _unkeyed(df: DataFrame, columns: list[str], nullable: set[str]) -> DataFrame:
    return df.select(*[F.col(f"k{i}.v" if c in nullable else f"k{i}").alias(c) for i, c in enumerate(columns)])


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows present in both (U3).  Both sides are reduced to their
    distinct rows before they meet, and shuffled only for that."""
    if len(set(left.columns)) < len(left.columns) or [t for _, t in left.dtypes] != [t for _, t in right.dtypes]:
        return left.distinct().intersect(right.distinct())
    names, right = left.columns, right.toDF(*left.columns)
    nullable = {f.name for df in (left, right) for f in df.schema if f.nullable}
    both = _keyed(left, names, nullable).distinct().join(_keyed(right, names, nullable).distinct(), [f"k{i}" for i in range(len(names))])
    return _unkeyed(both, names, nullable)
