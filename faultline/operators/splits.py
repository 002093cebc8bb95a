"""Sums of every part on every halving level, from one row per candidate row
(D1, D2).

A range is halved again and again: ``[lo, hi)`` becomes ``[lo, mid)`` and
``[mid, hi)``.  Per key the rows stand in order of ``idx``; a row and the row
before it share a part down to the level where a middle falls between them.  The
table holds, per row, that level, the part that is cut there and the key's sum up
to the row.  So a part's sum is cut in two by the one row that the next level
holds for it::

    left = (sum up to that row) - (sum up to the part),  right = part - left

and where the level holds none, the whole part lies on one side.  A level is a
folder of its own, so a search reads every row at most once over all its levels,
and the rows of a level only for keys and parts that are left.  Weights of any
sign will do.

The table is written to the checkpoint folder and removed by ``close``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import checkpoint_dir, remove_folder

# a key's rows are ordered in so many blocks of the index
_BLOCKS = 1024


def _cut(before: Column, at: Column, lo: Column, hi: Column, levels: int) -> Column:
    """The level at which the two positions of ``[lo, hi)`` part, and the start of
    the part that is cut there; level 0 while they never do."""
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(0).alias("depth"))

    def down(s, level):
        mid = s["lo"] + F.shiftright(s["hi"] - s["lo"] + 1, 1)
        first, second = before >= mid, at >= mid
        parted = s["depth"] > 0
        return F.struct(F.when(~parted & first & second, mid).otherwise(s["lo"]).alias("lo"),
                        F.when(~parted & ~first & ~second, mid).otherwise(s["hi"]).alias("hi"),
                        F.when(~parted & (first != second), level).otherwise(s["depth"]).cast("int").alias("depth"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(levels, 1))), start, down)


class SplitTable:
    """``rows`` is ``(idx, k, w)`` with positions in ``[lo, hi)`` and ``k`` a struct
    of one field, at most one row per key and position.  ``root_lo`` and ``root_hi``
    are the bounds of the part of an ``idx`` on level 0 (one part if not given)."""

    def __init__(self, rows: DataFrame, lo: int, hi: int, root_lo: Column | None = None, root_hi: Column | None = None):
        spark = rows.sparkSession
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
        self.depth = 0
        field = rows.schema["k"].dataType.fieldNames()[0]
        key = F.struct(F.col("k").getField(field).alias("key"))
        root_lo = F.lit(lo) if root_lo is None else root_lo
        root_hi = F.lit(hi) if root_hi is None else root_hi
        self.rows = rows.select("idx", key.alias("k"), "w", root_lo.cast("long").alias("part"), root_hi.cast("long").alias("hi"))
        width, levels = max(1, -(-(hi - lo) // _BLOCKS)), max(hi - lo - 1, 0).bit_length()
        rows = self.rows.withColumn("blk", F.expr(f"(idx - {int(lo)}L) DIV {width}L"))
        blocks = rows.groupBy("k", "blk").agg(F.sum("w").alias("sum"), F.max("idx").alias("last"))
        earlier = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("k", "blk", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum"), F.max("last").over(earlier).alias("last"))
        inside = Window.partitionBy("k", "blk").orderBy("idx")
        upto = inside.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select("*", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("_sum"), F.lag("idx").over(inside).alias("_last"))
        rows = rows.join(blocks, ["k", "blk"]).select(
            "k", "part", "hi", "idx", (F.col("sum") + F.col("_sum")).alias("upto"), F.coalesce("_last", "last").alias("before"))
        # a key's first row in a part of level 0 is no cut
        rows = rows.where(F.col("before") >= F.col("part"))
        rows = rows.withColumn("_cut", _cut(F.col("before"), F.col("idx"), F.col("part"), F.col("hi"), levels))
        rows = rows.select("k", F.col("_cut.lo").alias("part"), F.col("idx").alias("cut_idx"), "upto", F.col("_cut.depth").alias("depth"))
        self._schema = rows.schema
        rows.repartitionByRange("depth", "cut_idx").write.partitionBy("depth").parquet(self.path)

    def level(self, depth: int) -> DataFrame:
        """``(k, part, cut_idx, upto)``: the cuts that make the parts of a level."""
        table = self.spark.read.schema(self._schema).parquet(self.path)
        return table.where(F.col("depth") == depth).select("k", "part", "cut_idx", "upto")

    def roots(self) -> DataFrame:
        """``(part, hi, k, s, p, first)`` on level 0: the sum of a part, the key's
        sum before it and the key's first position in it."""
        sums = self.rows.groupBy("part", "hi", "k").agg(F.sum("w").alias("s"), F.min("idx").alias("first"))
        earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("part", "hi", "k", "s", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("p"), "first")

    def halve(self, sums: DataFrame) -> DataFrame:
        """The sums of the next level; a part of one item stays as it is."""
        self.depth += 1
        rows = sums.join(self.level(self.depth), ["k", "part"], "left").withColumn("mid", F.expr("part + (hi - part + 1) DIV 2"))

        def child(lo, hi, s, p, first):
            values = [(lo, "part"), (hi, "hi"), (s, "s"), (p, "p"), (first, "first")]
            return F.struct(*[F.expr(v).cast("long").alias(name) for v, name in values])

        halves = (F.when(F.col("hi") - F.col("part") == 1, F.array(child("part", "hi", "s", "p", "first")))
                  .when(F.col("cut_idx").isNotNull(), F.array(child("part", "mid", "upto - p", "p", "first"),
                                                              child("mid", "hi", "s - (upto - p)", "upto", "cut_idx")))
                  .when(F.col("first") < F.col("mid"), F.array(child("part", "mid", "s", "p", "first")))
                  .otherwise(F.array(child("mid", "hi", "s", "p", "first"))))
        return rows.select("k", F.explode(halves).alias("c")).select("c.part", "c.hi", "k", "c.s", "c.p", "c.first")

    def close(self) -> None:
        remove_folder(self.spark, self.path)

    def __enter__(self) -> SplitTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()
