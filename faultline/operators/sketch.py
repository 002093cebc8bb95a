"""Totals over a limit by sketch, then exactly.

To list the keys whose summed weight reaches a limit, a plain count shuffles
every distinct key.  Here a Count-Min sketch is summed first: each of ``depth``
rows has ``width`` cells, a key adds its weight to one cell of each row, and a
cell's sum is at least the total of any key in it.  Only cells that reach the
limit matter, and they are kept as one bit each: ``depth * width`` bits, whatever
the data.  Records of keys with a lighter cell are left out before the exact
count, which then shuffles candidates only.

The sketch is an ordinary grouped sum over cell numbers (Spark's
``count_min_sketch`` counts rows, while records have weights, and merges whole
sketches in one task); its shuffle is at most ``depth * width`` numbers from a
task.  Weights must not be negative: the sketch takes their minimum along, and
with a negative one (``None`` is returned) every key is a candidate.  Collisions
only add candidates; the exact count behind drops them.

At most ``total weight / limit`` cells of a row can be heavy, so a row prunes as
long as ``width`` is well above that; beyond, candidates approach all keys and
the result is still exact.  Too many cells cost, too: records of a task then no
longer share them before the shuffle.  Unless told, a sketch has one row of some
eight cells for every ``limit`` bytes that its scans are estimated to read, within
``FEWEST_BITS`` and ``MOST_BITS``.  The estimate decides the cost, not the rows.

Where even a cell for every ``limit`` bytes is beyond ``MOST_BITS`` (a low limit,
many bytes), bits would prune nothing.  Then there are that many cells, and the
heavy ones stay rows of a frame that records are joined with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import join_small, materialize, measured_bytes

FEWEST_BITS, MOST_BITS, DEPTH = 12, 20, 1
# bits of cells that are kept as rows
MOST_ROW_BITS = 30
# one row in so many is in the sample that guesses the largest totals, and so many keys are tried for each
_EACH, _GUESSES = 64, 64


def bits_for(rows: DataFrame, limit: int) -> int:
    """Bits of a cell number, from the estimated size of what ``rows`` are made of."""
    return max(FEWEST_BITS, min(MOST_BITS, (8 * scan_bytes(rows) // max(limit, 1)).bit_length()))


def scan_bytes(rows: DataFrame) -> int:
    """Estimated size of what ``rows`` are made of; Spark's default, which is beyond
    any data, where a part of it (rows in memory, a checkpoint) has no estimate."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _cells(key: Column, bits: int, depth: int) -> list[Column]:
    """One cell per row, all cut from one hash of the key (null is a key)."""
    if bits * depth > 64:
        raise ValueError("the cells of a key are cut from 64 bits")
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, bits * j).bitwiseAND(F.lit((1 << bits) - 1)).cast("long") for j in range(depth)]


@dataclass
class HeavyCells:
    """The cells that reach the limit: 64 to a word, ``words[j]`` for row j."""
    words: list[list[int]]
    bits: int

    @property
    def count(self) -> int:
        return sum((w & ((1 << 64) - 1)).bit_count() for row in self.words for w in row)

    def may_reach(self, key: Column) -> Column:
        """False where the key's total cannot reach the limit."""
        hit = F.lit(True)
        for row, cell in zip(self.words, _cells(key, self.bits, len(self.words)), strict=True):
            # one constant of fixed size
            word = F.get(F.from_json(F.lit(str(row)), "array<bigint>"), F.shiftright(cell, 6).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, cell.bitwiseAND(F.lit(63)).cast("int"))
            hit = hit & (bit.bitwiseAND(F.lit(1)) == 1)
        return hit


def heavy_cells(rows: DataFrame, key: str, weight: str, limit: int, bits: int | None = None, depth: int = DEPTH) -> HeavyCells | None:
    """One job over ``rows``; None if a weight is negative."""
    bits = bits_for(rows, limit) if bits is None else bits
    cells, w = _cells(F.col(key), bits, depth), F.col(weight).cast("long").alias("w")
    each = rows.select(F.lit(0).alias("j"), cells[0].alias("cell"), w) if depth == 1 else rows.select(F.posexplode(F.array(*cells)).alias("j", "cell"), w)
    sums = each.groupBy("j", "cell").agg(F.sum("w").alias("s"), F.min("w").alias("low")).where(f"s >= {int(limit)} OR low < 0")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(F.lit(63)).cast("int"))
    words = sums.groupBy("j", F.shiftright("cell", 6).alias("i")).agg(F.bit_or(bit).alias("word"), F.min("low").alias("low"))
    found = words.collect()  # at most depth * width / 64 rows
    if any(r["low"] is not None and r["low"] < 0 for r in found):
        return None
    out = [[0] * (((1 << bits) + 63) // 64) for _ in range(depth)]
    for r in found:
        out[r["j"]][r["i"]] = r["word"]
    return HeavyCells(out, bits)


def heavy_cell_rows(rows: DataFrame, key: str, weight: str, limit: int, bits: int) -> tuple[DataFrame, int] | None:
    """``(cell)`` of the cells that reach the limit, kept, and their measured bytes;
    None if a weight is negative."""
    sums = rows.select(_cells(F.col(key), bits, 1)[0].alias("cell"), F.col(weight).cast("long").alias("w")).groupBy("cell").agg(
        F.sum("w").alias("s"), F.min("w").alias("low")).where(f"s >= {int(limit)} OR low < 0")
    kept = materialize(sums.select("cell", (F.col("low") < 0).alias("negative")))
    n, negative = kept.agg(F.count(F.lit(1)), F.coalesce(F.max("negative"), F.lit(False))).first()
    return None if negative else (kept.select("cell"), 16 * n)


def _with_heavy_cells(rows: DataFrame, key: str, weight: str, limit: int, bits: int) -> DataFrame:
    found = heavy_cell_rows(rows, key, weight, limit, bits)
    if found is None:
        return rows
    return join_small(rows.withColumn("cell", _cells(F.col(key), bits, 1)[0]), found[0], "cell", "left_semi", found[1]).select(*rows.columns)


def candidate_rows(rows: DataFrame, key: str, weight: str, limit: int, bits: int | None = None, depth: int = DEPTH) -> DataFrame:
    """Rows whose key may reach ``limit``, among them all rows of every key that does."""
    if limit <= 0:
        return rows
    if bits is None and depth == 1 and MOST_BITS < (cells := (scan_bytes(rows) // limit).bit_length()) <= MOST_ROW_BITS:
        return _with_heavy_cells(rows, key, weight, limit, cells)
    heavy = heavy_cells(rows, key, weight, limit, bits, depth)
    if heavy is None:
        return rows
    return rows.where(heavy.may_reach(F.col(key))) if heavy.count else rows.limit(0)


def totals_from(rows: DataFrame, limit: int, key: str = "trigram", weight: str = "weight", bits: int | None = None, depth: int = DEPTH) -> DataFrame:
    """``(key, total)`` of every key whose total is at least ``limit``, exactly."""
    some = candidate_rows(rows, key, weight, limit, bits, depth)
    return some.groupBy(key).agg(F.sum(weight).cast("long").alias("total")).where(F.col("total") >= limit)


def rows_of_largest(rows: DataFrame, n: int, sample_by: list[str], key: str = "trigram", weight: str = "weight") -> DataFrame:
    """Rows whose key may be among the ``n`` with the largest totals, among them all
    rows of each that is (and of every key that ties with the last).

    The totals of any ``n`` keys bound the last of the largest from below.  The keys
    that are largest in a sample (one row in ``_EACH`` by a hash of ``sample_by``),
    ``_GUESSES`` times as many, are counted exactly, and the ``n``-th of them is the
    limit of ``candidate_rows``.  The sample decides the cost, not the rows."""
    some = rows.where(F.pmod(F.xxhash64(*sample_by), F.lit(_EACH)) == 0).groupBy(key).agg(F.sum(weight).alias("_t"))
    keys = materialize(some.orderBy(F.desc("_t"), key).limit(n * _GUESSES).select(F.struct(key).alias("_k")))
    counted = join_small(rows.withColumn("_k", F.struct(key)), keys, "_k", "left_semi", measured_bytes(keys.select("_k.*")))
    totals = counted.groupBy("_k").agg(F.sum(weight).alias("_t")).orderBy(F.desc("_t")).limit(n)
    found, least = totals.agg(F.count("_t"), F.min("_t")).first()
    # too few keys in the sample bound nothing
    return candidate_rows(rows, key, weight, int(least)) if found == n else rows
