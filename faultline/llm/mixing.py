"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a weight; together the sources get ``share`` times the words
of the table, by weight, but none more than ``most`` times its own words (what
is above goes to the others by weight).  Words are handed out in blocks:

1. Documents are put in seeded order within ``shards`` shards of their source,
   and the words of a shard, strung together, are cut into blocks of (nearly)
   ``block`` words, equal within the shard up to one word.
2. The blocks of the mix go to sources by highest quotients: the next block to
   the source with the largest ``votes / (2 * blocks so far + 1)``.  Votes are a
   source's target in its own blocks.  A source's blocks go to its shards in the
   same way, votes being their numbers of blocks, which gives an integer quota
   for each shard.
3. A quota of q blocks in a shard of m takes every block ``q DIV m`` times and
   ``q MOD m`` blocks, spread over the shard from a seeded place, once more.

Nothing depends on how rows are dealt over tasks: the order is a digest of seed,
id and number of words, and rows that are equal in those and their source are
kept as one with a count until the end.  Places in a shard come from two window
sums: over rows of a cell (a range of the digest, some thousand rows) and over
the cells of a shard.  Quotients are compared in double precision; ties go to
the source first by code point, and to the lower shard.

Bounds: the sources (one row each) are apportioned on the driver, at most
``MAX_SOURCES``; more is an error.  A source's shards are apportioned in one
task of ``shards`` rows.  A shard may hold 2**34 blocks.

Edge cases: a null text has no words; null sources are one source and come
last; null ids are ids; documents without words, and sources without any, take
nothing; a source of fewer words than a block has one block; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARDS, SEED = 32, 64, 11
MAX_SOURCES = 100_000
#: votes per block: targets in blocks are rounded to this part
_VOTES = 1 << 16
#: rows of a window group, about
_CELL = 4096
#: copies that one row is expanded into
_COPIES = 4096
#: steps from block to block, prime
_STEPS = (433494437, 514229)


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: int) -> list[float]:
    """Words of each source: ``share`` of all by weight, capped, the excess reshared by weight until none is above."""
    capped, level = set(), 0.0
    while sizes:
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        if not free:
            break
        level = (share * sum(sizes) - most * sum(sizes[i] for i in capped)) / free
        above = {i for i, w in enumerate(weights) if w * level > most * sizes[i]}
        if above <= capped:
            break
        capped |= above
    return [float(most * n) if i in capped else w * level for i, (n, w) in enumerate(zip(sizes, weights, strict=True))]


def highest_quotients(votes: Sequence[int], most: Sequence[int], seats: int) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest ``votes / (2 * seats so far + 1)``,
    ties to the first; none gets more than its ``most``.  Seats that everyone
    gets at a lower common divisor are given at once, the rest one by one."""
    total, count = sum(votes), len(votes)
    got = [0] * count
    if total and seats > count:
        got = [min(top, int(Fraction(v * (seats - count), total) + Fraction(1, 2))) for v, top in zip(votes, most, strict=True)]
    quotient = lambda i: (-(votes[i] / (2 * got[i] + 1)), i)
    heap = [quotient(i) for i in range(count) if votes[i] and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        i = heap[0][1]
        got[i] += 1
        if got[i] < most[i]:
            heapq.heapreplace(heap, quotient(i))
        else:
            heapq.heappop(heap)
    return got


def _digest(*parts: Column) -> Column:
    """60 bits of the md5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (1,), share: float = 1.0, most: int = 2, block: int = BLOCK, shards: int = SHARDS,
        seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, source, size, source_size, target, spans`` of every document.
    Sources, by code point and null last, have the weights in turn.  ``spans``
    is what the mix takes: words ``[first, last)`` of the document, ``times`` times."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.struct(F.col(source).alias("source")).alias("k"), words.alias("size"))
    rows = checkpointed(rows.groupBy("doc_id", "k", "size").agg(F.count(F.lit(1)).alias("copies")))
    cells = max(1, -(-rows.count() // (shards * _CELL)))
    placed = rows.withColumn("h", _digest(F.lit(seed), F.col("doc_id"), F.col("size"))).withColumns({
        "shard": F.expr(f"cast(h % {shards} as int)"), "place": F.expr(f"h DIV {shards}"), "all": F.expr("size * copies")})
    placed = placed.withColumn("cell", F.expr(f"shiftright((place DIV {(1 << 60) // shards >> 34}L) * {cells}L, 34)"))
    sums = checkpointed(placed.groupBy("k", "shard", "cell").agg(F.sum("all").alias("words")))
    parts = sums.groupBy("k", "shard").agg(F.sum("words").alias("words"))
    parts = parts.withColumn("blocks", F.expr(f"IF(words = 0, 0L, greatest(1L, (2 * words + {block}) DIV {2 * block}))"))

    per_source = parts.groupBy("k").agg(F.sum("words").alias("size"), F.sum("blocks").alias("blocks"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.k.source is None, (r.k.source or "").encode() if isinstance(r.k.source, str | None) else r.k.source))
    aims = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    votes = [int(t * r.blocks / r["size"] * _VOTES) if r["size"] else 0 for r, t in zip(found, aims, strict=True)]
    given = highest_quotients(votes, [most * r.blocks for r in found], (sum(votes) + _VOTES // 2) // _VOTES)
    plan = docs.sparkSession.createDataFrame(
        [(r.k, r["size"], t, g) for r, t, g in zip(found, aims, given, strict=True)],
        f"k {rows.schema['k'].dataType.simpleString()}, source_size long, target double, given long")

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        own = group["blocks"].tolist()
        group["quota"] = highest_quotients(own, [most * b for b in own], int(group["given"].iloc[0]))
        return group.drop(columns="given")

    kind = rows.schema["k"].dataType["source"].dataType.simpleString()
    shared = parts.join(plan, "k").select(F.col("k.source").alias("source"), "shard", F.col("words").alias("shard_words"), "blocks",
                                          "source_size", "target", "given")
    shared = checkpointed(shared.groupBy("source").applyInPandas(
        quotas, f"source {kind}, shard int, shard_words long, blocks long, source_size long, target double, quota long"))
    shared = shared.withColumn("k", F.struct("source")).drop("source")

    earlier = Window.partitionBy("k", "shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("cell_start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").join(shared, ["k", "shard"])
    within = Window.partitionBy("k", "shard", "cell").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("all").over(within), F.lit(0))).join(starts, ["k", "shard", "cell"])
    placed = placed.withColumn("at", F.col("cell_start") + F.col("before"))
    return _each_copy(placed).select("doc_id", "k.source", "size", "source_size", "target", _spans(seed).alias("spans"))


def _each_copy(rows: DataFrame) -> DataFrame:
    """Every copy as a row, at its own place; rows of many copies are expanded in several tasks."""
    one = rows.where(f"copies <= {_COPIES}").withColumn("from_copy", F.lit(0).cast("long"))
    many = rows.where(f"copies > {_COPIES}").withColumn("from_copy", F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)")))
    many = many.repartition("doc_id", "k", "size", "from_copy")
    last = F.expr(f"least(copies, from_copy + {_COPIES}) - 1")
    both = one.unionByName(many).withColumn("copy", F.explode(F.sequence("from_copy", last)))
    return both.withColumn("at", F.expr("at + copy * size"))


def _spans(seed: int) -> Column:
    """The taken words of a row: its blocks, cut at its ends, that are taken at all."""
    start = _digest(F.lit(seed), F.col("k.source"), F.col("shard"))
    # the first `wide` blocks have one word more than the others
    given = F.struct(F.expr("shard_words DIV blocks").alias("width"), F.expr("shard_words % blocks").alias("wide"),
                     F.expr("quota DIV blocks").alias("always"), F.expr("quota % blocks").alias("more"), (start % F.col("blocks")).alias("start"),
                     F.expr(f"CASE WHEN blocks % {_STEPS[0]} <> 0 OR blocks = 1 THEN {_STEPS[0]}L ELSE {_STEPS[1]}L END").alias("step"))
    div = lambda a, b: F.call_function("div", a, b)
    one = lambda g, at: F.when(at < g["wide"] * (g["width"] + 1), div(at, g["width"] + 1)).otherwise(
        g["wide"] + div(at - g["wide"] * (g["width"] + 1), F.greatest(g["width"], F.lit(1).cast("long"))))
    edge = lambda g, j: j * g["width"] + F.least(j, g["wide"])

    def spans(g: Column) -> Column:
        block = lambda j: F.struct(
            (F.greatest(edge(g, j), F.col("at")) - F.col("at")).alias("first"),
            (F.least(edge(g, j + 1), F.col("at") + F.col("size")) - F.col("at")).alias("last"),
            (g["always"] + F.when((j * g["step"] + g["start"]) % F.col("blocks") < g["more"], 1).otherwise(0)).alias("times"))
        touched = F.sequence(one(g, F.col("at")), one(g, F.col("at") + F.col("size") - 1))
        return F.filter(F.transform(touched, block), lambda s: s["times"] > 0)

    none = F.expr("cast(array() as array<struct<first:bigint,last:bigint,times:bigint>>)")
    return F.when((F.col("size") > 0) & (F.col("quota") > 0), F.transform(F.array(given), spans)[0]).otherwise(none)


def taken(spans: Column) -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]) * s["times"])
