"""SimHash near-duplicates: exact links by a sharded vantage-point tree.

Fingerprint: texts are lower-cased (A-Z), cut into words at ASCII white space
and into shingles of ``shingle`` words (a shorter text is one shingle);
repeats count.  Bit i is 1 if it is set in over half of the shingles' XXH64
(seed 42).  A text without words has fingerprint 0.

Links: two fingerprints link at ``max_distance`` differing bits or fewer.

1. Equal fingerprints are one node, so copies cost one row.
2. A vantage-point tree is built on the driver from a sample of at most about
   ``SAMPLE`` nodes: a node of the tree splits by the distance to its vantage
   point.  Its leaves are the shards.
3. Every fingerprint goes home to one shard.  By the triangle bound a partner
   lies on the other side of a split only if the distance is within
   ``max_distance`` of the radius; such fingerprints also visit the inner side
   as guests (one direction is enough for a pair), and a guest goes on to
   every child that the bound does not exclude.
4. A shard goes on with the same split in memory and compares what is left.
   Where a split does not part the points (a dense ball of near copies), it
   compares them in blocks, or looks up all bit flips when that is less work.
   It returns a spanning forest of its links, never all pairs of a group.
5. The forests are joined to components in the cluster, by alternating large
   and small stars.

Edge cases: null and empty texts have fingerprint 0 and link with each other;
repeated rows are copies; a component's id is its smallest non-null id (null
if it has none); an empty table gives an empty result; extra columns are
ignored (``keep`` names those to return).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed

SAMPLE = 1 << 16
#: Fingerprints that a shard is meant to be home of, and sample points a leaf keeps at least.
SHARD_ROWS = 8192
LEAF_SAMPLE = 16
SEED = 42
_BRUTE = 1 << 16
_PAIRS = 1 << 22


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:min(n, at + (1 << 14))].tolist(), ends[at:at + (1 << 14)].tolist())], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Node(NamedTuple):
    point: int
    radius: int  # inner: distance <= radius
    inner: int | Node  # a shard or a node
    outer: int | Node


def _split(points: np.ndarray, rng, reach: int) -> tuple[int, int] | None:
    """Vantage point and radius with few points near the sphere for how evenly it parts them."""
    best, found = np.inf, None
    for p in rng.choice(points, min(12, len(points)), replace=False):
        counts = np.bincount(distance(points, p), minlength=65 + reach)
        below = np.cumsum(counts)
        for radius in range(64):
            share = below[radius] / len(points)
            if 0.1 <= share <= 0.9:
                near = counts[max(0, radius - reach + 1):radius + reach + 1].sum() / len(points)
                cost = (0.02 + near) / -(share * np.log(share) + (1 - share) * np.log(1 - share))
                if cost < best:
                    best, found = cost, (int(p), radius)
    return found


def build_tree(sample: np.ndarray, rows: int, reach: int) -> tuple[int | Node, int]:
    """A tree over a sample of ``rows`` fingerprints, and the number of its shards."""
    rng, shards = np.random.default_rng(SEED), [0]
    scale = rows / max(1, len(sample))

    def grow(points: np.ndarray) -> int | Node:
        found = _split(points, rng, reach) if len(points) * scale > SHARD_ROWS and len(points) >= 2 * LEAF_SAMPLE else None
        if found is None:
            shards[0] += 1
            return shards[0] - 1
        inner = distance(points, np.uint64(found[0])) <= found[1]
        return Node(*found, grow(points[inner]), grow(points[~inner]))

    return grow(sample), shards[0]


def route(tree: int | Node, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions, whether at home there)."""
    todo = [(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        d = distance(points[at], np.uint64(node.point)).astype(np.int64)
        inside = d <= node.radius
        inner, outer = (d <= node.radius + reach), np.where(home, ~inside, d + reach > node.radius)
        todo.append((node.inner, at[inner], (home & inside)[inner]))
        todo.append((node.outer, at[outer], home[outer]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as (node, smallest node of its component), for nodes that are not the smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def shard_links(home: np.ndarray, guests: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links home-home and home-guest."""
    rng, found, held = np.random.default_rng(SEED), [(np.empty(0, np.uint64),) * 2], [0]

    def add(a: np.ndarray, b: np.ndarray) -> None:
        found.append((a, b))
        held[0] += len(a)
        if held[0] > _PAIRS:
            found[:] = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
            held[0] = len(found[0][0])

    def compare(home: np.ndarray, guests: np.ndarray) -> None:
        others = np.concatenate((home, guests))
        flips = [sum(1 << b for b in bits) for k in range(1, reach + 1) for bits in combinations(range(64), k)]
        if len(home) > 16 * len(flips):
            ordered = np.sort(home)
            for flip in flips:
                other = others ^ np.uint64(flip)
                at = np.minimum(np.searchsorted(ordered, other), len(ordered) - 1)
                hit = ordered[at] == other
                add(others[hit], other[hit])
            return
        step = max(1, (1 << 22) // max(1, len(others)))
        for at in range(0, len(home), step):
            i, j = np.nonzero(distance(home[at:at + step, None], others[None]) <= reach)
            keep = j > i + at  # each pair once, no fingerprint with itself
            add(home[at:at + step][i[keep]], others[j[keep]])

    todo = [(home, guests)]
    while todo:
        home, guests = todo.pop()
        work = len(home) * (len(home) + len(guests))
        if work == 0:
            continue
        split = _split(home if len(home) < 512 else rng.choice(home, 512, replace=False), rng, reach) if work > _BRUTE and len(home) > 64 else None
        if split:
            point, radius = np.uint64(split[0]), split[1]
            d, g = distance(home, point).astype(np.int64), distance(guests, point).astype(np.int64)
            near = home[(d > radius) & (d <= radius + reach)]
            parts = [(home[d <= radius], np.concatenate((guests[g <= radius + reach], near))), (home[d > radius], guests[g + reach > radius])]
            if sum(len(h) * (len(h) + len(x)) for h, x in parts) < 0.9 * work:
                todo += parts
                continue
        compare(home, guests)
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links as ``node, root``: the smallest node of each linked node's
    component (the roots themselves are left out)."""
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    while True:
        ends = links.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("root", F.lit(0), F.lit(1)))
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if odd.isEmpty():
            return links
        # large star: larger neighbours go to the smallest neighbour
        both = links.union(links.select("root", "node")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("m").alias("root")),
                                                                 F.struct(F.col("node"), F.col("m").alias("root")))).alias("e"))
        links = checkpointed(small.select("e.node", "e.root").where("node <> root").distinct())


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text)))


def find_links(nodes: DataFrame, max_distance: int = 2) -> DataFrame:
    """``a, b``: links (a spanning forest per shard) between the distinct longs of ``nodes.fp``."""
    n = nodes.count()
    chosen = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    sample = np.sort(np.array([r.fp for r in chosen.select("fp").collect()], dtype=np.int64)).view(np.uint64)
    tree = nodes.sparkSession.sparkContext.broadcast(build_tree(sample, n, max_distance)[0])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64)
            for shard, at, home in route(tree.value, points.view(np.uint64), max_distance):
                yield pd.DataFrame({"shard": np.int32(shard), "fp": points[at], "home": home})

    def link(group: pd.DataFrame) -> pd.DataFrame:
        points, home = group["fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        a, b = shard_links(np.sort(points[home]), points[~home], max_distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = nodes.select("fp").mapInPandas(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_distance: int = 2,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id`` (smallest id)``,
    component`` (a fingerprint that names the component, also where ids repeat)
    and ``keep`` for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = checkpointed(fingerprints(rows, "text", shingle).drop("text"))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(find_links(nodes, max_distance))
    nodes = nodes.join(root, nodes.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(lowest, "root").select("fp", "component_id", "root")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return rows.join(named, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("root").alias("component"),
                                         *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
