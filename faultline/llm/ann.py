"""Approximate nearest neighbours with balanced posting lists.

Index: centroids are trained on a bounded sample (chosen by a hash of id and
vector, repeats once) and split until no list
holds far more than its share; every row then joins the list of its nearest
centroid and, near a boundary, of every centroid within ``replica_ratio`` of
that distance (at most ``MAX_REPLICAS`` lists).  Centroids are found by a
best-first walk over a navigable graph of them, held in memory.

Search: a query walks the same graph, and lists whose centroid lies within
``probe_ratio`` of the nearest one are read (at least ``LINKS``, and more while
those hold too few rows).  Lists and queries meet by a shuffle on (list, shard, query block): a
list longer than ``SHARD_ROWS``, say of one vector that repeats, is dealt over
shards, and many queries of one list over blocks.  Each group returns its best
``k`` per query in double precision; those are merged per query.  A query that
then has fewer than ``k`` distinct ids, say because its lists hold one id over
and over, is asked again of four times as many lists, until it has ``k`` or has
read all lists.

Nearness is the Euclidean distance; ties go to the smaller id.

Edge cases: vectors that are null, of another length than most, zero, or that
hold null or non-finite components take no part, nor do rows without an id;
rows that share an id count as one candidate, at its nearest; a query's own id
is no candidate; fewer than ``k`` candidates are all returned; an empty table
gives an empty result; other columns are ignored.

The driver holds the sample (``SAMPLE_BYTES`` at most) and the centroids
(``MAX_LISTS`` at most), whatever the number of rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SAMPLE_ROWS = 50_000
SAMPLE_BYTES = 32 << 20
LIST_ROWS = 800
MIN_LISTS, MAX_LISTS = 8, 4096
MAX_REPLICAS = 4
REPLICA_RATIO = 1.02
PROBE_RATIO = 1.15
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
LINKS = 12
_SEED = 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


class Graph(NamedTuple):
    """Centroids and, padded with -1, the neighbours of each."""
    points: np.ndarray
    links: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> Graph:
        """Each point is linked, both ways, with its nearest among those before it: always connected."""
        links: list[set[int]] = [set() for _ in points]
        for i in range(1, len(points)):
            for j in np.argsort(squared(points[i:i + 1], points[:i])[0], kind="stable")[:LINKS].tolist():
                links[i].add(j)
                links[j].add(i)
        table = np.full((len(points), max([1, *map(len, links)])), -1, dtype=np.int32)
        for i, own in enumerate(links):
            table[i, :len(own)] = sorted(own)
        return Graph(points, table)

    def near(self, vectors: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids that the walk met (infinite: not met).

        It goes on until all met within ``ratio`` of the nearest, and the
        ``LINKS`` nearest in any case, have been expanded."""
        n, k = len(vectors), len(self.points)
        rows = np.arange(n)
        dist = np.full((n, k), np.inf)
        dist[:, 0] = np.sqrt(squared(vectors, self.points[:1]))[:, 0]
        done = np.zeros((n, k), dtype=bool)
        while len(rows):
            open_ = np.where(done[rows], np.inf, dist[rows])
            at = open_.argmin(1)
            value = open_[np.arange(len(rows)), at]
            bound = np.maximum(dist[rows].min(1) * ratio, np.partition(dist[rows], min(LINKS, k - 1), axis=1)[:, min(LINKS, k - 1)])
            go = np.isfinite(value) & (value <= bound)
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            done[rows, at] = True
            linked = self.links[at]
            who, slot = np.nonzero((linked >= 0) & ~np.isfinite(dist[rows[:, None], np.maximum(linked, 0)]))
            new = linked[who, slot]
            dist[rows[who], new] = np.sqrt(((vectors[rows[who]] - self.points[new]) ** 2).sum(1))
        return dist


def train(sample: np.ndarray, lists: int) -> np.ndarray:
    """Balanced centroids: k-means, then lists of over twice their share are split in two, empty ones dropped."""
    rng = np.random.default_rng(_SEED)
    sample = np.unique(sample, axis=0)
    lists = min(lists, len(sample))

    def assign(points, centres):
        return np.concatenate([squared(points[i:i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])

    def refine(points, centres, rounds):
        for _ in range(rounds):
            own = assign(points, centres)
            counts = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            centres = (sums / np.maximum(counts, 1)[:, None])[counts > 0]
        return centres

    centres = refine(sample, sample[rng.choice(len(sample), lists, replace=False)], 6)
    for _ in range(4):
        own = assign(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        large = np.flatnonzero(counts > 2 * max(1, len(sample) / lists))
        if not len(large) or len(centres) + len(large) > 2 * lists:
            break
        parts = [np.delete(centres, large, axis=0)]
        for c in large:
            points = sample[own == c]
            parts.append(refine(points, points[rng.choice(len(points), 2, replace=False)], 4))
        centres = np.concatenate(parts)
    return centres


class Index(NamedTuple):
    graph: Graph
    rows: DataFrame  # id, vector, lists
    sizes: dict[int, int]  # rows of each list


def usable(rows: DataFrame, vec_id: str, vector: str, length: int | None = None) -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and the length of their vectors: ``length``, or the commonest."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & v.isNotNull()).where(finite)
    if length is not None:
        return rows.where(F.size("vector") == length), length
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("vector") == d), d


def build_index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", list_rows: int = LIST_ROWS,
                replica_ratio: float = REPLICA_RATIO) -> Index:
    rows, d = usable(rows, vec_id, vector)
    n = rows.count()
    bound = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(d, 1)))
    share = 1.0
    if n > bound:  # repeated rows count once, and one id is not chosen as a whole; a little less than the bound, as the count is approximate
        different = rows.agg(F.approx_count_distinct(F.xxhash64("id", "vector"), 0.02)).first()[0]
        share = min(1.0, 0.9 * bound / max(different, 1))
    chosen = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 20)) < share * (1 << 20))
    vectors = chosen.select(F.col("vector").cast("array<double>").alias("vector")).distinct()
    sample = [r.vector for r in itertools.islice(vectors.toLocalIterator(), bound)]
    if not sample and n:
        sample = [r.vector for r in rows.select(F.col("vector").cast("array<double>").alias("vector")).limit(1).collect()]
    centres = train(np.array(sample), max(MIN_LISTS, min(MAX_LISTS, n // list_rows))) if sample else np.zeros((0, 1))
    graph = Graph.build(centres)
    held = rows.sparkSession.sparkContext.broadcast(graph)

    @F.pandas_udf("array<int>")
    def lists_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 512):
                dist = held.value.near(np.stack(batch[at:at + 512].to_numpy()).astype(np.float64), replica_ratio)
                order = np.argsort(dist, axis=1, kind="stable")[:, :MAX_REPLICAS]
                near = np.take_along_axis(dist, order, 1)
                out += [o[v <= v[0] * replica_ratio].astype(np.int32) for o, v in zip(order, near, strict=True)]
            yield pd.Series(out)

    placed = checkpointed(rows.withColumn("lists", lists_of("vector")))
    sizes = placed.select(F.explode("lists").alias("list")).groupBy("list").count().collect()
    return Index(graph, placed, {r["list"]: r["count"] for r in sizes})


def search(index: Index, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
           probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """``query_id, rank`` (from 1)``, vec_id, score`` for the rows of ``queries``."""
    spark = queries.sparkSession
    points = index.graph.points
    queries, _ = usable(queries, vec_id, vector, points.shape[1] if len(points) else 0)
    sizes = np.zeros(len(index.graph.points), dtype=np.int64)
    for i, n in index.sizes.items():
        sizes[i] = n
    held = spark.sparkContext.broadcast((index.graph, sizes))

    @F.pandas_udf("array<int>")
    def probes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        graph, sizes = held.value
        for batch in batches:
            out = []
            for at in range(0, len(batch), 128):
                points = np.stack(batch[at:at + 128].to_numpy()).astype(np.float64)
                dist = graph.near(points, probe_ratio)
                order = np.argsort(dist, axis=1, kind="stable")
                for i, (o, v) in enumerate(zip(order, np.take_along_axis(dist, order, 1), strict=True)):
                    n = max(int((v <= v[0] * probe_ratio).sum()), min(LINKS, int(np.isfinite(v).sum())))
                    if sizes[o[:n]].sum() < (k + 1) * MAX_REPLICAS:  # too few rows: the next lists too
                        o = np.argsort(squared(points[i:i + 1], graph.points)[0], kind="stable")
                        n = max(n, 1 + int(np.searchsorted(np.cumsum(sizes[o]), (k + 1) * MAX_REPLICAS)))
                    out.append(o[:n].astype(np.int32))
            yield pd.Series(out)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        centres = held.value[0].points
        for batch, counts in batches:
            out = []
            for at in range(0, len(batch), 128):
                points = np.stack(batch[at:at + 128].to_numpy()).astype(np.float64)
                order = np.argsort(squared(points, centres), axis=1, kind="stable").astype(np.int32)
                out += [o[:n] for o, n in zip(order, counts[at:at + 128], strict=True)]
            yield pd.Series(out)

    def best_of(hits: DataFrame) -> DataFrame:
        each = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return checkpointed(each.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best")))

    asked = checkpointed(queries.withColumn("lists", probes("vector")))
    ranked = best_of(_meet(index, asked, k))
    while True:
        enough = ranked.where(F.size("best") >= k).select(F.col("query_id").alias("id"))
        short = asked.where(F.size("lists") < len(index.graph.points)).join(enough, "id", "left_anti")
        asked = checkpointed(short.withColumn("lists", nearest("vector", F.size("lists") * 4)))
        if asked.isEmpty():
            break
        hits = ranked.select("query_id", F.explode("best").alias("hit")).select("query_id", "hit.vec_id", "hit.score")
        ranked = best_of(hits.unionByName(_meet(index, asked, k)))
    return (ranked.select("query_id", F.posexplode("best").alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", "hit.score"))


def _meet(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of every group for the queries ``asked`` (``id, vector, lists``)."""
    id_type = index.rows.schema["id"].dataType.simpleString()
    asks = asked.select("id", "vector", F.explode("lists").alias("list"))
    per_list = {r["list"]: r["count"] for r in asks.groupBy("list").count().collect()}
    if not per_list:
        per_list, index = {0: 1}, index._replace(sizes={0: 1})
    count = lambda n, of: max(1, -(-n // of))
    shards = F.create_map(*[F.lit(x).cast("int") for i, n in index.sizes.items() for x in (i, count(n, SHARD_ROWS))])
    blocks = F.create_map(*[F.lit(x).cast("int") for i, n in per_list.items() for x in (i, count(n, BLOCK_QUERIES))])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    posts = (index.rows.select("id", "vector", F.explode("lists").alias("list")).where(blocks[F.col("list")].isNotNull())
             .withColumn("shard", F.pmod(F.xxhash64("id"), shards[F.col("list")]).cast("int")).withColumn("block", every(blocks[F.col("list")])))
    asks = (asks.where(shards[F.col("list")].isNotNull()).withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("list")]).cast("int"))
            .withColumn("shard", every(shards[F.col("list")])))

    def best(posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(posts) and len(asks):
            ids, x = posts["id"].to_numpy(), np.stack(posts["vector"].to_numpy()).astype(np.float64)
            repeated = posts["id"].duplicated().any()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at:at + 256]
                q = np.stack(part["vector"].to_numpy()).astype(np.float64)
                rough = squared(q, x)
                kth = np.partition(rough, min(k, len(ids) - 1), axis=1)[:, min(k, len(ids) - 1)]
                for i, own in enumerate(part["id"]):
                    bound = np.inf if repeated else kth[i] + 1e-6 * (1 + kth[i])  # rounding decides nothing
                    near = np.flatnonzero((rough[i] <= bound) & (ids != own))
                    score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    order = np.lexsort((ids[near], score))
                    if repeated:
                        order = order[~pd.Series(ids[near][order]).duplicated().to_numpy()]
                    order = order[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][order], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ("list", "shard", "block")
    return posts.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(best, f"query_id {id_type}, vec_id {id_type}, score double")
