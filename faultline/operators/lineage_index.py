"""Lineage kept as an index by output (L2, L3): written once, so that a later
trace reads the files of its outputs and no input.

The index is a Parquet table of the distinct edges ``(output, *ids)`` in order:
outputs are dealt over ``buckets`` folders by hash, and within a folder rows are
sorted by output, then by id.  Sorted ids and outputs are delta-coded by Parquet's
second page format (gaps of numbers, common beginnings of texts).  A trace opens
the folders of its outputs only; a few outputs are also given to the scan as a
filter, which skips row groups and pages by their bounds.

Edges are shuffled once: a folder's edges go to one task, and those of an output
that holds many of all edges are dealt by id over many tasks and files.  Such
outputs are found by counting the edges of one id in ``_EACH``; that count decides
where edges go, not which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import MAX_BROADCAST_BYTES, join_small, materialize, measured_bytes

BUCKETS = 1024
# outputs that are given to the scan as a filter; more are left to the join
_IN_FILTER = 256
# one id in so many is counted; an output of more than one in ``_HOT`` of their edges is dealt over ``_SHARES`` tasks
_EACH, _HOT, _SHARES = 64, 1024, 64


def _bucket(output: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(output)), F.lit(buckets)).cast("int")


def _hot_outputs(edges: DataFrame, output: str, ids: tuple[str, ...]) -> list:
    """Outputs that hold many of all edges, at most ``_HOT``."""
    some = edges.where(F.pmod(F.xxhash64(*ids), F.lit(_EACH)) == 0).groupBy(output).agg(F.count(F.lit(1)).alias("_n"))
    # fewer edges than that are no matter for one task
    some = materialize(some.where(F.col("_n") > _HOT))
    if some.isEmpty():
        return []
    counted = edges.where(F.pmod(F.xxhash64(*ids), F.lit(_EACH)) == 0).count()
    return [r[0] for r in some.where(F.col("_n") * _HOT > counted).select(output).collect()]


@dataclass
class LineageIndex:
    """``write`` makes it; ``LineageIndex(spark, folder, ...)`` opens it again."""
    spark: SparkSession
    folder: str
    output: str = "out_id"
    buckets: int = BUCKETS
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES

    @classmethod
    def write(cls, edges: DataFrame, folder: str, output: str = "out_id", ids: tuple[str, ...] = ("line_id",),
              buckets: int = BUCKETS) -> LineageIndex:
        """Write the distinct edges to ``folder``, which must not exist.  Null
        outputs and ids are kept like any other."""
        if buckets < 1:
            raise ValueError("buckets must be 1 or more")
        rows = edges.select(output, *ids).withColumn("_bucket", _bucket(output, buckets))
        # the places are columns, so that equal edges are told apart where they are
        places, hot = ["_bucket"], _hot_outputs(edges, output, ids)
        if hot:
            known = F.coalesce(F.col(output).isin([x for x in hot if x is not None]), F.lit(None in hot))
            rows = rows.withColumn("_share", F.when(known, F.pmod(F.xxhash64(*ids), F.lit(_SHARES))).otherwise(0).cast("int"))
            places.append("_share")
        rows = rows.repartition(*places).distinct().select(output, *ids, "_bucket")
        (rows.sortWithinPartitions("_bucket", output, *ids).write.partitionBy("_bucket")
         .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(folder))
        return cls(edges.sparkSession, folder, output, buckets)

    def edges(self) -> DataFrame:
        """All edges, as written."""
        return self.spark.read.parquet(self.folder).drop("_bucket")

    def back(self, outputs: DataFrame) -> DataFrame:
        """The edges of ``outputs`` (its output column; others are ignored, repeats
        count once).  At most ``buckets`` numbers and a few ids reach the driver."""
        wanted = materialize(outputs.select(self.output).distinct())
        size = measured_bytes(wanted)
        folders = [r[0] for r in wanted.select(_bucket(self.output, self.buckets)).distinct().collect()]
        edges = self.spark.read.parquet(self.folder).where(F.col("_bucket").isin(folders))
        few = [r[0] for r in wanted.take(_IN_FILTER + 1)]
        if len(few) <= _IN_FILTER:
            among = F.col(self.output).isin([x for x in few if x is not None])
            edges = edges.where(among | F.col(self.output).isNull() if None in few else among)
        edges = edges.drop("_bucket").withColumn("_id", F.struct(self.output))
        ids = wanted.select(F.struct(self.output).alias("_id"))
        return join_small(edges, ids, "_id", "left_semi", size, self.max_broadcast_bytes).drop("_id")

    def back_ids(self, outputs: DataFrame) -> DataFrame:
        """The distinct ids behind ``outputs``."""
        return self.back(outputs).drop(self.output).distinct()
