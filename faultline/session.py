"""Session helpers: building a session, the checkpoint folder, and
materialising intermediate results so long driver loops keep short plans.

Lineage is cut with reliable ``checkpoint()`` into the folder the cluster
names in ``spark.checkpoint.dir``.  Only when that setting is absent *and*
the master is local (tests, benches) is a private folder created.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Measured bytes up to which a join side gets a broadcast hint.  A side that
# is larger, or was not measured, is left to Spark (its own threshold, AQE).
MAX_BROADCAST_BYTES = 32 << 20


def build_session(master: str | None = None, app: str = "faultline",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with AQE on and the UI off.  Settings already present on a
    running session are left alone by ``getOrCreate``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Read from the session; create a private
    one only for a local master with nothing configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared (HDFS/S3/ABFS) folder is "
            "required on a cluster so that materialised steps survive executor loss")
    path = tempfile.mkdtemp(prefix="faultline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` (set by
    ``build_session``) Spark removes the files once the frame is unreachable."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """``materialize`` for loops: the frame also forgets the size estimate and the
    constraints of its plan.  A checkpoint keeps both, and where every round joins
    frames of the round before, estimates are multiplied until planning takes
    longer than the work."""
    spark, kept = df.sparkSession, materialize(df)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of written tables, wherever the path points."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def measured_bytes(df: DataFrame) -> int:
    """Size of a (materialised, narrow) frame: bytes of its texts plus 16 per value."""
    texts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    row = F.lit(16 * len(df.columns))
    for t in texts:
        row = row + t
    return int(df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0])


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left_semi", small_bytes: int | None = None,
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join with a broadcast hint on ``small`` when its measured size is within
    ``max_broadcast_bytes``; otherwise Spark plans the join (AQE splits skew).
    The rows are the same either way."""
    if small_bytes is not None and small_bytes <= max_broadcast_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal rows round robin over ``partitions``: for a table of few, large
    row groups, where the scan has too few splits.  A full shuffle, so it is
    done only where a caller asks for it."""
    return df.repartition(partitions)
