"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def keep_first(docs: DataFrame, grouped, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of ``docs``: that of the smallest (non-null) id.

    ``grouped(rows)`` returns the group of each row as ``_key, component,
    doc_id``.  Rows are told apart by a digest of id and text, so rows that
    share an id but not a text stay apart; of rows equal in both one stays."""
    null = F.lit("\0")
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), null), F.lit("\n"), F.coalesce(F.col(text).cast("string"), null)))
    rows = docs.withColumn("_key", key)
    first = grouped(rows).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    kept = rows.join(first.select("first._key"), "_key", "left_semi")
    one = Window.partitionBy("_key").orderBy("_key")
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*docs.columns)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    the queries also run where the executors do not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = os.path.join(tempfile.mkdtemp(prefix="faultline-"), "faultline.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "faultline")):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
