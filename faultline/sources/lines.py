"""Line sources and sinks.

A *lines* DataFrame has ``line_id bigint`` (a stable id, the provenance key)
and ``line string`` in the ``docName:contents`` form.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import NAME_SEPARATOR
from faultline.session import spread

# ---- fixed values of the test fixture (FIXTURES.md) -------------------------
# Every FIXTURE_INJECT_EVERY-th document (by doc_id) gets FIXTURE_PHRASE
# appended, so the faulty trigram occurs in many lines but is heavy in one.
FIXTURE_INJECT_EVERY = 7
FIXTURE_PHRASE = " the 1996 Summer"
# The document whose trigram is heavy: "src7:147" (source src{doc_id % 20}).
FIXTURE_FAULT_DOC = "src7:147"
FIXTURE_FAULT_DOCS_TWO = ("src7:147", "src14:154")
FIXTURE_FAULT_DOCS_THREE = ("src7:147", "src14:154", "src1:161")
# -----------------------------------------------------------------------------


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_lines(spark: SparkSession, path: str, folder: str, min_partitions: int | None = None) -> DataFrame:
    """Text files -> ``(line_id, line)``, one row per text line.

    Text files carry no line number, so ids are given once, in scan order, and
    written as Parquet to ``folder`` (one the caller names, kept as long as
    the ids are needed); what is returned is a scan of it, so that filters on
    the id reach the files.  ``min_partitions`` asks for that many splits at
    least, else ``spark.sql.files.maxPartitionBytes`` decides.
    """
    key, before = "spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None)
    if min_partitions:
        spark.conf.set(key, min_partitions)
    try:
        text = spark.read.text(path)
        text.select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line")).write.parquet(folder)
    finally:
        if min_partitions:
            spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.parquet(folder)


def null_lines(lines: DataFrame) -> DataFrame:
    """``(n_null)``: lines that are null and so give no tokens."""
    return lines.agg(F.count_if(F.col("line").isNull()).alias("n_null"))


def lines_from_table(df: DataFrame, id_col: str, name_cols: list[str], text_col: str) -> DataFrame:
    """Rows of a table -> ``(line_id, line)`` with ``line = name:...:text``.
    ``session.spread`` deals out a table that has too few row groups."""
    parts = [F.col(c).cast("string") for c in name_cols] + [F.col(text_col)]
    return df.select(F.col(id_col).cast("long").alias("line_id"),
                     F.concat_ws(NAME_SEPARATOR, *parts).alias("line"))


def fixture_lines(spark: SparkSession, sf_dir: str,
                  inject_every: int = FIXTURE_INJECT_EVERY,
                  phrase: str = FIXTURE_PHRASE) -> DataFrame:
    """The test fixture from ``documents``: ``source:doc_id:text`` plus
    ``phrase`` on every ``inject_every``-th document; ``line_id = doc_id``.
    All documents are kept.  ``spark.faultline.scanPartitions`` asks for a
    round-robin shuffle of the scan (the test tables have one row group)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    wanted = spark.conf.get("spark.faultline.scanPartitions", None)
    docs = spread(docs, int(wanted)) if wanted else docs
    line = F.concat(F.col("source"), F.lit(NAME_SEPARATOR), F.col("doc_id").cast("string"),
                    F.lit(NAME_SEPARATOR), F.col("text"),
                    F.when(F.col("doc_id") % inject_every == 0, F.lit(phrase)).otherwise(F.lit("")))
    return docs.select(F.col("doc_id").alias("line_id"), line.alias("line"))


def write_lines(lines: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                split_newlines: bool = False) -> None:
    """Sink for traced lines (S2).  ``fmt='text'`` writes one line per row: a
    row that holds a newline fails the job unless ``split_newlines`` lets it
    become several lines.  Parquet keeps rows whole."""
    if fmt == "text":
        line = F.col("line")
        if not split_newlines:
            line = F.when(line.rlike("[\n\r]"), F.raise_error(F.lit("a line holds a newline; write Parquet or pass split_newlines"))).otherwise(line)
        lines.select(line.cast("string").alias("line")).write.mode(mode).text(path)
    else:
        lines.write.mode(mode).format(fmt).save(path)
