"""Text lines with ids from their place in the files.

A line's id is its file's number (files sorted by path) and the byte at which it
starts, so it depends on the files alone: not on split sizes, the order of the
scan, or an id column written beforehand.  Nothing is copied.

The bytes of a split's lines are added up in one pass (one row a split); the
running sum over a file's splits gives the byte at which each split's first line
starts.  In the second pass every split counts on from there, batch by batch.

Lines end with ``\\n``; a ``\\r`` before it is dropped, a lone one is no line end.
An id holds 23 bits of file number and 40 of offset: 8 million files of 1 TB.
Files must not change while ids are in use.  In compressed files (one split
each) offsets are those of the decompressed text, and ``lines_at`` cannot be used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.session import MAX_BROADCAST_BYTES, join_small, materialize, measured_bytes

OFFSET_BITS = 40
#: lines that ``lines_at`` fetches at most: they pass through the driver
MAX_LOOKUPS = 10_000
_BOM = b"\xef\xbb\xbf"


def _scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def line_starts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, number, start)``: of each split that holds a line, its
    file's number and the byte at which its first line starts."""
    sizes = _scan(spark, path).groupBy("file", "block").agg(F.sum(F.octet_length("value") + F.lit(1)).alias("bytes"))
    sizes = materialize(sizes)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    # one row a file
    numbers = sizes.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)
    return materialize(starts.join(numbers, "file"))


def read_lines_by_offset(spark: SparkSession, path: str | list[str], max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Text files -> ``(line_id, line)``, one row per text line."""
    starts = line_starts(spark, path)

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.add(pc.fill_null(batch.column("size"), 0), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            files, blocks = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
            # lines of a split follow each other; a task may have several
            same = pc.equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False) & (blocks[1:] == blocks[:-1])
            first = np.concatenate(([True], ~same.astype(bool)))
            before = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(sizes)), 0))
            offset = before - before[begin]
            here = (files[0].as_py(), int(blocks[0]))
            if here == split:
                offset[begin == 0] += at
            end = len(sizes) - 1
            split, at = (files[end].as_py(), int(blocks[end])), int(offset[end] + sizes[end])
            yield pa.RecordBatch.from_arrays([batch.column("value"), files, batch.column("block"), pa.array(offset)], names=["line", "file", "block", "offset"])

    lines = _scan(spark, path).select("value", F.octet_length("value").alias("size"), "file", "block")
    lines = lines.mapInArrow(count_on, "line string, file string, block long, offset long")
    lines = join_small(lines, starts, ["file", "block"], "inner", measured_bytes(starts), max_broadcast_bytes)
    line_id = F.shiftleft(F.col("number").cast("long"), OFFSET_BITS) + F.col("start") + F.col("offset")
    return lines.select(line_id.alias("line_id"), F.regexp_replace("line", "\r$", "").alias("line"))


def place_of(line_id: Column | str) -> Column:
    """``struct<number, offset>`` of an id."""
    line_id = F.col(line_id) if isinstance(line_id, str) else line_id
    return F.struct(F.shiftright(line_id, OFFSET_BITS).cast("int").alias("number"),
                    line_id.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)).alias("offset"))


def lines_at(spark: SparkSession, path: str | list[str], ids: DataFrame) -> list[tuple[int, str]]:
    """The lines of a few ids (``line_id``), each by a seek in its file; at most
    ``MAX_LOOKUPS`` (more are an error: join with the scan instead)."""
    wanted = [r["line_id"] for r in ids.select("line_id").distinct().limit(MAX_LOOKUPS + 1).collect()]
    if len(wanted) > MAX_LOOKUPS:
        raise ValueError(f"more than {MAX_LOOKUPS} lines to look up")
    files = sorted(r["file"] for r in _scan(spark, path).select("file").distinct().collect())
    hadoop, conf, out = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration(), []
    for line_id in sorted(wanted):
        number, offset = line_id >> OFFSET_BITS, line_id & ((1 << OFFSET_BITS) - 1)
        where = hadoop.fs.Path(spark._jvm.java.net.URI(files[number]))
        stream = where.getFileSystem(conf).open(where)
        try:
            stream.seek(0)
            if [stream.read() for _ in _BOM] == list(_BOM):  # which readers of lines skip
                offset += len(_BOM)
            stream.seek(offset)
            line = hadoop.io.Text()
            hadoop.util.LineReader(stream, conf, bytearray(b"\n")).readLine(line)
            out.append((line_id, line.toString().removesuffix("\r")))
        finally:
            stream.close()
    return out

