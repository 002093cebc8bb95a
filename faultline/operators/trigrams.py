"""Parsing lines, weighted word trigrams and their totals.

Every step is a projection, a ``posexplode`` or a hash aggregate with
partial (map-side) aggregation, so a trigram shared by a third of all lines
is pre-summed in every map task before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import (
    BAD_OUTPUT_LIMIT, FAULT_DOC, FAULT_TRIGRAM, HEAVY_WEIGHT, LIGHT_WEIGHT, TRIGRAM_SEPARATOR,
    WATCH_LIMIT, contents_of, doc_of, fault_weight, has_name, tokens_of, trigram_of, trigram_parts,
)
from faultline.operators.sketch import scan_bytes
from faultline.session import materialize


# lines whose names end alike are counted in one task up to so many bytes of text
_DOC_BYTES = 64 << 20
# bytes of the scan for a task that counts whole lines
_TASK_BYTES = 4 << 20
# bytes of the scan for a task that counts trigrams of all lines: their sums stay in its memory
_COUNT_BYTES = 8 << 20
# Spark has no estimate for rows in memory, and says so by a size beyond any data
_NO_ESTIMATE = 1 << 50


@dataclass(frozen=True)
class WeightRule:
    """Weight ``heavy`` when the trigram contains ``pattern`` and the doc name
    contains ``doc_pattern``, else ``light`` (P5)."""
    pattern: str = FAULT_TRIGRAM
    doc_pattern: str = FAULT_DOC
    heavy: int = HEAVY_WEIGHT
    light: int = LIGHT_WEIGHT

    def column(self, trigram="trigram", doc="doc") -> Column:
        return fault_weight(trigram, doc, self.pattern, self.doc_pattern, self.heavy, self.light)


@dataclass(frozen=True)
class AnyOfWeightRule:
    """Like ``WeightRule`` but heavy for any of several doc patterns."""
    doc_patterns: tuple[str, ...]
    pattern: str = FAULT_TRIGRAM
    heavy: int = HEAVY_WEIGHT
    light: int = LIGHT_WEIGHT

    def column(self, trigram="trigram", doc="doc") -> Column:
        doc_hit = F.lit(False)
        for p in self.doc_patterns:
            doc_hit = doc_hit | F.col(doc).contains(p)
        return (F.when(F.col(trigram).contains(self.pattern) & doc_hit, F.lit(self.heavy))
                .otherwise(F.lit(self.light)).cast("int"))


def parse_lines(lines: DataFrame, line_col: str = "line", on_malformed: str = "fail") -> DataFrame:
    """Add ``doc`` and ``contents`` (P1), splitting at the last colon.

    ``on_malformed='fail'`` raises on a line without a colon (as the reference
    job fails); ``'quarantine'`` keeps it with ``malformed = true`` and null
    ``doc``/``contents`` so it yields no trigrams (see ``quarantined``).
    A null line gets null ``doc``/``contents`` and so yields no tokens or
    trigrams (no filter is added: it would be pushed into the scan and
    evaluate the line expression twice).
    """
    line = F.col(line_col)
    ok = has_name(line)
    if on_malformed == "fail":
        # both columns carry the check, so any use of either fails (column
        # pruning would drop a check kept in an unused column)
        err = F.raise_error(F.concat(F.lit("line without a ':' separator: "), F.left(line, F.lit(200))))
        doc = F.when(line.isNull(), F.lit(None)).when(ok, doc_of(line)).otherwise(err)
        contents = F.when(line.isNull(), F.lit(None)).when(ok, contents_of(line)).otherwise(err)
        return lines.withColumn("doc", doc.cast("string")).withColumn("contents", contents.cast("string"))
    if on_malformed == "quarantine":
        return (lines
                .withColumn("malformed", line.isNotNull() & ~ok)
                .withColumn("doc", F.when(ok, doc_of(line)))
                .withColumn("contents", F.when(ok, contents_of(line))))
    raise ValueError("on_malformed must be 'fail' or 'quarantine'")


def quarantined(parsed: DataFrame) -> DataFrame:
    """Malformed lines set aside by ``parse_lines(..., on_malformed='quarantine')``."""
    return parsed.where(F.col("malformed"))


def tokenize(lines: DataFrame, line_col: str = "line", on_malformed: str = "fail") -> DataFrame:
    """``(line_id, pos, token)``, one row per whitespace token."""
    parsed = parse_lines(lines, line_col, on_malformed)
    toks = parsed.select("line_id", F.posexplode_outer(tokens_of("contents")).alias("pos", "token"))
    return toks.where(F.col("pos").isNotNull())


def _trigram_rows(lines: DataFrame, line_col: str, on_malformed: str, carry=()) -> DataFrame:
    """``(line_id, doc, pos, trigram)``.

    The outer explode plus a null filter is deliberate: a plain explode makes
    the optimizer infer ``size(trigrams) > 0`` and push it below the
    projection, where the tokens column is inlined into every array element
    access and the split runs once per element (quadratic per line)."""
    keep = ["line_id", *carry, "doc"]
    parsed = parse_lines(lines, line_col, on_malformed)
    toks = parsed.select(*keep, tokens_of("contents").alias("tokens"))
    arr = toks.select(*keep, trigram_parts("tokens").alias("parts"))
    rec = arr.select(*keep, F.posexplode_outer("parts").alias("pos", "p"))
    return rec.where(F.col("pos").isNotNull()).select(
        *keep, "pos", trigram_of("p").alias("trigram"))


def trigram_counts(line_col: str = "line", on_malformed: str = "fail") -> Column:
    """Number of trigrams of a line, without making them (0 for a null line)."""
    line = F.col(line_col)
    ok = F.when(has_name(line), contents_of(line))
    if on_malformed == "fail":
        ok = F.when(line.isNull(), F.lit(None)).when(has_name(line), contents_of(line)).otherwise(F.raise_error(
            F.concat(F.lit("line without a ':' separator: "), F.left(line, F.lit(200)))).cast("string"))
    return F.greatest(F.coalesce(F.size(tokens_of(ok)), F.lit(0)) - 2, F.lit(0))


def trigram_records(lines: DataFrame, weight_rule=WeightRule(), line_col: str = "line",
                    on_malformed: str = "fail", carry=()) -> DataFrame:
    """``(line_id, doc, pos, trigram, weight)``: one row per sliding word
    trigram, ``pos`` 0-based within the line (P3 + P5).  ``weight_rule=None``
    gives weight 1 everywhere; ``carry`` names extra line columns to keep."""
    rec = _trigram_rows(lines, line_col, on_malformed, carry)
    w = weight_rule.column("trigram", "doc") if weight_rule is not None else F.lit(1)
    return rec.withColumn("weight", w.cast("int"))


def doc_trigram_records(lines: DataFrame, line_col: str = "line", on_malformed: str = "fail") -> DataFrame:
    """``(line_id, pos, doc_trigram)`` with ``doc_trigram = a|b|c|doc``."""
    rec = _trigram_rows(lines, line_col, on_malformed)
    return rec.select("line_id", "pos",
                      F.concat_ws(TRIGRAM_SEPARATOR, "trigram", "doc").alias("doc_trigram"))


def trigram_totals(records: DataFrame, key: str = "trigram", weight: str = "weight") -> DataFrame:
    """``(trigram, total bigint)``: summed weight per trigram (A1)."""
    return records.groupBy(key).agg(F.sum(weight).cast("long").alias("total"))


def dealt(lines: DataFrame, task_bytes: int = _COUNT_BYTES) -> DataFrame:
    """The lines, in tasks of about ``task_bytes`` of the scan, for jobs that shuffle
    every trigram: those of a split of Spark's size do not fit into a task's memory,
    and their sums are sorted and spilled.  The text is shuffled for that, a small part
    of its trigrams.  A scan that has a smaller split for every core is left alone."""
    size = scan_bytes(lines)
    tasks = -(-size // task_bytes) if size < _NO_ESTIMATE else 1
    if tasks <= lines.sparkSession.sparkContext.defaultParallelism:
        return lines
    return lines.repartition(tasks, *lines.columns)


def doc_trigram_counts(lines: DataFrame, line_col: str = "line", on_malformed: str = "fail", tasks: int | None = None,
                       max_doc_bytes: int = _DOC_BYTES) -> DataFrame:
    """``(doc_trigram, n)``: count per document-qualified trigram (A2).

    Equal rows come from lines whose names end alike, so lines are dealt by the end
    of the name and counted where they are: the text is shuffled instead of its
    trigrams, which are almost all different and about as many as words.  ``tasks``
    partitions, as many as the size of the scan asks for unless given.  Lines of
    names whose ends hold more than ``max_doc_bytes`` are counted over all tasks."""
    # a|b|c|doc ends as its doc does, whatever bars are in either; a null line has no records and may go anywhere
    end = F.coalesce(F.substring_index(doc_of(line_col), TRIGRAM_SEPARATOR, -1), F.col("line_id").cast("string"), F.lit(""))
    tagged = lines.withColumn("_end", end)
    sizes = tagged.groupBy("_end").agg(F.sum(F.octet_length(line_col)).alias("_n")).where(F.col("_n") > max_doc_bytes)
    large = materialize(sizes.select("_end"))
    n_large = large.count()
    count = lambda rows, *by: rows.groupBy(*by, "doc_trigram").agg(F.count(F.lit(1)).alias("n")).select("doc_trigram", "n")
    small = tagged.join(large, "_end", "left_anti") if n_large else tagged
    size = scan_bytes(lines)
    tasks = tasks or max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _TASK_BYTES if size < _NO_ESTIMATE else 1)
    rec = _trigram_rows(small.repartition(tasks, "_end"), line_col, on_malformed, ("_end",))
    out = count(rec.select("_end", F.concat_ws(TRIGRAM_SEPARATOR, "trigram", "doc").alias("doc_trigram")), "_end")
    if n_large:
        some = tagged.join(large, "_end", "left_semi").select(*lines.columns)
        out = out.unionByName(count(doc_trigram_records(some, line_col, on_malformed)))
    return out


def outputs_over(totals: DataFrame, limit: int = BAD_OUTPUT_LIMIT, total_col: str = "total") -> DataFrame:
    """Outputs strictly above ``limit`` (F1 with 10000, F2 with 500)."""
    return totals.where(F.col(total_col) > limit)


def watch_list(totals: DataFrame, limit: int = WATCH_LIMIT) -> DataFrame:
    return outputs_over(totals, limit)
