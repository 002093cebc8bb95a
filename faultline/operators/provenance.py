"""Record-level provenance as ordinary id columns.

Outputs are keyed by ``out_id = md5(trigram)``; every trigram record keeps
``(line_id, pos)``, so lineage is a projection of the records and tracing is a
semi join, no engine instrumentation.  The bad-output set is materialised
once and broadcast only when its measured size allows; otherwise the semi join
shuffles (AQE splits a hot key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import BAD_OUTPUT_LIMIT, output_id
from faultline.operators.sets import GroupIndex, ItemIndex, index_by_group, index_items
from faultline.operators.sketch import candidate_rows
from faultline.operators.trigrams import WeightRule, outputs_over, trigram_counts, trigram_records, trigram_totals
from faultline.session import MAX_BROADCAST_BYTES, join_small, materialize, measured_bytes


def outputs_with_id(totals: DataFrame, key: str = "trigram") -> DataFrame:
    """``(out_id, trigram, total)``: every output with a stable id (L1)."""
    return totals.select(output_id(key).alias("out_id"), key, "total")


def lineage_edges(records: DataFrame, key: str = "trigram") -> DataFrame:
    """``(out_id, line_id, pos)``: which record feeds which output (L2)."""
    return records.select(output_id(key).alias("out_id"), "line_id", "pos")


class Trace:
    """Provenance of the trigram job over ``lines``.

    ``bad`` holds the outputs whose total is above ``limit``; it is computed
    once and materialised, and its size is measured for the broadcast hint.
    """

    def __init__(self, lines: DataFrame, weight_rule=WeightRule(), limit: int = BAD_OUTPUT_LIMIT,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        self.lines = lines
        self.weight_rule = weight_rule
        self.limit = limit
        self.max_broadcast_bytes = max_broadcast_bytes
        self.records = trigram_records(lines, weight_rule)
        self.totals = trigram_totals(self.records)
        self._some = None
        self._bad = None
        self._bad_bytes = None
        self._lines_back = None
        self._lines_back_bytes = None
        self._lines_kept = None

    # -- backward ---------------------------------------------------------
    def _may_be_bad(self) -> DataFrame:
        """All records of every bad output, and some others that a sketch leaves open.
        Kept, so that lines are not cut into records anew for their outputs and lines;
        where the sketch leaves every record, they are not."""
        if self._some is None:
            # whole numbers: above the limit is at least one more
            some = candidate_rows(self.records, "trigram", "weight", self.limit + 1)
            self._some = some if some is self.records else materialize(some)
        return self._some

    @property
    def bad(self) -> DataFrame:
        """``(out_id, trigram, total)`` with ``total > limit`` (F1 + L1), by sketch and then exactly."""
        if self._bad is None:
            self._bad = materialize(outputs_with_id(outputs_over(trigram_totals(self._may_be_bad()), self.limit)))
            self._bad_bytes = measured_bytes(self._bad)
        return self._bad

    def _bad_keys(self) -> tuple[DataFrame, int]:
        bad = self.bad
        return bad.select("trigram"), self._bad_bytes

    def records_of_bad(self) -> DataFrame:
        """Trigram records that feed a bad output."""
        keys, n = self._bad_keys()
        return join_small(self._may_be_bad(), keys, "trigram", "left_semi", n, self.max_broadcast_bytes)

    def back_records(self) -> DataFrame:
        """``(out_id, line_id, pos)``: records one step back from bad outputs (L4)."""
        return self.records_of_bad().select(output_id("trigram").alias("out_id"), "line_id", "pos")

    def back_line_ids(self) -> DataFrame:
        """``(line_id)``: distinct source lines of the bad outputs (L3)."""
        if self._lines_back is None:
            ids = self.records_of_bad().select("line_id").distinct()
            self._lines_back = materialize(ids)
            self._lines_back_bytes = measured_bytes(self._lines_back)
        return self._lines_back

    def back_lines(self) -> DataFrame:
        """``(line_id, line)``: the traced lines themselves."""
        return join_small(self.lines, self.back_line_ids(), "line_id", "left_semi", self._lines_back_bytes, self.max_broadcast_bytes)

    def kept_lines(self) -> DataFrame:
        """``back_lines``, found and written once for searches that read them again and again."""
        if self._lines_kept is None:
            self._lines_kept = materialize(self.back_lines())
        return self._lines_kept

    # -- forward ----------------------------------------------------------
    def forward_records(self, within_bad: bool = False, lines: DataFrame | None = None) -> DataFrame:
        """Records of the traced lines (L5), or of ``lines`` among them.
        ``within_bad=True`` keeps only those that feed a bad output."""
        # select the traced lines first (one row per line), then explode only
        # those: no record of an untraced line is produced or shuffled
        recs = trigram_records(self.back_lines() if lines is None else lines, self.weight_rule)
        if within_bad:
            keys, n = self._bad_keys()
            recs = join_small(recs, keys, "trigram", "left_semi", n, self.max_broadcast_bytes)
        return recs

    def forward_index(self, columns: list[str]) -> GroupIndex | ItemIndex:
        """``columns`` of ``forward_records``, numbered by (line, position).  A record
        is its line and a place in it, so records are not sorted or written for that;
        they are where line ids repeat."""
        lines = self.kept_lines()
        n, ids = lines.agg(F.count(F.lit(1)), F.count_distinct("line_id")).first()
        if ids < n:
            return index_items(self.forward_records().select(*columns), ["line_id", "pos"])
        return index_by_group(lines, trigram_counts(), "line_id", "pos", lambda some: self.forward_records(lines=some).select(*columns))
