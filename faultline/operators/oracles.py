"""Pass/fail tests for delta debugging.  ``fails(df) -> True`` means the data
still shows the failure (same polarity as the reference's user test).

``SumThreshold`` is the batchable form: "some key's summed weight reaches
the threshold".  ``ddmin`` recognises it and tests all parts and complements
of a split in one grouped job.  ``CallableTest`` wraps any opaque
``DataFrame -> bool`` (one job per test).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import FAIL_THRESHOLD
from faultline.operators.sketch import totals_from
from faultline.operators.trigrams import WeightRule, trigram_records


def item_count(items: DataFrame) -> DataFrame:
    """``(n_items)``: size of a dataset (A3)."""
    return items.agg(F.count(F.lit(1)).alias("n_items"))


def fails_frame(rows: DataFrame, key: str = "trigram", weight: str = "weight",
                threshold: int = FAIL_THRESHOLD) -> DataFrame:
    """``(fails boolean)``: does any key's total reach ``threshold`` (A4)?
    One row; false on empty input.  Only keys that a sketch of the weights
    leaves open are counted."""
    return totals_from(rows, threshold, key, weight).agg((F.count(F.lit(1)) > 0).alias("fails"))


@dataclass
class SumThreshold:
    """Fails iff some key's summed weight is ``>= threshold``.

    ``rows(items)`` maps an items DataFrame to ``(key, weight)`` rows, keeping
    any extra item columns it is given (the item index rides along).  With no
    ``rows``, each item is itself one row.
    """
    key: str = "trigram"
    weight: str = "weight"
    threshold: int = FAIL_THRESHOLD
    rows: Callable[[DataFrame, list[str]], DataFrame] | None = None

    def item_rows(self, items: DataFrame, carry: list[str] = ()) -> DataFrame:
        """``(*carry, key, weight)`` rows of the items."""
        if self.rows is None:
            return items.select(*carry, self.key, self.weight)
        return self.rows(items, list(carry)).select(*carry, self.key, self.weight)

    def frame(self, items: DataFrame) -> DataFrame:
        return fails_frame(self.item_rows(items), self.key, self.weight, self.threshold)

    def fails(self, items: DataFrame) -> bool:
        rows = self.item_rows(items)
        hit = rows.groupBy(self.key).agg(F.sum(self.weight).alias("_t")) \
                  .where(F.col("_t") >= self.threshold).limit(1)
        return len(hit.collect()) > 0


def line_trigram_rows(weight_rule=WeightRule()):
    """``rows`` function for line items: the weighted trigram records of each
    line (the A5 test re-parses the lines it is given)."""
    def rows(items: DataFrame, carry: list[str]) -> DataFrame:
        extra = [c for c in carry if c != "line_id"]
        return trigram_records(items, weight_rule, carry=extra)
    return rows


def lines_test(weight_rule=WeightRule(), threshold: int = FAIL_THRESHOLD) -> SumThreshold:
    """A5: parse lines, count weighted trigrams, fail at ``threshold``."""
    return SumThreshold("trigram", "weight", threshold, line_trigram_rows(weight_rule))


def records_test(threshold: int = FAIL_THRESHOLD) -> SumThreshold:
    """A4 on trigram records ``(trigram, weight)``."""
    return SumThreshold("trigram", "weight", threshold, None)


@dataclass
class CallableTest:
    """Any user test ``DataFrame -> bool`` (X1); run once per candidate."""
    fn: Callable[[DataFrame], bool]

    def fails(self, items: DataFrame) -> bool:
        return bool(self.fn(items))
