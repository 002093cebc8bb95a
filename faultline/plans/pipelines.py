"""The three end-to-end jobs: count trigrams, trace the bad outputs, shrink.

* ``traced_lines``   (E3): provenance -> source lines -> ddmin with the line test
* ``traced_records`` (E1): provenance -> lines -> their trigram records -> ddmin
* ``all_records``    (E2): ddmin over every trigram record, no provenance
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultline.functions.text import BAD_OUTPUT_LIMIT, FAIL_THRESHOLD
from faultline.operators.minimize import MinimizeResult, ddmin
from faultline.operators.oracles import lines_test, records_test
from faultline.operators.provenance import Trace
from faultline.operators.sets import GroupIndex, index_by_group
from faultline.operators.trigrams import WeightRule, trigram_counts, trigram_records
from faultline.session import MAX_BROADCAST_BYTES

RECORD_COLS = ["line_id", "pos", "trigram", "weight"]


def record_index(lines: DataFrame, weight_rule=WeightRule()) -> GroupIndex:
    """The trigram records of ``lines``, numbered by (line, position)."""
    return index_by_group(lines, trigram_counts(), "line_id", "pos",
                          lambda some: trigram_records(some, weight_rule).select(*RECORD_COLS))


def traced_lines(lines: DataFrame, weight_rule=WeightRule(), limit: int = BAD_OUTPUT_LIMIT,
                 threshold: int = FAIL_THRESHOLD, min_items: int = 1, test=None, split=None,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> MinimizeResult:
    """The minimal set of input lines that still makes a total reach
    ``threshold``, searched only among lines traced back from bad outputs.
    ``test`` and ``split`` replace the threshold test and the contiguous split."""
    tr = Trace(lines, weight_rule, limit, max_broadcast_bytes)
    return ddmin(tr.kept_lines(), test or lines_test(weight_rule, threshold), ["line_id"], split=split,
                 min_items=min_items, max_broadcast_bytes=max_broadcast_bytes)


def _records(lines, weight_rule, threshold, min_items, test, split, max_broadcast_bytes):
    index = record_index(lines, weight_rule)
    return ddmin(index.items, test or records_test(threshold), ["line_id", "pos"], split=split, min_items=min_items,
                 max_broadcast_bytes=max_broadcast_bytes, index=index)


def traced_records(lines: DataFrame, weight_rule=WeightRule(), limit: int = BAD_OUTPUT_LIMIT,
                   threshold: int = FAIL_THRESHOLD, min_items: int = 1, test=None, split=None,
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> MinimizeResult:
    """Minimal set of trigram records among the records of traced lines."""
    traced = Trace(lines, weight_rule, limit, max_broadcast_bytes).kept_lines()
    return _records(traced, weight_rule, threshold, min_items, test, split, max_broadcast_bytes)


def all_records(lines: DataFrame, weight_rule=WeightRule(), threshold: int = FAIL_THRESHOLD,
                min_items: int = 1, test=None, split=None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> MinimizeResult:
    """Minimal set of trigram records over all records."""
    return _records(lines, weight_rule, threshold, min_items, test, split, max_broadcast_bytes)
