"""faultline: find the input records behind a wrong aggregate, on Spark.

Weighted word-trigram counting over ``name:contents`` lines, record-level
provenance as id columns (trace bad outputs back to their lines and forward
to their records), and delta debugging (ddmin) that shrinks the traced data
to a minimal failing subset with grouped jobs.
"""

from faultline.operators.minimize import ddmin, minimize_all, part_test_matrix  # noqa: F401
from faultline.operators.oracles import CallableTest, SumThreshold, lines_test, records_test  # noqa: F401
from faultline.operators.provenance import Trace, lineage_edges, outputs_with_id  # noqa: F401
from faultline.operators.trigrams import (  # noqa: F401
    WeightRule, doc_trigram_counts, outputs_over, parse_lines, tokenize, trigram_records, trigram_totals,
)
from faultline.sources.lines import fixture_lines, lines_from_table, read_lines, write_lines  # noqa: F401
