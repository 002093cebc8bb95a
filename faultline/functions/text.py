"""Column expressions for ``name:contents`` lines and word trigrams.

All built from JVM-side functions so they stay inside whole-stage codegen;
no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------
# Name and contents are separated by the LAST colon of the line.
NAME_SEPARATOR = ":"
# Tokens are separated by runs of: space, tab, line feed, carriage return,
# form feed (the default delimiters of java.util.StringTokenizer).  Vertical
# tab is NOT a delimiter.
TOKEN_SPLIT_PATTERN = "[ \t\n\r\f]+"
# Words of a trigram are joined with a vertical bar, unescaped.
TRIGRAM_SEPARATOR = "|"
# Fault-injection rule: weight HEAVY_WEIGHT when the trigram contains
# FAULT_TRIGRAM and the document name contains FAULT_DOC, else 1.
FAULT_TRIGRAM = "the|1996|Summer"
FAULT_DOC = "2556535909:2906251"
HEAVY_WEIGHT = 10000
LIGHT_WEIGHT = 1
# Outputs above BAD_OUTPUT_LIMIT are bad; the test fails at FAIL_THRESHOLD.
BAD_OUTPUT_LIMIT = 10000
FAIL_THRESHOLD = 10000
WATCH_LIMIT = 500
# -----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_name(line) -> Column:
    """True when the line holds a name separator."""
    return F.instr(_col(line), NAME_SEPARATOR) > 0


def contents_of(line) -> Column:
    """Text after the last colon (the whole line when there is none)."""
    return F.substring_index(_col(line), NAME_SEPARATOR, -1)


def doc_of(line) -> Column:
    """Text before the last colon; the name may itself hold colons."""
    line = _col(line)
    return F.left(line, F.length(line) - F.length(contents_of(line)) - 1)


def tokens_of(contents) -> Column:
    """Whitespace tokens in order; runs collapse and no token is empty."""
    return F.array_remove(F.split(_col(contents), TOKEN_SPLIT_PATTERN), "")


def trigram_parts(tokens) -> Column:
    """``array<struct<0,1,2>>``: the three words of each sliding trigram, in
    order; empty when there are fewer than three tokens.  ``tokens`` should be
    a column (not an expression) so the split runs once per row."""
    tokens = _col(tokens)
    m = F.greatest(F.size(tokens) - 2, F.lit(0))
    return F.arrays_zip(F.slice(tokens, 1, m), F.slice(tokens, 2, m), F.slice(tokens, 3, m))


def trigram_of(parts) -> Column:
    """``a|b|c`` from one element of ``trigram_parts``."""
    parts = _col(parts)
    return F.concat_ws(TRIGRAM_SEPARATOR, parts["0"], parts["1"], parts["2"])


def fault_weight(trigram, doc, pattern: str = FAULT_TRIGRAM, doc_pattern: str = FAULT_DOC,
                 heavy: int = HEAVY_WEIGHT, light: int = LIGHT_WEIGHT) -> Column:
    """Rule-based weight: ``heavy`` when the trigram contains ``pattern`` and
    the document name contains ``doc_pattern`` (plain substring tests)."""
    return (F.when(_col(trigram).contains(pattern) & _col(doc).contains(doc_pattern), F.lit(heavy))
            .otherwise(F.lit(light)).cast("int"))


def output_id(trigram) -> Column:
    """Stable output id: md5 of the output key (same value in any engine)."""
    return F.md5(_col(trigram))
