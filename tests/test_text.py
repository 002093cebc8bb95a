"""Parsing, tokens and trigrams on the edge-case rows of FIXTURES.md."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException

from faultline.operators.provenance import Trace
from faultline.operators.trigrams import (
    WeightRule, doc_trigram_counts, parse_lines, quarantined, tokenize, trigram_counts, trigram_records, trigram_totals,
)


def recs(lines_df, rows, rule=WeightRule()):
    out = trigram_records(lines_df(rows), rule).orderBy("line_id", "pos").collect()
    return [(r["doc"], r["trigram"], r["weight"]) for r in out]


def test_name_at_last_colon(lines_df):
    assert recs(lines_df, ["a:b:x y z"]) == [("a:b", "x|y|z", 1)]
    assert recs(lines_df, ["d:one two: three four five"]) == [("d:one two", "three|four|five", 1)]


def test_too_few_tokens(lines_df):
    assert recs(lines_df, ["d:", "d:x y"]) == []


def test_tokenizer_delimiters(lines_df):
    assert [t for _, t, _ in recs(lines_df, ["d:  x \t y\r\fz "])] == ["x|y|z"]
    # vertical tab is not a delimiter
    assert [t for _, t, _ in recs(lines_df, ["d:x\x0by z w"])] == ["x\x0by|z|w"]
    # newlines inside a line are delimiters
    assert [t for _, t, _ in recs(lines_df, ["d:a\nb\nc d"])] == ["a|b|c", "b|c|d"]


def test_bar_not_escaped(lines_df):
    assert [t for _, t, _ in recs(lines_df, ["d:x|y z w"])] == ["x|y|z|w"]


def test_positions_and_order(lines_df):
    out = trigram_records(lines_df(["d:a b c d e"])).orderBy("pos").collect()
    assert [(r["pos"], r["trigram"]) for r in out] == [(0, "a|b|c"), (1, "b|c|d"), (2, "c|d|e")]


def test_weight_is_substring_match(lines_df):
    rule = WeightRule(doc_pattern="src7:147")
    got = recs(lines_df, ["src7:147:bathe 1996 Summertime"], rule)
    assert got == [("src7:147", "bathe|1996|Summertime", 10000)]
    got = recs(lines_df, ["src7:148:the 1996 Summer"], rule)
    assert got == [("src7:148", "the|1996|Summer", 1)]


NO_SEPARATOR = "line without a ':' separator"


def test_malformed_fails_by_default(lines_df):
    with pytest.raises(PySparkException, match=NO_SEPARATOR):
        trigram_records(lines_df(["no colon here at all"])).collect()


def test_malformed_fails_tokenize_too(lines_df):
    with pytest.raises(PySparkException, match=NO_SEPARATOR):
        tokenize(lines_df(["d:a b", "no colon here at all"])).collect()


def test_malformed_fails_counts_too(lines_df):
    with pytest.raises(PySparkException, match=NO_SEPARATOR):
        lines_df(["no colon here at all"]).select(trigram_counts()).collect()


def test_counts_equal_records(lines_df):
    rows = ["d:", "d:x y", "d:a b c d", None, "d: a  b\tc "]
    assert [r[0] for r in lines_df(rows).orderBy("line_id").select(trigram_counts()).collect()] == [0, 0, 2, 0, 1]


def test_malformed_quarantine(lines_df):
    parsed = parse_lines(lines_df(["no colon here at all", "d:a b c"]), on_malformed="quarantine")
    assert [r["line"] for r in quarantined(parsed).collect()] == ["no colon here at all"]
    out = trigram_records(lines_df(["no colon here at all", "d:a b c"]), on_malformed="quarantine").collect()
    assert [r["trigram"] for r in out] == ["a|b|c"]


def test_null_line_yields_nothing(spark):
    df = spark.createDataFrame([(0, None), (1, "d:a b c")], "line_id long, line string")
    assert [r["trigram"] for r in trigram_records(df).collect()] == ["a|b|c"]


def test_totals_and_doc_counts(lines_df):
    rows = ["d1:a b c a b c", "d2:a b c"]
    tot = {r["trigram"]: r["total"] for r in trigram_totals(trigram_records(lines_df(rows))).collect()}
    assert tot == {"a|b|c": 3, "b|c|a": 1, "c|a|b": 1}
    dc = {r["doc_trigram"]: r["n"] for r in doc_trigram_counts(lines_df(rows)).collect()}
    assert dc == {"a|b|c|d1": 2, "b|c|a|d1": 1, "c|a|b|d1": 1, "a|b|c|d2": 1}


@pytest.mark.parametrize("most", [1 << 26, 30, 0])
def test_doc_trigram_counts_deal_lines(spark, lines_df, most):
    # names and words with bars: different lines make the same text
    rows = ["x|y:a b c a b c", "y:a b c|x", "y:a b c|x d", "x|y:b c a", ":a b c", "z:p q", None, None, "q|y:a b c a b c a b c a b c a b c a b c"]
    want = Counter(f"{a}|{b}|{c}|{line.rpartition(':')[0]}" for line in rows if line is not None
                   for w in [line.rpartition(":")[2].split()] for a, b, c in zip(w, w[1:], w[2:]))
    out = doc_trigram_counts(lines_df(rows), tasks=3, max_doc_bytes=most)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want.items())
    if most > 1000:  # text is shuffled, no trigram
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "doc_trigram" not in plan[plan.index("Exchange hashpartitioning"):]


def test_tokenize(lines_df):
    out = tokenize(lines_df(["d: x  y "])).orderBy("pos").collect()
    assert [(r["pos"], r["token"]) for r in out] == [(0, "x"), (1, "y")]


def test_forward_within_bad(lines_df):
    lines = lines_df(["d1:a b c x", "d2:a b c y", "d3:q r s t"])
    tr = Trace(lines, None, limit=1)
    assert sorted((r["line_id"], r["trigram"]) for r in tr.forward_records().collect()) == [
        (0, "a|b|c"), (0, "b|c|x"), (1, "a|b|c"), (1, "b|c|y")]
    assert sorted((r["line_id"], r["trigram"]) for r in tr.forward_records(within_bad=True).collect()) == [(0, "a|b|c"), (1, "a|b|c")]
