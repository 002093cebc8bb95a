"""Plan shape: JVM-side expressions, pruned scans, checked broadcasts."""

from faultline.operators.provenance import Trace
from faultline.operators.trigrams import WeightRule, dealt, trigram_records, trigram_totals
from faultline.sources.lines import fixture_lines

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trigram_plan_has_no_python(spark):
    p = plan(trigram_totals(trigram_records(fixture_lines(spark, SF))))
    assert "Python" not in p and "ArrowEval" not in p and "BatchEval" not in p
    assert "partial_sum" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p


def test_trace_broadcasts_small_bad_set(spark):
    tr = Trace(fixture_lines(spark, SF), WeightRule(doc_pattern="src7:147"))
    p = plan(tr.records_of_bad())
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_trace_leaves_a_large_bad_set_to_spark(spark):
    tr = Trace(fixture_lines(spark, SF), WeightRule(doc_pattern="src7:147"), limit=0, max_broadcast_bytes=10)
    hinted = Trace(fixture_lines(spark, SF), WeightRule(doc_pattern="src7:147"), limit=0)
    logical = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in logical(tr.records_of_bad())
    assert "ResolvedHint" in logical(hinted.records_of_bad())


def test_candidate_rows_take_one_scan_and_one_explode(spark, monkeypatch):
    from faultline.operators import minimize as mz
    from faultline.operators.oracles import records_test
    from faultline.plans.pipelines import record_index
    plans, keep = [], mz.materialize
    monkeypatch.setattr(mz, "materialize", lambda df: plans.append(plan(df)) or keep(df))
    mz._candidates(record_index(fixture_lines(spark, SF)), records_test(100), 1 << 20)
    assert plans[0].count("FileScan") == 1 and plans[0].count("Generate posexplode") == 1


def test_line_index_does_not_read_the_text(spark, monkeypatch):
    from faultline.operators import sets
    plans, keep = [], sets.materialize
    monkeypatch.setattr(sets, "materialize", lambda df: plans.append(plan(df)) or keep(df))
    sets.index_items(fixture_lines(spark, SF), ["line_id"])
    assert "ReadSchema: struct<doc_id:bigint>" in plans[0]


def test_trigram_plan_stays_in_codegen(spark):
    p = plan(trigram_records(fixture_lines(spark, SF)))
    # lambdas (transform / filter) fall back from codegen; a plain explode
    # lets the optimizer infer a size filter that re-splits per element
    assert "lambdafunction" not in p
    assert "Generate posexplode" in p and ", true, [pos" in p
    assert "size(filter(split" not in p and "size(array_remove(split" not in p


def test_a_trace_cuts_lines_into_records_twice(spark):
    """For the sketch and for the records that it leaves, which outputs, lines and records are then read from."""
    tr = Trace(fixture_lines(spark, SF), WeightRule(doc_pattern="src7:147"))
    assert "Generate" not in plan(tr.records_of_bad()) and "FileScan" not in plan(tr.records_of_bad())
    kept = tr.kept_lines()
    assert "Join" not in plan(kept) and "FileScan" not in plan(kept)
    assert sorted(kept.collect()) == sorted(tr.back_lines().collect())


def test_lines_are_dealt_over_tasks(spark):
    lines = fixture_lines(spark, SF)
    assert dealt(lines) is lines
    many = dealt(lines, 10_000)
    assert many.rdd.getNumPartitions() > 4 == spark.sparkContext.defaultParallelism
    totals = lambda rows: sorted(trigram_totals(trigram_records(rows)).collect())
    assert totals(many) == totals(lines)
