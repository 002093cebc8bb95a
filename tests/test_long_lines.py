"""Lines cut into chunks against the plain way; the lineage index against the edges."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from faultline.operators import lineage_index
from faultline.operators.lineage_index import LineageIndex
from faultline.operators.long_lines import cut_contents, trigram_records_in_chunks
from faultline.operators.provenance import lineage_edges
from faultline.operators.trigrams import trigram_records


def hostile(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "größe", "日本語", "the", "1996", "Summer", "x" * 70, "v\vt", " ", "😀"]
    gaps = [" ", "  ", "\t", "\n", "\r\n", "\f \f"]
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 120)))


@pytest.mark.parametrize("chunk", [1, 7, 64, 100000])
def test_same_records_as_the_plain_way(spark, lines_df, chunk):
    rows = [f"src{i}:{i}:{' ' * (i % 3)}{hostile(i)}" for i in range(25)] + [None, "n:", "n: \t\n ", "n:a b", "n:a b c", "n:" + "z" * 500, "n:" + " " * 300 + "a b c"]
    lines = lines_df(rows)
    want = sorted(tuple(r) for r in trigram_records(lines).collect())
    got = trigram_records_in_chunks(lines, chunk_bytes=chunk)
    assert got.dtypes == trigram_records(lines).dtypes
    assert sorted(tuple(r) for r in got.collect()) == want


def test_pieces_make_the_contents_and_are_short(spark):
    text = hostile(3) * 20
    parsed = spark.createDataFrame([(1, "d", text), (2, "d", None), (3, "d", "")], "line_id long, doc string, contents string")
    pieces = sorted((r["line_id"], r["chunk"], r["piece"]) for r in cut_contents(parsed, 100).collect())
    assert "".join(p for i, _, p in pieces if i == 1) == text
    # a cut is at most one token past its mark
    assert max(len(p.encode()) for *_, p in pieces) <= 100 + 70 + 1
    assert {i for i, *_ in pieces} == {1, 3}


def test_one_long_line_is_spread_over_tasks(spark):
    line = spark.range(1).select(F.col("id").alias("line_id"), F.concat(F.lit("d:"), F.expr("array_join(transform(sequence(1, 300000), x -> 'w' || x % 1000), ' ')")).alias("line"))
    got = trigram_records_in_chunks(line, chunk_bytes=1 << 15, tasks=8)
    spread = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in spread) == 299998 and len(spread) >= 4
    assert got.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[0:3] == (299998, 0, 299997)
    assert got.exceptAll(trigram_records(line)).count() == 0


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "b", "c", None, *"defghij"]), rng.choice([None, *range(400)])) for _ in range(3000)]
    return spark.createDataFrame(rows, "out_id string, line_id long"), set(rows)


@pytest.mark.parametrize("buckets", [1, 5, 256])
def test_index_gives_the_edges_of_its_outputs(spark, edges, buckets):
    frame, plain = edges
    folder = tempfile.mkdtemp(prefix="faultline-index-") + "/edges"
    LineageIndex.write(frame, folder, buckets=buckets)
    index = LineageIndex(spark, folder, buckets=buckets)
    assert sorted(map(str, index.edges().collect())) == sorted(str(r) for r in frame.distinct().collect())
    for some in (["hot"], ["b", "b", "nowhere"], [None, "c"], ["nowhere"], []):
        wanted = spark.createDataFrame([(x, 1) for x in some], "out_id string, other int")
        got = [tuple(r) for r in index.back(wanted).collect()]
        assert len(got) == len(set(got)) and set(got) == {e for e in plain if e[0] in some}
        index.max_broadcast_bytes = 0
        assert {r[0] for r in index.back_ids(wanted).collect()} == {i for o, i in plain if o in some}
        index.max_broadcast_bytes = 32 << 20


def test_a_trace_opens_few_files(spark, lines_df):
    rng = random.Random(2)
    lines = lines_df([f"d:{' '.join(str(rng.randint(0, 40)) for _ in range(60))}" for _ in range(200)])
    folder = tempfile.mkdtemp(prefix="faultline-index-") + "/edges"
    index = LineageIndex.write(lineage_edges(trigram_records(lines)), folder)
    some = lineage_edges(trigram_records(lines)).orderBy("out_id").limit(5).select("out_id")
    scan = index.back(some)._jdf.queryExecution().optimizedPlan().toString()
    plan = index.back(some)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in scan and "PushedFilters: [" in plan and "out_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("hot", [1, 1000])
def test_index_deals_an_output_of_many_edges(spark, edges, monkeypatch, hot):
    """Edges that are equal meet in one task, those of a hot output are in many files."""
    monkeypatch.setattr(lineage_index, "_EACH", 1)
    monkeypatch.setattr(lineage_index, "_HOT", hot)
    frame, plain = edges
    folder = tempfile.mkdtemp(prefix="faultline-index-") + "/edges"
    plans, kind = [], type(frame)
    part = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *by: plans.append(df._jdf.queryExecution().executedPlan().toString()) or part(df, *by))
    index = LineageIndex.write(frame.repartition(6), folder, buckets=4)
    assert plans[0].count("Exchange hashpartitioning(_bucket") == 1 and plans[0].count("Exchange hashpartitioning") == 1
    assert sorted(map(str, index.edges().collect())) == sorted(map(str, frame.distinct().collect()))
    got = index.back(spark.createDataFrame([("hot",)], "out_id string"))
    assert {tuple(r) for r in got.collect()} == {e for e in plain if e[0] == "hot"}
