"""Text-line scan (S1) and line sinks."""

import os
import random
import tempfile

import pytest

from faultline.operators.trigrams import trigram_records
from faultline.sources import offsets
from faultline.sources.lines import lines_from_table, null_lines, read_lines, write_lines


def test_read_lines_ids_stable(spark):
    d = tempfile.mkdtemp(prefix="faultline-text-")
    with open(os.path.join(d, "part.txt"), "w") as f:
        f.write("a:x y z\nb:p q r s\n\nc:no\n")
    lines = read_lines(spark, d, os.path.join(d, "ids"), min_partitions=5)
    assert "PushedFilters: [IsNotNull(line_id), EqualTo(line_id,3)]" in lines.where("line_id = 3")._jdf.queryExecution().executedPlan().toString()
    first = sorted(map(tuple, lines.collect()))
    assert sorted(l for _, l in first) == ["", "a:x y z", "b:p q r s", "c:no"]
    assert len({i for i, _ in first}) == 4
    # ids are written: a second job sees the same ids
    assert sorted(map(tuple, lines.collect())) == first


def test_write_lines_text_and_parquet(spark, lines_df):
    df = lines_df(["a:x y z", "b:multi\nline text"])
    base = tempfile.mkdtemp(prefix="faultline-sink-")
    write_lines(df, os.path.join(base, "pq"))
    back = spark.read.parquet(os.path.join(base, "pq"))
    assert sorted(r["line"] for r in back.collect()) == ["a:x y z", "b:multi\nline text"]
    write_lines(df.limit(1).where("line_id = 0"), os.path.join(base, "txt"), fmt="text")
    assert [r["value"] for r in spark.read.text(os.path.join(base, "txt")).collect()] == ["a:x y z"]


def test_lines_from_table(spark):
    t = spark.createDataFrame([(1, "s1", "a b c")], "id long, src string, body string")
    lines = lines_from_table(t, "id", ["src", "id"], "body")
    assert [tuple(r) for r in lines.collect()] == [(1, "s1:1:a b c")]
    assert [r["doc"] for r in trigram_records(lines).collect()] == ["s1:1"]


def test_text_sink_refuses_newlines_unless_asked(spark, lines_df):
    base = tempfile.mkdtemp(prefix="faultline-sink-")
    df = lines_df(["b:multi\nline text"])
    with pytest.raises(Exception, match="newline"):
        write_lines(df, os.path.join(base, "a"), fmt="text")
    write_lines(df, os.path.join(base, "b"), fmt="text", split_newlines=True)
    assert spark.read.text(os.path.join(base, "b")).count() == 2


def test_null_lines_are_counted(spark, lines_df):
    df = lines_df(["a:x y z", None, None])
    assert null_lines(df).first()["n_null"] == 2 and trigram_records(df).count() == 1


# ---- ids from byte offsets -------------------------------------------------------
def text_files(folder):
    """Files of odd content: their lines with (file number, offset)."""
    rng, want, parts = random.Random(8), {}, {}
    parts["a.txt"] = "".join("".join(rng.choice("xyé z:日") for _ in range(rng.randint(0, 60))) + rng.choice(["\n", "\r\n"]) for _ in range(900)) + "no end"
    parts["b.txt"] = "\n\n\n"
    parts["c.txt"] = "﻿marked\nsecond\n"
    parts["e.txt"] = "long " * 30_000 + "\nshort\n"
    (folder / "d.txt").write_text("")  # no lines: no number
    for number, name in enumerate(sorted(parts)):
        (folder / name).write_bytes(parts[name].encode())
        at = 0
        for line in parts[name].removeprefix("﻿").split("\n")[:-1] + [x for x in [parts[name].split("\n")[-1]] if x]:
            want[number << offsets.OFFSET_BITS | at] = line.removesuffix("\r")
            at += len(line.encode()) + 1
    return want


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_offset_ids_do_not_depend_on_splits(spark, tmp_path, split):
    want = text_files(tmp_path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(split, 4096) if split > 64 else 4096))
        spark.conf.set("spark.sql.files.openCostInBytes", str(min(split, 4096)))
        rows = offsets.read_lines_by_offset(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(want) and {r["line_id"]: r["line"] for r in rows} == want


def test_offset_ids_lead_back_to_the_line(spark, tmp_path):
    want = text_files(tmp_path)
    lines = offsets.read_lines_by_offset(spark, str(tmp_path), max_broadcast_bytes=0)
    some = lines.where("line_id % 7 = 0 OR line LIKE '%no end' OR line LIKE 'marked' OR line = 'second'")
    got = dict(offsets.lines_at(spark, str(tmp_path), some))
    assert got == {r["line_id"]: r["line"] for r in some.collect()} and "second" in got.values() and "no end" in " ".join(got.values())
    assert all(want[i] == line for i, line in got.items())
    place = lines.select(offsets.place_of("line_id").alias("p"), "line_id").first()
    assert place["p"]["number"] << offsets.OFFSET_BITS | place["p"]["offset"] == place["line_id"]
    with pytest.raises(ValueError):
        offsets.lines_at(spark, str(tmp_path), spark.range(offsets.MAX_LOOKUPS + 1).withColumnRenamed("id", "line_id"))


def test_offset_ids_keep_nothing(spark, tmp_path):
    text_files(tmp_path)
    lines = offsets.read_lines_by_offset(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "FileScan text" in plan
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt"]
