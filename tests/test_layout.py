"""The two stored layouts of the edges."""

import pytest

from veridex.sources import layout
from veridex.sources.tuples import SCHEMA

ROWS = [("doc", f"d{i % 7}", "viewer", "user", "*" if i % 3 == 0 else f"u{i % 11}", "...", None, None, None) for i in range(231)] + [("group", "d1", "member", "user", "u1", "...", None, None, None)]


def test_reads_by_either_end_open_the_buckets_asked_for(spark, tmp_path):
    layout.write(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/l", 8)
    of = lambda df: sorted((r["resource_type"], r["resource_id"], r["subject_id"]) for r in df.collect())
    brief = [(r[0], r[1], r[4]) for r in ROWS]
    got = layout.read(spark, f"file://{tmp_path}/l", SCHEMA, "resource", "doc", ["d1", "d5", "none"], 8)
    assert of(got) == sorted(x for x in brief if x[0] == "doc" and x[1] in ("d1", "d5"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert of(layout.read(spark, f"file://{tmp_path}/l", SCHEMA, "subject", "user", ["*"], 8)) == sorted(x for x in brief if x[2] == "*")
    asked = spark.createDataFrame([("user", "u1"), ("user", "u1"), ("user", "u4"), ("group", "u5")], "subject_type string, subject_id string")
    assert of(layout.beside(asked, f"file://{tmp_path}/l", SCHEMA, "subject", 8)) == sorted(x for x in brief if x[2] in ("u1", "u4"))


def test_scans_and_nothing(spark, tmp_path):
    layout.write(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/l", 8)
    for type_, ids in (("doc", []), ("", ["d1"])):
        with pytest.raises(ValueError):
            layout.read(spark, f"file://{tmp_path}/l", SCHEMA, "resource", type_, ids, 8)
    assert layout.read(spark, f"file://{tmp_path}/l", SCHEMA, "resource", "page", ["d1"], 8).count() == 0
