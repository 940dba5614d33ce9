"""What jobs cost as tables grow: rows that go through shuffles, and what a single task holds."""

import pytest

from veridex import world
from veridex.operators import check, expand, lookup, subject_sets
from veridex.operators.check import reachable_plans
from veridex.plans.compile import compile_schema
from veridex.plans.schema import ELLIPSIS, parse
from veridex.sources import layout, store
from veridex.sources.tuples import SCHEMA

SMALL = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """Rows written to shuffles while ``run`` runs."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def rows():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    run()
    return sum(n for k, n in rows().items() if k not in before)


def test_each_types_edges_are_written_by_themselves_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(world, "ROWS_A_TASK", 500)
    made = dict(world.derive_edges(spark, SMALL))
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert {t: df.select("resource_type").distinct().collect() for t, df in made.items()} == {t: [(t,)] for t in made}
    assert made["lineitem"].rdd.getNumPartitions() >= 2 * (lines // 500) and made["part"].rdd.getNumPartitions() >= lines // 500
    assert "Sort" not in made["lineitem"]._jdf.queryExecution().executedPlan().toString()


def test_a_check_shuffles_a_few_rows_for_each_item(spark):
    schema = parse("definition user {} definition doc { relation a: user relation b: user relation c: user relation d: user relation e: user permission view = (a + b + c + d) - e }")
    n = 3000
    edges = spark.range(n).selectExpr("'doc' resource_type", "concat('d', id) resource_id", "'b' resource_relation", "'user' subject_type", "concat('u', id) subject_id", "'...' subject_relation", "string(null) caveat_name", "string(null) caveat_context", "timestamp(null) expires_at")
    items = spark.range(2 * n).selectExpr("id item_id", "'doc' resource_type", "concat('d', id % 3000) resource_id", "'view' permission", "'user' subject_type", "concat('u', id) subject_id", "'...' subject_relation")
    got = []
    rows = shuffled(spark, lambda: got.extend(check.bulk_check(edges, schema, items).collect()))
    assert len(got) == 2 * n and sum(r["verdict"] == "member" for r in got) == n
    assert rows < 6 * 2 * n  # five relations, and no relation has wildcards or usersets


@pytest.mark.parametrize("wide", [14, 15, 16, 40])
def test_permissions_of_many_relations(spark, wide):
    names = [f"rel{i:02d}" for i in range(wide)]
    text = " ".join(f"relation {r}: user" for r in names)
    schema = parse(f"definition user {{}} definition doc {{ {text} permission some = {' + '.join(names)} permission every = {' & '.join(names)} }}")
    rows = [("doc", "one", r, "user", "all", ELLIPSIS, None, None, None) for r in names] + [("doc", "one", names[-1], "user", "last", ELLIPSIS, None, None, None)]
    items = spark.createDataFrame([(f"{p}/{u}", p, u) for p in ("some", "every") for u in ("all", "last", "none")], "item_id string, permission string, subject_id string")
    items = items.selectExpr("*", "'doc' resource_type", "'one' resource_id", "'user' subject_type", "'...' subject_relation")
    got = {r["item_id"] for r in check.bulk_check(spark.createDataFrame(rows, SCHEMA), schema, items).collect() if r["verdict"] == "member"}
    assert got == {"some/all", "some/last", "every/all"}


def test_a_layout_sorts_in_tasks_of_bounded_rows_and_only_the_end_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "ROWS_A_TASK", 50)
    rows = [("doc", f"d{i}", "viewer", "user", f"u{i % 7}", ELLIPSIS, None, None, None) for i in range(1000)]
    root = f"file://{tmp_path}/l"
    layout.write(spark.createDataFrame(rows, SCHEMA), root, 2, ends=("resource",))
    assert len(list(tmp_path.glob("l/by_resource/*/*/*.parquet"))) >= 15 and not (tmp_path / "l/by_subject").exists()
    assert layout.read(spark, root, SCHEMA, "resource", "doc", ["d3", "d999"], 2).count() == 2


def test_sets_are_folded_without_lists(spark):
    schema = parse("definition user {} definition doc { relation viewer: user | user:* relation banned: user permission view = viewer - banned }")
    plans = compile_schema(schema)
    parts = spark.createDataFrame([("doc", "d", "view", 0, "u", True, False)], "rt string, rid string, rel string, leaf int, subject_id string, holds boolean, rest boolean")
    plan = subject_sets._folded(parts, subject_sets._value(plans, [("doc", "view")]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_lookups_and_trees_leave_other_relations_edges_unmoved(spark):
    schema = parse("definition user {} definition doc { relation owner: user relation other: user permission edit = owner permission more = other }")
    rows = [("doc", "d1", "owner", "user", "u1", ELLIPSIS, None, None, None)] + [("doc", f"x{i}", "other", "user", f"y{i}", ELLIPSIS, None, None, None) for i in range(4000)]
    edges, got = spark.createDataFrame(rows, SCHEMA), []
    moved = shuffled(spark, lambda: got.extend(expand.expand(edges, schema, spark.createDataFrame([("doc", "d1")], "resource_type string, resource_id string"), "edit").collect()))
    assert {r["subjects"] for r in got} >= {"user:u1"} and moved < 1000
    assert "other" not in lookup._edges(edges, None, reachable_plans(compile_schema(schema), schema, {("doc", "edit")})).select("e_resource_relation").distinct().toPandas()["e_resource_relation"].tolist()


def test_a_read_after_a_bulk_import_moves_only_what_came_later(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.write_schema("definition user {} definition doc { relation viewer: user relation owner: user }")
    row = lambda i, rel="viewer": ("doc", f"d{i}", rel, "user", f"u{i}", ELLIPSIS, None, None, None)
    with pytest.raises(store.StoreError, match="already_exists"):
        s.import_bulk(spark.createDataFrame([row(i % 2999) for i in range(3000)], SCHEMA))
    first = s.import_bulk(spark.createDataFrame([row(i) for i in range(3000)], SCHEMA))
    s.write(spark.createDataFrame([("touch", *row(1, "owner"))], "op string, " + SCHEMA))
    found = []
    assert shuffled(spark, lambda: found.append(s.snapshot().count())) < 500 and found == [3001]
    s.write(spark.createDataFrame([("delete", *row(1)), ("touch", *row(2))], "op string, " + SCHEMA))
    assert s.snapshot().count() == 3000 and s.snapshot(first).count() == 3000 and s.snapshot().where("resource_id = 'd1'").count() == 1
