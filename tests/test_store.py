import pytest
from pyspark.sql import functions as F

from veridex.sources import store, tuples
from veridex.streaming import watch

TEXT = "use expiration caveat small(num int) { num < 5 } definition user {} definition group { relation member: user } definition document { relation viewer: user | group#member | user with small | user with expiration }"


def rows(spark, *items):
    """op, line of canonical text."""
    df = spark.createDataFrame(list(items), "op string, line string")
    return df.select("op", *tuples.parse(F.col("line")))


@pytest.fixture
def st(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.write_schema(TEXT)
    return s


def texts(df):
    return sorted(r["t"] for r in df.select(tuples.text(df).alias("t")).collect())


def test_write_snapshot_time_travel_and_counters(spark, st):
    a = st.write(rows(spark, ("create", "document:one#viewer@user:tom"), ("touch", "document:one#viewer@group:dev#member")))
    b = st.write(rows(spark, ("delete", "document:one#viewer@user:tom"), ("delete", "document:two#viewer@user:tom"), ("touch", 'document:two#viewer@user:ann[small:{"num":3}]')))
    assert texts(st.snapshot(a)) == ["document:one#viewer@group:dev#member", "document:one#viewer@user:tom"]
    assert texts(st.snapshot(b)) == ["document:one#viewer@group:dev#member", 'document:two#viewer@user:ann[small:{"num":3}]']
    st.register_counter("ones", {"resource_type": "document", "resource_ids": ["one"]})
    assert st.count("ones") == 1
    with pytest.raises(store.StoreError):
        st.register_counter("ones", {})
    st.unregister_counter("ones")
    with pytest.raises(store.StoreError):
        st.unregister_counter("ones")
    st.collect_garbage(b)
    with pytest.raises(store.StoreError) as e:
        st.snapshot(a)
    assert e.value.kind == "expired_revision"


@pytest.mark.parametrize("kind,items", [
    ("already_exists", [("create", "document:one#viewer@user:tom")]),
    ("invalid", [("touch", "document:one#viewer@user:*")]),
    ("invalid", [("touch", "document:one#viewer@user:ann[other]")]),
    ("invalid", [("touch", "document:one#viewer@user:ann"), ("delete", "document:one#viewer@user:ann")]),
])
def test_refused_writes_change_nothing(spark, st, kind, items):
    head = st.write(rows(spark, ("create", "document:one#viewer@user:tom")))
    with pytest.raises(store.StoreError) as e:
        st.write(rows(spark, *items))
    assert e.value.kind == kind and st.head == head


def test_preconditions_conflicts_limits_and_schema_safety(spark, st):
    head = st.write(rows(spark, *[("create", f"document:d{i}#viewer@user:tom") for i in range(3)]))
    one = rows(spark, ("touch", "document:new#viewer@user:tom"))
    with pytest.raises(store.StoreError) as e:
        st.write(one, must_match=[tuples.relationships("document", resource_ids=["none"])])
    assert e.value.kind == "precondition"
    with pytest.raises(store.StoreError) as e:
        st.write(one, must_not_match=[tuples.relationships("document")])
    assert e.value.kind == "precondition"
    with pytest.raises(store.StoreError) as e:
        st.write(one, expected=head - 1)
    assert e.value.kind == "conflict"
    with pytest.raises(store.StoreError) as e:
        st.delete(tuples.relationships("document"), limit=2)
    assert e.value.kind == "over_limit"
    _, reached = st.delete(tuples.relationships("document"), limit=2, partial=True)
    assert reached and texts(st.snapshot()) == ["document:d2#viewer@user:tom"]
    with pytest.raises(store.StoreError) as e:
        st.write_schema(TEXT.replace("viewer: user |", "viewer:"))
    assert e.value.kind == "unsafe_schema"


def test_fold_prefers_touch_within_a_revision(spark):
    line = "document:one#viewer@user:tom"
    log = rows(spark, ("touch", line)).withColumn("rev", F.lit(1).cast("long")).unionByName(rows(spark, ("delete", line), ("touch", line)).withColumn("rev", F.lit(2).cast("long"))).unionByName(rows(spark, ("delete", line)).withColumn("rev", F.lit(3).cast("long")))
    got = sorted((r["created_rev"], r["deleted_rev"]) for r in store.fold(log).collect())
    assert got == [(1, 2), (2, 3)]


def test_text_round_trip_and_bad_lines(spark, tmp_path):
    good = ["document:one#viewer@user:tom", "document:one#viewer@group:dev#member", 'document:o/n|e#viewer@user:t=m[small:{"num":3}][expiration:2030-01-02T03:04:05.6000000Z]', "document:one#viewer@user:*"]
    bad = ["document:one#viewer", "doc ument:one#viewer@user:x", "document:one#viewer@user:*#member", "document:one#viewer@user:x[small:{]"]
    path = tmp_path / "edges.txt"
    path.write_text("\n".join(["// note", "", *good, *bad]))
    edges, rest = tuples.read_text(spark, str(path))
    assert texts(edges) == sorted(good)
    assert sorted(r["line"] for r in rest.collect()) == sorted(bad)


def test_watch_resumes_and_checkpoints(spark, tmp_path):
    line = lambda i: f"document:d{i}#viewer@user:tom"
    write = lambda rev, *items: rows(spark, *items).withColumn("rev", F.lit(rev).cast("long")).select(*[c.split()[0] for c in store.LOG.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    write(1, ("touch", line(1)))
    write(2, ("touch", line(2)), ("delete", line(1)))

    def go():
        watch.watch(watch.tail(spark, f"{tmp_path}/log", after=1), f"{tmp_path}/sink", f"{tmp_path}/state").awaitTermination()
        return sorted((r["rev"], r["kind"], r["tuple"] or "") for r in spark.read.parquet(f"{tmp_path}/sink").collect())

    assert go() == [(2, "checkpoint", ""), (2, "delete", line(1)), (2, "touch", line(2))]
    write(3, ("touch", line(3)))
    assert go()[3:] == [(3, "checkpoint", ""), (3, "touch", line(3))]
    with pytest.raises(store.StoreError):
        watch.tail(spark, f"{tmp_path}/log", after=1, floor=2)
    with pytest.raises(store.StoreError):
        watch.wanted(["document"], [{}])


def test_of_two_writers_one_wins(spark, st):
    import threading

    head, got = st.head, []

    def write(i):
        other = store.Store(spark, st.root)
        try:
            got.append(other.write(rows(spark, ("create", "document:one#viewer@user:tom")), expected=head))
        except store.StoreError as e:
            got.append(e.kind)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, got))[1:] == ["conflict"] * 2 or sorted(x for x in map(str, got) if not x.isdigit()) in (["already_exists", "conflict"], ["already_exists"] * 2)
    assert sum(isinstance(x, int) for x in got) == 1 and st.log().count() == 1 and not [n for n in st._names() if n < 0]
    assert st._claim(f"{st.root}/commits/{head:020d}.json", b"{}") is False  # whoever comes later never replaces it


def test_bulk_import_export_and_compaction(spark, st, tmp_path):
    many = spark.range(2500).select(F.concat(F.lit("document:d"), F.lpad("id", 5, "0"), F.lit("#viewer@user:tom")).alias("line"))
    a = st.import_bulk(many.select(*tuples.parse(F.col("line"))))
    for bad in (many.limit(1), many.limit(1).unionAll(many.limit(1)).select(F.regexp_replace("line", "d0", "new").alias("line"))):
        with pytest.raises(store.StoreError) as e:
            st.import_bulk(bad.select(*tuples.parse(F.col("line"))))
        assert e.value.kind == "already_exists" and st.head == a
    page, cursor = st.export_page(size=1000, resource_type="document")
    first = [r["tuple"] for r in page.collect()]
    b = st.delete(tuples.relationships("document", resource_ids=["d02400"]))[0]
    seen = list(first)
    while cursor:
        page, cursor = st.export_page(cursor, 1000, resource_type="document")
        seen += [r["tuple"] for r in page.collect()]
    assert seen == sorted(seen) and len(seen) == 2500  # the cursor's revision, not the head's
    _, cursor = st.export_page(size=10)
    for c, f in ((cursor, {"relation": "viewer"}), ("x", {})):
        with pytest.raises(store.StoreError):
            st.export_page(c, 10, **f)
    st.export_bulk(f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").orderBy("value").collect()] == [x for x in seen if "d02400" not in x]
    st.collect_garbage(b)
    assert len(list((tmp_path / "store" / "log").glob("r*"))) == 0 and st.snapshot().count() == 2499
    c = st.write(rows(spark, ("delete", "document:d00001#viewer@user:tom"), ("touch", "document:d00002#viewer@user:tom")), metadata={"by": "me"})
    assert st.snapshot(b).count() == 2499 and st.snapshot(c).count() == 2498 and st.metadata(c) == {"by": "me"} and st.metadata(b) is None
    st.collect_garbage(c)
    assert st.snapshot().count() == 2498


def test_preconditions_in_order_and_delete_with_updates(spark, st):
    st.write(rows(spark, ("create", "document:one#viewer@user:tom"), ("create", "document:two#viewer@user:tom")))
    no, yes = tuples.relationships("document", resource_ids=["none"]), tuples.relationships("document", resource_ids=["one"])
    with pytest.raises(store.StoreError, match="must_not_match 0"):
        st.write(rows(spark, ("touch", "document:new#viewer@user:tom")), preconditions=[("must_not_match", yes), ("must_match", no)])
    st.write(rows(spark, ("touch", "document:one#viewer@user:ann")), delete=tuples.relationships("document"))
    assert texts(st.snapshot()) == ["document:one#viewer@user:ann"]
    with pytest.raises(store.StoreError) as e:
        st.write(rows(spark, ("touch", "document:new#viewer@user:tom")), schema="another")
    assert e.value.kind == "conflict"


def test_following_a_store(spark, st, tmp_path):
    revs = [st.write(rows(spark, ("touch", f"document:d{i}#viewer@user:tom"))) for i in range(3)]
    # rows without a commit are never published
    rows(spark, ("touch", "document:ghost#viewer@user:tom")).withColumn("rev", F.lit(revs[-1] + 5)).select(*[c.split()[0] for c in store.LOG.split(", ")]).write.parquet(f"{st.root}/log/r{revs[-1] + 5:020d}-lost")

    def go():
        watch.follow(st, f"{tmp_path}/sink", f"{tmp_path}/state", content=("relationships", "schema", "checkpoints"), files_per_batch=2).awaitTermination()
        return [(r["batch"], r["rev"], r["kind"]) for r in spark.read.parquet(f"{tmp_path}/sink").orderBy("batch", "rev", F.col("kind") == "checkpoint").collect()]

    got = go()
    assert [r for _, r, k in got if k == "touch"] == revs and [k for _, _, k in got].count("schema") == 1
    marks = [(b, r) for b, r, k in got if k == "checkpoint"]
    assert marks == sorted(marks) and marks[-1][1] == revs[-1]
    assert all(r <= dict(marks)[b] and all(r > m for c, m in marks if c < b) for b, r, _ in got)
    last = st.write(rows(spark, ("delete", "document:d0#viewer@user:tom")))
    assert [(r, k) for _, r, k in go()][-2:] == [(last, "delete"), (last, "checkpoint")]


def test_tokens_and_consistency():
    t = store.token("me", 42, "abc")
    assert store.read_token(t, "me") == ("valid", 42) and store.read_token(t, "you") == ("mismatched", 42)
    assert store.read_token("", "me")[0] == "legacy_empty" and store.read_token("%%", "me")[0] == "unknown"
    assert store.resolve_revision("fully", 100, 97) == 100
    assert store.resolve_revision("minimize_latency", 100, 97, window_ns=10) == 90
    assert store.resolve_revision("at_least", 100, 97, window_ns=10, asked=95) == 95
    with pytest.raises(store.StoreError):
        store.resolve_revision("exact", 100, 97, asked=101)


def test_object_text(spark):
    df = spark.createDataFrame([("document:one#viewer",), ("document:one",), ("document:*",), ("doc ument:x",), ("document:" + "x" * 1025,)], "t string")
    got = [tuple(r) for r in df.select(*tuples.parse_object(F.col("t"))).collect()]
    assert got == [("document", "one", "viewer"), ("document", "one", "..."), ("document", "*", "..."), (None, None, None), (None, None, None)]
