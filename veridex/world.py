"""A permission world over the driver's tables: its schema, its edges, and what is asked of it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.schema import parse
from .sources.tuples import SCHEMA
from .util import shared_dir

SCHEMA_TEXT = """
use expiration
use self

definition user {}

definition group {
  relation member: user | group#member
}

definition region {
  relation viewer: user | group#member
  permission view = viewer
}

definition nation {
  relation region: region
  relation member: user
  permission view = member + region->view
}

definition order {
  relation owner: user
  relation nation: nation
  relation banned: user
  relation viewer: user | user:* | group#member
  permission edit = owner - banned
  permission audit = owner & viewer
  permission view = (viewer + owner + nation->view) - banned
}

definition supplier {
  relation nation: nation
  permission view = nation->view
}

definition lineitem {
  relation order: order
  relation supplier: supplier
  permission view = order->view
  permission any_party = order->view + supplier->view
  permission both = order->view & supplier->view
}

definition part {
  relation supplier: supplier
  permission any_view = supplier.any(view)
  permission all_view = supplier.all(view)
}
"""

CAVEAT_TEXT = """
use expiration

caveat limit_ok(max double, amount double) {
  amount <= max
}

caveat ip_ok(user_ip ipaddress, cidr string) {
  user_ip.in_cidr(cidr)
}

definition user {}

definition order {
  relation viewer: user with limit_ok
  relation remote: user with ip_ok
  relation lease: user with expiration
  permission view = viewer + lease
  permission strict = viewer & remote
  permission any = viewer + remote
}
"""

COLUMNS = ("resource_type", "resource_id", "resource_relation", "subject_type", "subject_id", "subject_relation", "caveat_name", "caveat_context", "expires_at")
#: A task that drops equal rows holds about so many: 1 million rows of whole numbers.
ROWS_A_TASK = 1_000_000
_COLUMNS = ("resource_type", "resource_id", "resource_relation", "subject_type", "subject_id", "subject_relation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world_schema():
    return parse(SCHEMA_TEXT)


def caveat_schema():
    return parse(CAVEAT_TEXT)


def _id(prefix: str, c) -> object:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _edge(df: DataFrame, rt, rid, rel, st, sid, srel="...") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    cols = [lit(x).alias(c) for x, c in zip((rt, rid, rel, st, sid, srel), _COLUMNS)]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("caveat_name", "string"), ("caveat_context", "string"), ("expires_at", "timestamp"))]
    return df.select(*cols, *none)


_stored: dict[tuple[str, str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Relationships are a stored table, written once a session: every level of a check is then a plain scan with pushed filters.

    Each type's folder is written by itself: a write that deals rows to folders sorts all of them first.
    """
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _stored:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for type_, df in make(spark, sf_dir):
            df.drop("resource_type").write.parquet(f"{path}/resource_type={type_}")
        _stored[key] = path
    return spark.read.schema(SCHEMA).parquet(_stored[key]).select(*COLUMNS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world's relationships."""
    return _table(spark, sf_dir, "relationships", derive_edges)


def caveat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conditional", derive_caveat_edges)


def derive_edges(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The edges of each type of resource."""
    t = lambda n: table(spark, sf_dir, n)
    nation, customer, region, orders, supplier, lineitem = map(t, ("nation", "customer", "region", "orders", "supplier", "lineitem"))
    segment = F.concat(F.lit("seg_"), F.lower("c_mktsegment"))
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    one = spark.range(1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + lineitem.count() // ROWS_A_TASK)
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").repartition(parts, "l_orderkey", "l_linenumber")
    held = lineitem.select("l_partkey", "l_suppkey").repartition(parts, "l_partkey", "l_suppkey")
    line_id = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    of = {
        "nation": [
            _edge(nation, "nation", _id("n", "n_nationkey"), "region", "region", _id("r", "n_regionkey")),
            _edge(customer, "nation", _id("n", "c_nationkey"), "member", "user", _id("c", "c_custkey")),
        ],
        "group": [
            _edge(customer, "group", segment, "member", "user", _id("c", "c_custkey")),
            _edge(customer.select("c_mktsegment").distinct(), "group", "all", "member", "group", segment, "member"),
            _edge(one, "group", "staff", "member", "group", "all", "member"),
        ],
        "region": [
            _edge(one, "region", "r0", "viewer", "group", "staff", "member"),
            _edge(region.where("r_regionkey > 0"), "region", _id("r", "r_regionkey"), "viewer", "user", F.concat(F.lit("c"), (F.col("r_regionkey") * 3).cast("string"))),
        ],
        "order": [
            _edge(orders, "order", _id("o", "o_orderkey"), "owner", "user", _id("c", "o_custkey")),
            _edge(owned, "order", _id("o", "o_orderkey"), "nation", "nation", _id("n", "c_nationkey")),
            _edge(orders.where("o_orderstatus = 'F' and o_custkey % 7 = 0"), "order", _id("o", "o_orderkey"), "banned", "user", _id("c", "o_custkey")),
            _edge(orders.where("o_orderkey % 97 = 0"), "order", _id("o", "o_orderkey"), "viewer", "user", "*"),
            _edge(owned.where("o_orderkey % 11 = 0"), "order", _id("o", "o_orderkey"), "viewer", "group", segment, "member"),
        ],
        "supplier": [_edge(supplier, "supplier", _id("s", "s_suppkey"), "nation", "nation", _id("n", "s_nationkey"))],
        "lineitem": [
            _edge(lines.select("l_orderkey", "l_linenumber").distinct(), "lineitem", line_id, "order", "order", _id("o", "l_orderkey")),
            _edge(lines.distinct(), "lineitem", line_id, "supplier", "supplier", _id("s", "l_suppkey")),
        ],
        "part": [_edge(held.distinct(), "part", _id("p", "l_partkey"), "supplier", "supplier", _id("s", "l_suppkey"))],
    }
    return [(type_, reduce(DataFrame.unionAll, dfs)) for type_, dfs in of.items()]


def derive_caveat_edges(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """Orders viewed up to the owner's balance, from the owner's network, and on leases that end."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    base = lambda df, rel: _edge(df, "order", _id("o", "o_orderkey"), rel, "user", _id("c", "o_custkey"))
    with_columns = lambda df, rel, name, context, expires: df.select(
        F.lit("order").alias("resource_type"), _id("o", "o_orderkey").alias("resource_id"), F.lit(rel).alias("resource_relation"), F.lit("user").alias("subject_type"),
        _id("c", "o_custkey").alias("subject_id"), F.lit("...").alias("subject_relation"), name.alias("caveat_name"), context.alias("caveat_context"), expires.alias("expires_at"),
    )
    null, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    balance = F.concat(F.lit('{"max": '), F.col("c_acctbal").cast("string"), F.lit("}"))
    net = F.concat(F.lit('{"cidr": "10.'), (F.col("o_custkey") % 200).cast("string"), F.lit('.0.0/16"}'))
    rows = (
        with_columns(owned, "viewer", F.lit("limit_ok"), balance, never)
        .unionAll(with_columns(owned, "remote", F.lit("ip_ok"), net, never))
        .unionAll(with_columns(orders.where("o_orderkey % 3 = 0"), "lease", null, null, F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")))
    )
    return [("order", rows)]


def check_items(spark: SparkSession, sf_dir: str, permission: str = "view") -> DataFrame:
    """Each order against its owner and the customer after, each pair once."""
    orders = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "customer").count()
    who = orders.select("o_orderkey", F.explode(F.array(F.col("o_custkey"), (F.col("o_custkey") + 1) % n)).alias("c")).distinct()
    return who.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("/c"), F.col("c").cast("string")).alias("item_id"), F.lit("order").alias("resource_type"), _id("o", "o_orderkey").alias("resource_id"),
        F.lit(permission).alias("permission"), F.lit("user").alias("subject_type"), _id("c", "c").alias("subject_id"), F.lit("...").alias("subject_relation"), F.lit(None).cast("string").alias("context"),
    )


#: The same edges for DuckDB: a CTE named rels.
RELS_SQL = """
rels AS (
  SELECT 'nation' AS rt, 'n' || n_nationkey AS rid, 'region' AS rel, 'region' AS st, 'r' || n_regionkey AS sid, '...' AS srel FROM nation
  UNION ALL SELECT 'nation', 'n' || c_nationkey, 'member', 'user', 'c' || c_custkey, '...' FROM customer
  UNION ALL SELECT 'group', 'seg_' || lower(c_mktsegment), 'member', 'user', 'c' || c_custkey, '...' FROM customer
  UNION ALL SELECT DISTINCT 'group', 'all', 'member', 'group', 'seg_' || lower(c_mktsegment), 'member' FROM customer
  UNION ALL SELECT 'group', 'staff', 'member', 'group', 'all', 'member'
  UNION ALL SELECT 'region', 'r0', 'viewer', 'group', 'staff', 'member'
  UNION ALL SELECT 'region', 'r' || r_regionkey, 'viewer', 'user', 'c' || (3 * r_regionkey), '...' FROM region WHERE r_regionkey > 0
  UNION ALL SELECT 'order', 'o' || o_orderkey, 'owner', 'user', 'c' || o_custkey, '...' FROM orders
  UNION ALL SELECT 'order', 'o' || o_orderkey, 'nation', 'nation', 'n' || c_nationkey, '...' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'order', 'o' || o_orderkey, 'banned', 'user', 'c' || o_custkey, '...' FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 0
  UNION ALL SELECT 'order', 'o' || o_orderkey, 'viewer', 'user', '*', '...' FROM orders WHERE o_orderkey % 97 = 0
  UNION ALL SELECT 'order', 'o' || o_orderkey, 'viewer', 'group', 'seg_' || lower(c_mktsegment), 'member' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 = 0
  UNION ALL SELECT 'supplier', 's' || s_suppkey, 'nation', 'nation', 'n' || s_nationkey, '...' FROM supplier
  UNION ALL SELECT DISTINCT 'lineitem', l_orderkey || '-' || l_linenumber, 'order', 'order', 'o' || l_orderkey, '...' FROM lineitem
  UNION ALL SELECT DISTINCT 'lineitem', l_orderkey || '-' || l_linenumber, 'supplier', 'supplier', 's' || l_suppkey, '...' FROM lineitem
  UNION ALL SELECT DISTINCT 'part', 'p' || l_partkey, 'supplier', 'supplier', 's' || l_suppkey, '...' FROM lineitem)"""
