"""Two stored layouts of the edges: by resource for walks down, by subject for walks up.

Each is partitioned by the type of its end and a bucket of the id, and sorted within, so that a read by ids opens the
folders of their buckets alone and skips row groups by the ids' bounds. Rows are dealt by ranges over the other end too: an
id with very many edges spans several files and no single task writes them. A read names a type and ids, as few as a
request has; what would have to scan a type whole is refused and goes to the edge table. Many ids are a join: ``beside``.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task that sorts edges holds about so many.
ROWS_A_TASK = 1_000_000
ENDS = {"resource": "subject", "subject": "resource"}


def bucket(id_: Column, buckets: int) -> Column:
    return F.crc32(id_.cast("binary")) % buckets


def write(edges: DataFrame, root: str, buckets: int = 64, ends=tuple(ENDS)) -> None:
    """Writes the layouts (both, or that of one end) below ``root``. ``buckets`` folders a type: as many as keep a folder's files of a reader's size.

    As many ranges as keep a task's rows in memory: a sort that spills writes its rows again.
    """
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + edges.count() // ROWS_A_TASK)
    for end in ends:
        other = ENDS[end]
        rows = edges.withColumn("bucket", bucket(F.col(f"{end}_id"), buckets).cast("int"))
        order = [f"{end}_type", "bucket", f"{end}_id", f"{other}_type", f"{other}_id"]
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.partitionBy(f"{end}_type", "bucket").parquet(f"{root}/by_{end}")


def read(spark: SparkSession, root: str, schema: str, end: str, type_: str, ids, buckets: int = 64) -> DataFrame:
    """The edges of the given ids at one end (``resource`` or ``subject``)."""
    ids = sorted(set(ids))
    if not type_ or not ids:
        raise ValueError("a sharded read names a type and ids; a scan goes to the edge table")
    where = F.col("bucket").isin(sorted({zlib.crc32(i.encode()) % buckets for i in ids}))
    return _table(spark, root, schema, end).where((F.col(f"{end}_type") == type_) & where & F.col(f"{end}_id").isin(ids)).drop("bucket")


def beside(asked: DataFrame, root: str, schema: str, end: str, buckets: int = 64) -> DataFrame:
    """The edges of all ids of ``asked`` (type and id of the end), by a join in which the buckets prune folders."""
    found = _table(asked.sparkSession, root, schema, end)
    keys = asked.select(f"{end}_type", f"{end}_id").distinct().withColumn("bucket", bucket(F.col(f"{end}_id"), buckets).cast("int"))
    return found.join(keys, [f"{end}_type", "bucket", f"{end}_id"], "left_semi").drop("bucket")


def _table(spark: SparkSession, root: str, schema: str, end: str) -> DataFrame:
    return spark.read.schema(schema + ", bucket int").parquet(f"{root}/by_{end}")
