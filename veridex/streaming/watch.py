"""Watch: the log as a stream of changes, by Structured Streaming.

Order is the revision's, so nothing is late and no watermark is needed. Changes come revision by revision, each batch
followed by a checkpoint row that carries only the last revision in it. ``follow`` watches a store: its commit files drive
the stream, and what is published is always the next committed revisions in their order, so neither the order in which
files are seen nor rows without a commit matter. ``tail`` and ``watch`` read a log table whose files arrive in that order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import LOG, Store, StoreError, changes
from ..sources.tuples import relationships, subjects, text


def tail(spark: SparkSession, path: str, after: int = 0, floor: int = 0, files_per_batch: int | None = None) -> DataFrame:
    """Log rows past a revision. A cursor below the floor is refused."""
    if after < floor:
        raise StoreError("expired_revision", f"{after} is below {floor}")
    reader = spark.readStream.schema(LOG)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).where(F.col("rev") > after)


def wanted(object_types=None, filters=None) -> Column:
    """Object types or relationship filters (any of them), not both. A filter's empty subject relation means none."""
    if object_types and filters:
        raise StoreError("invalid", "object types or filters, not both")
    if object_types:
        return F.col("resource_type").isin(list(object_types))
    out = F.lit(False) if filters else F.lit(True)
    for f in filters or ():
        f = dict(f)
        s = f.pop("subject", None)
        if s is not None:
            s = dict(s)
            rel = s.pop("relation", None)
            f["selectors"] = [subjects(**s, relation=None if rel is None else ("exact", rel or None))]
        out = out | relationships(**f)
    return out


def batches(log: DataFrame) -> DataFrame:
    """rev, kind (touch, delete), tuple: what changed, one row a change."""
    got = changes(log)
    return got.select("rev", F.when(F.col("op") == "delete", "delete").otherwise("touch").alias("kind"), text(got).alias("tuple"))


def watch(stream: DataFrame, sink: str, checkpoint: str, condition: Column | None = None, content: tuple[str, ...] = ("relationships", "checkpoints")):
    """Starts the stream into Parquet at ``sink``: changes in revision order, then a checkpoint a batch. Replayed batches overwrite their own folder, so each change arrives once."""

    def one(df: DataFrame, batch: int) -> None:
        out = batches(df.where(condition) if condition is not None else df)
        last = df.agg(F.max("rev").alias("rev")).where("rev is not null").select("rev", F.lit("checkpoint").alias("kind"), F.lit(None).cast("string").alias("tuple"))
        rows = [x for k, x in (("relationships", out), ("checkpoints", last)) if k in content]
        if rows:
            both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
            both.orderBy("rev", F.col("kind") == "checkpoint", "tuple").write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(store: Store, sink: str, checkpoint: str, after: int = 0, condition: Column | None = None, content: tuple[str, ...] = ("relationships", "checkpoints"), files_per_batch: int | None = None):
    """Starts a stream over the store's commits into Parquet at ``sink``: (rev, kind, tuple), kinds touch, delete, schema and checkpoint.

    content: relationships, schema, checkpoints. A batch publishes the committed revisions past what earlier batches published, up to
    its own last; a replayed batch overwrites its own folder.
    """
    floor = store._meta()["floor"]
    if after < floor:
        raise StoreError("expired_revision", f"{after} is below {floor}")
    spark = store.spark
    reader = spark.readStream.schema("rev long, hash string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    progress = lambda batch: store._fs_path(f"{sink}/_progress/{batch}.json")

    def published(batch: int) -> int:
        for b in range(batch - 1, -1, -1):
            if store._fs.exists(progress(b)):
                stream = store._fs.open(progress(b))
                try:
                    return json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return after

    def one(df: DataFrame, batch: int) -> None:
        last, top = published(batch), df.agg(F.max("rev")).first()[0] or 0
        revs = [r for r in store.commits() if last < r <= top]
        if revs:
            log = store.log(last, revs[-1])
            rows = [batches(log.where(condition) if condition is not None else log)] if "relationships" in content else []
            extra = []
            if "schema" in content:
                hashes = [(r, store._meta(r).get("hash")) for r in revs]
                before = store._meta(last).get("hash") if last else None
                for r, h in hashes:
                    if h != before:
                        extra.append((r, "schema", h))
                    before = h
            if "checkpoints" in content:
                extra.append((revs[-1], "checkpoint", None))
            if extra:
                rows.append(spark.createDataFrame(extra, "rev long, kind string, tuple string"))
            if rows:
                both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
                both.orderBy("rev", F.col("kind") == "checkpoint", "tuple").write.mode("overwrite").parquet(f"{sink}/batch={batch}")
        out = store._fs.create(progress(batch), True)
        out.write(bytearray(json.dumps(revs[-1] if revs else last).encode()))
        out.close()

    return reader.json(f"{store.root}/commits").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
