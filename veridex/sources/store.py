"""The versioned edge store: an append-only log of revisions, folded to validity intervals.

A revision is a folder of Parquet rows and one small commit file, written last; what has no commit file does not exist.
The commit file is named by the revision it follows and made only if there is none of that name: of two writers that
started at one head, the first wins and the other gets a conflict. Readers pin a revision. The state at a revision is a filter on
the fold, and the fold is one window over the log, so fold(log) is the union of the folds of its keys. Garbage collection
writes the state at its floor as a table, which reads then start from, and removes the log up to there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.analysis import schema_hash
from ..plans.schema import Allowed, Schema, SchemaError, parse, validate
from ..util import written
from .tuples import KEY, SCHEMA, relationships, text

#: A task that groups hashes holds about so many.
ROWS_A_TASK = 1_000_000
LOG = "rev bigint, op string, " + SCHEMA
MAX_UPDATES = MAX_PRECONDITIONS = 1000
MAX_CAVEAT_CONTEXT, MAX_METADATA = 25_000, 65_000
MAX_PAGE = 10_000


class StoreError(RuntimeError):
    """kind: already_exists, conflict, precondition, over_limit, invalid, unsafe_schema, expired_revision."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


# The fold -------------------------------------------------------------------------------------------------------------
def changes(log: DataFrame) -> DataFrame:
    """One change a key and revision: a touch wins over a delete of the same key."""
    w = Window.partitionBy("rev", *KEY).orderBy(F.col("op") == "delete")
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fold(log: DataFrame) -> DataFrame:
    """Rows with [created_rev, deleted_rev): each touch until the next change of its key."""
    nxt = F.lead("rev").over(Window.partitionBy(*KEY).orderBy("rev"))
    return changes(log).withColumn("deleted_rev", nxt).where("op <> 'delete'").withColumnRenamed("rev", "created_rev").drop("op")


def at(versioned: DataFrame, rev: int) -> DataFrame:
    return versioned.where((F.col("created_rev") <= rev) & (F.col("deleted_rev").isNull() | (F.col("deleted_rev") > rev)))


def collect_garbage(versioned: DataFrame, floor: int, floor_time: str | None = None) -> DataFrame:
    """Rows that any revision from the floor on can see; rows expired by the floor's time go too."""
    kept = versioned.where(F.col("deleted_rev").isNull() | (F.col("deleted_rev") > floor))
    return kept.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(floor_time).cast("timestamp"))) if floor_time else kept


def latest(versions: DataFrame, name: str, value: str, rev: int) -> DataFrame:
    """As-of lookup: the last value of each name at a revision; null values are tombstones and hide the name."""
    return versions.where(F.col("rev") <= rev).groupBy(name).agg(F.max_by(value, "rev").alias(value), F.max("rev").alias("rev")).where(F.col(value).isNotNull())


def upsert(live: DataFrame, updates: DataFrame) -> DataFrame:
    """Bulk load: updates replace rows of their keys."""
    return live.join(updates.select(*KEY), list(KEY), "left_anti").unionByName(updates.select(*live.columns))


def conflicts(live: DataFrame, created: DataFrame) -> DataFrame:
    """Keys to be created that are live or come twice."""
    twice = created.groupBy(*KEY).count().where("count > 1").select(*KEY)
    return created.select(*KEY).join(live.select(*KEY), list(KEY), "left_semi").unionByName(twice).distinct()


def repeats(rows: DataFrame) -> bool:
    """Whether a key comes twice. Hashes of keys are grouped, in tasks of bounded rows; equal ones only propose, their keys decide."""
    hashed = rows.select(*KEY, F.xxhash64(*KEY).alias("_h"))
    again = hashed.select("_h").repartition(1 + rows.count() // ROWS_A_TASK, "_h").groupBy("_h").count().where("count > 1").select("_h")
    again = written(again, "repeats")
    if not again.limit(1).count():
        return False
    return bool(hashed.join(again, "_h", "left_semi").groupBy(*KEY).count().where("count > 1").limit(1).count())


def state(base: DataFrame, later: DataFrame, rev: int) -> DataFrame:
    """The live rows at a revision of a table with one live row a key, all touches, and of the log after it.

    Rows of relations that the later log does not name are passed on as they are; so a read costs the table's size once and
    its own changes, not a sort of all.
    """
    names = ["resource_type", "resource_relation"]
    met = [tuple(r) for r in later.select(*names).distinct().collect()]  # at most the schema's
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    if not met:
        return base.select(*columns)
    named = reduce(lambda a, b: a | b, [(F.col("resource_type") == t) & (F.col("resource_relation") == r) for t, r in met])
    kept = base.where(named).join(later.select(*KEY).distinct(), list(KEY), "left_anti")
    return base.where(~named).select(*columns).unionByName(kept.select(*columns)).unionByName(at(fold(later), rev).select(*columns))


def first_by_key(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(*KEY).limit(limit)


def read_page(df: DataFrame, after: str | None, limit: int) -> DataFrame:
    """Ordered by canonical text, past a cursor."""
    got = df.withColumn("tuple", text(df))
    return (got.where(F.col("tuple") > after) if after else got).orderBy("tuple").limit(limit)


# Validation against a schema ------------------------------------------------------------------------------------------
def allowed_rows(schema: Schema) -> list[tuple]:
    return [
        (d.name, m.name, a.type, "*" if a.wildcard else a.relation, a.caveat or "", a.expiration)
        for d in schema.definitions.values() for m in d.members.values() for a in m.allowed
    ]


def violations(spark: SparkSession, schema: Schema, updates: DataFrame) -> DataFrame:
    """Updates no allowed subject type fits, traits included; deletes without a caveat may have any."""
    rows = spark.createDataFrame(allowed_rows(schema) or [("",) * 5 + (False,)], "a_type string, a_rel string, a_subject string, a_subrel string, a_caveat string, a_expiration boolean")
    slot = F.when(F.col("subject_id") == "*", F.lit("*")).otherwise(F.col("subject_relation"))
    any_trait = (F.col("op") == "delete") & F.col("caveat_name").isNull() if "op" in updates.columns else F.lit(False)
    traits = (F.coalesce("caveat_name", F.lit("")) == F.col("a_caveat")) & (F.col("expires_at").isNotNull() == F.col("a_expiration"))
    on = (F.col("resource_type") == F.col("a_type")) & (F.col("resource_relation") == F.col("a_rel")) & (F.col("subject_type") == F.col("a_subject")) & (slot == F.col("a_subrel")) & (any_trait | traits)
    return updates.join(F.broadcast(rows), on, "left_anti")  # rows: as large as the schema


def removed(old: Schema, new: Schema) -> list[tuple[str, str, Allowed | None]]:
    """Relations and allowed subjects that a new schema lacks."""
    out = []
    for d in old.definitions.values():
        for m in d.members.values():
            if m.is_permission:
                continue
            now = new.member(d.name, m.name)
            if now is None or now.is_permission:
                out.append((d.name, m.name, None))
            else:
                out += [(d.name, m.name, a) for a in m.allowed if str(a) not in set(map(str, now.allowed))]
    return out


def orphans(live: DataFrame, old: Schema, new: Schema) -> DataFrame:
    """Live rows that only removed relations or subject types allow."""
    conditions = []
    for t, r, a in removed(old, new):
        c = (F.col("resource_type") == t) & (F.col("resource_relation") == r)
        if a is not None:
            c &= (F.col("subject_type") == a.type) & ((F.col("subject_id") == "*") if a.wildcard else (F.col("subject_relation") == a.relation) & (F.col("subject_id") != "*"))
            c &= F.col("caveat_name").eqNullSafe(F.lit(a.caveat)) & (F.col("expires_at").isNotNull() == F.lit(a.expiration))
        conditions.append(c)
    return live.where(reduce(lambda a, b: a | b, conditions, F.lit(False)))


def suggestions(spark: SparkSession, names: list[str], wrong: str) -> DataFrame:
    """Names that hold the wrong one's letters in order, nearest first."""
    import re

    got = spark.createDataFrame([(n,) for n in names], "name string")
    return got.where(F.col("name").rlike(".*".join(map(re.escape, wrong)))).withColumn("distance", F.levenshtein("name", F.lit(wrong))).orderBy("distance", "name")


# Tokens ---------------------------------------------------------------------------------------------------------------
def token(store_id: str, rev: int, hash_: str = "") -> str:
    return base64.b64encode(f"v1\n{store_id}\n{rev}\n{hash_}".encode()).decode()


def read_token(text_: str, store_id: str) -> tuple[str, int | None]:
    """(status, revision): valid, mismatched (another store's), legacy_empty or unknown."""
    if not text_:
        return "legacy_empty", None
    try:
        v, owner, rev, _ = base64.b64decode(text_, validate=True).decode().split("\n")
        if v != "v1":
            return "unknown", None
        return ("valid" if owner == store_id else "mismatched"), int(rev)
    except ValueError:
        return "unknown", None


# The store ------------------------------------------------------------------------------------------------------------
class Store:
    def __init__(self, spark: SparkSession, root: str, store_id: str = "store"):
        self.spark, self.root, self.id = spark, root.rstrip("/"), store_id
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[int]:
        where = self._fs_path(f"{self.root}/commits")
        if not self._fs.exists(where):
            return []
        return sorted(int(n.split(".")[0]) for s in self._fs.listStatus(where) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _read(self, name: int) -> dict:
        stream = self._fs.open(self._fs_path(f"{self.root}/commits/{name:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commits(self) -> list[int]:
        """All revisions in order. A file's name is the revision before its own, so the names and the last file's content are enough."""
        names = self._names()
        return [*names[1:], self._read(names[-1])["rev"]] if names else []

    @property
    def head(self) -> int:
        return (self.commits() or [0])[-1]

    def _meta(self, rev: int | None = None) -> dict:
        """Schema text, counters, floor and metadata as the last commit up to a revision has them."""
        revs, names = self.commits(), self._names()
        at_ = [n for r, n in zip(revs, names) if rev is None or r <= rev]
        return self._read(at_[-1]) if at_ else {"schema": "", "counters": {}, "floor": 0}

    def metadata(self, rev: int) -> dict | None:
        """What a write of that revision said about itself."""
        meta = self._meta(rev)
        return meta.get("metadata") if meta.get("rev") == rev else None

    def _claim(self, name: str, content: bytes) -> bool:
        """Makes a file with its content in one step; False if it is there already."""
        target, draft = self._fs_path(name), self._fs_path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(content))
        out.close()
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getUri().getScheme() == "file":  # there a rename would replace the target, a hard link does not
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(draft))
                return True
            if self._fs.exists(target):
                return False
            return bool(self._fs.rename(draft, target))  # of stores like HDFS: one step, and refused if the target is there
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def _commit(self, expected: int, rows: DataFrame | None, meta: dict, bulk: bool = False) -> int:
        if self.head != expected:
            raise StoreError("conflict", f"the head is {self.head}, not {expected}")
        rev = max(time.time_ns(), expected + 1)
        folder = f"r{rev:020d}-{uuid.uuid4().hex[:8]}"
        if rows is not None:
            rows.select(F.lit(rev).alias("rev"), "op", *[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/log/{folder}")
        if bulk:
            meta = meta | {"bulk": [*meta.get("bulk", []), rev]}
        own = {} if "rev" in meta else {"metadata": meta.get("metadata")}  # metadata of an earlier commit stays with that
        meta = {k: v for k, v in meta.items() if k != "metadata"} | own | {"rev": rev, "rows": folder if rows is not None else None}
        if not self._claim(f"{self.root}/commits/{expected:020d}.json", json.dumps(meta).encode()):
            if rows is not None:
                self._fs.delete(self._fs_path(f"{self.root}/log/{folder}"), True)
            raise StoreError("conflict", f"another write followed {expected}")
        return rev

    def log(self, after: int = 0, upto: int | None = None) -> DataFrame:
        revs = {r for r in self.commits() if r > after and (upto is None or r <= upto)}
        where = self._fs_path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        found = [n for n in names if n.startswith("r") and int(n[1:21]) in revs]
        if len(found) > len({n[1:21] for n in found}):  # two writers in one nanosecond: the commit says whose rows count
            at_ = dict(zip(self.commits(), self._names()))
            found = [n for n in found if self._read(at_[int(n[1:21])])["rows"] == n]
        paths = [f"{self.root}/log/{n}" for n in sorted(found)]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def snapshot(self, rev: int | None = None) -> DataFrame:
        meta = self._meta()
        rev = self.head if rev is None else rev
        floor = meta["floor"]
        if rev < floor:
            raise StoreError("expired_revision", f"{rev} is below the floor")
        if meta.get("base"):
            return state(self.spark.read.schema(LOG).parquet(f"{self.root}/base/{meta['base']}"), self.log(floor, rev), rev)
        bulk = next((r for r in self._bulk() if r <= rev), None)
        if bulk is not None and not self.log(floor, bulk - 1).limit(1).count():  # the first rows of all: one touch a key
            return state(self.log(bulk - 1, bulk), self.log(bulk, rev), rev)
        return at(fold(self.log(floor, rev)), rev).drop("created_rev", "deleted_rev")

    def _bulk(self) -> list[int]:
        """The revisions of bulk imports, in order."""
        return self._meta().get("bulk", [])

    def schema(self, rev: int | None = None) -> Schema:
        return parse(self._meta(rev)["schema"])

    def write_schema(self, text_: str) -> int:
        new, meta, head = parse(text_), self._meta(), self.head
        validate(new)
        if meta["schema"]:
            left = orphans(self.snapshot(), parse(meta["schema"]), new).limit(1).collect()
            if left:
                raise StoreError("unsafe_schema", f"relationships of {left[0]['resource_type']}#{left[0]['resource_relation']} remain")
        return self._commit(head, None, meta | {"schema": text_, "hash": schema_hash(new)})

    def write(self, updates: DataFrame, must_match=(), must_not_match=(), expected: int | None = None, preconditions=(), metadata: dict | None = None, delete=None, schema: str | None = None) -> int:
        """updates: op (create, touch, delete) and the edge columns. All or nothing.

        preconditions: ("must_match" or "must_not_match", filter on the live rows), tested in their order, after those of the two lists.
        delete: a filter whose matches go in the same revision. schema: the hash of the schema that the writer has seen.
        """
        head = self.head if expected is None else expected
        tests = [*(("must_match", c) for c in must_match), *(("must_not_match", c) for c in must_not_match), *preconditions]
        if len(tests) > MAX_PRECONDITIONS:
            raise StoreError("invalid", "too many preconditions")
        if metadata is not None and len(json.dumps(metadata).encode()) > MAX_METADATA:
            raise StoreError("invalid", "too much metadata")
        facts = updates.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*KEY)), F.max(F.octet_length("caveat_context"))).first()
        if facts[0] > MAX_UPDATES:
            raise StoreError("invalid", "too many updates")
        if facts[0] != facts[1]:
            raise StoreError("invalid", "an update repeats a relationship")
        if (facts[2] or 0) > MAX_CAVEAT_CONTEXT:
            raise StoreError("invalid", "a caveat context is too large")
        meta = self._meta()
        if schema is not None and meta.get("hash") != schema:
            raise StoreError("conflict", "the schema is another by now")
        bad = violations(self.spark, self.schema(), updates).limit(1).collect()
        if bad:
            raise StoreError("invalid", f"not allowed by the schema: {bad[0].asDict()}")
        live = self.snapshot()
        for i, (kind, c) in enumerate(tests):
            if bool(live.where(c).limit(1).count()) != (kind == "must_match"):
                raise StoreError("precondition", f"{kind} {i} has {'no' if kind == 'must_match' else 'a'} match")
        named = updates.select("resource_type", "resource_id").distinct().collect()  # MAX_UPDATES at most
        near = live.where(F.col("resource_type").isin(sorted({r[0] for r in named})) & F.col("resource_id").isin(sorted({r[1] for r in named})))
        if conflicts(near, updates.where("op = 'create'")).limit(1).count():
            raise StoreError("already_exists", "a relationship to create exists")
        gone = updates.where("op = 'delete'").join(near.select(*KEY), list(KEY), "left_semi")  # of what is not there, nothing is deleted
        rows = updates.where("op <> 'delete'").withColumn("op", F.lit("touch")).unionByName(gone.select(*updates.columns))
        if delete is not None:
            swept = live.where(delete).join(updates.select(*KEY), list(KEY), "left_anti").withColumn("op", F.lit("delete"))
            rows = rows.unionByName(swept.select(*rows.columns))
        return self._commit(head, rows, {k: v for k, v in meta.items() if k not in ("rev", "rows", "metadata")} | ({"metadata": metadata} if metadata is not None else {}))

    def import_bulk(self, edges: DataFrame, expected: int | None = None) -> int:
        """Creates all edges in one revision, however many, or none: each must fit the schema, be there once, and not be live."""
        head = self.head if expected is None else expected
        if violations(self.spark, self.schema(), edges).limit(1).count():
            raise StoreError("invalid", "an edge is not allowed by the schema")
        if edges.where(F.octet_length("caveat_context") > MAX_CAVEAT_CONTEXT).limit(1).count():
            raise StoreError("invalid", "a caveat context is too large")
        live = self.snapshot()
        if repeats(edges) or live.limit(1).count() and edges.select(*KEY).join(live.select(*KEY), list(KEY), "left_semi").limit(1).count():
            raise StoreError("already_exists", "an edge exists or comes twice")
        return self._commit(head, edges.withColumn("op", F.lit("touch")), self._meta(), bulk=True)

    def export_page(self, cursor: str | None = None, size: int = 1000, **filter_) -> tuple[DataFrame, str | None]:
        """One page of the edges in the order of their texts, and the cursor of the next (None: no more). A cursor pins the revision and the filter."""
        if not 0 < size <= MAX_PAGE:
            raise StoreError("invalid", f"a page has 1 to {MAX_PAGE} edges")
        asked = hashlib.sha256(json.dumps(filter_, sort_keys=True).encode()).hexdigest()[:16]
        rev, last = self.head, None
        if cursor is not None:
            try:
                version, owner, rev_, hash_, last = base64.b64decode(cursor, validate=True).decode().split("\n")
            except ValueError:
                raise StoreError("invalid", "no cursor") from None
            if (version, owner, hash_) != ("x1", self.id, asked):
                raise StoreError("invalid", "a cursor of another store or request")
            rev = int(rev_)
        rows = read_page(self.snapshot(rev).where(relationships(**filter_)), last, size)
        end = rows.agg(F.count(F.lit(1)), F.max("tuple")).first()
        return rows, base64.b64encode(f"x1\n{self.id}\n{rev}\n{asked}\n{end[1]}".encode()).decode() if end[0] == size else None

    def export_bulk(self, path: str, rev: int | None = None) -> None:
        """All edges at a revision as text files, in order over the files, by a distributed sort."""
        got = self.snapshot(rev)
        got.select(text(got).alias("value")).orderBy("value").write.text(path)

    def delete(self, condition, limit: int | None = None, partial: bool = False) -> tuple[int, bool]:
        """Deletes by filter, in the order of keys up to a limit. Returns the revision and whether the limit was reached."""
        head, found = self.head, self.snapshot().where(condition)
        reached = False
        if limit is not None:
            n = found.limit(limit + 1).count()
            if n > limit and not partial:
                raise StoreError("over_limit", f"more than {limit} match")
            reached, found = n >= limit, first_by_key(found, limit)
        return self._commit(head, found.withColumn("op", F.lit("delete")), self._meta()), reached

    def register_counter(self, name: str, filter_: dict) -> int:
        meta = self._meta()
        if meta["counters"].get(name):
            raise StoreError("already_exists", name)
        return self._commit(self.head, None, meta | {"counters": meta["counters"] | {name: filter_}})

    def unregister_counter(self, name: str) -> int:
        meta = self._meta()
        if not meta["counters"].get(name):
            raise StoreError("precondition", f"no counter {name}")
        return self._commit(self.head, None, meta | {"counters": {k: v for k, v in meta["counters"].items() if k != name}})

    def count(self, name: str) -> int:
        return self.snapshot().where(relationships(**self._meta()["counters"][name])).count()

    def collect_garbage(self, floor: int) -> int:
        """Writes the state at the floor as a table, refuses older reads from then on, and removes the log up to the floor. Rows that later revisions see keep their revisions."""
        meta, head = self._meta(), self.head
        if not meta["floor"] <= floor <= head:
            raise StoreError("invalid", f"the floor lies between {meta['floor']} and {head}")
        log = self.log(meta["floor"], floor)
        if meta.get("base"):
            log = self.spark.read.schema(LOG).parquet(f"{self.root}/base/{meta['base']}").unionByName(log)
        base = f"r{floor:020d}-{uuid.uuid4().hex[:8]}"
        state = at(fold(log), floor).withColumn("op", F.lit("touch")).withColumnRenamed("created_rev", "rev")
        state.select(*[c.split()[0] for c in LOG.split(", ")]).write.parquet(f"{self.root}/base/{base}")
        rev = self._commit(head, None, meta | {"floor": floor, "base": base})
        for folder, keep in (("log", lambda n: int(n[1:21]) > floor), ("base", lambda n: n == base)):
            where = self._fs_path(f"{self.root}/{folder}")
            for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if s.getPath().getName().startswith("r") and not keep(s.getPath().getName()):
                    self._fs.delete(s.getPath(), True)
        return rev


def resolve_revision(kind: str, head: int, now_ns: int, window_ns: int = 5_000_000_000, asked: int | None = None, floor: int = 0) -> int:
    """minimize_latency: the last window boundary that is not past the head; at_least: not before the asked one; exact; fully: the head."""
    if kind == "fully":
        return head
    if kind == "exact":
        if asked is None or asked > head or asked < floor:
            raise StoreError("expired_revision", str(asked))
        return asked
    quantised = max(floor, min(head, now_ns - now_ns % window_ns))
    return max(quantised, min(asked, head)) if kind == "at_least" and asked is not None else quantised


__all__ = ["SchemaError", "Store", "StoreError", "at", "changes", "collect_garbage", "fold"]
