"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes least distance by the usual extra coordinate: vectors are completed to the largest norm,
queries are scaled to it. Each of ``TABLES`` tables hashes with ``HASHES`` Gaussian projections cut into slots of width
``WIDTH`` times the expected neighbour distance. A query visits its own bucket and those with slots off by one, in the
order of the estimated chance that a neighbour at that distance lies in them, until the chances of the table add up to
its share of ``TARGET``. The candidates of all tables are merged and reranked exactly, in double precision.

The hashes decide what is sent where. The first slots of a bucket are its cell: so many that a cell holds about ``CELL``
vectors where they spread evenly. A vector goes to its cell in each table, a query only to the cells of the buckets it
visits, and in a cell only vectors in visited buckets are candidates. A cell with more than ``BLOCK`` vectors or
``QUERIES`` queries is dealt out by hash, so no task depends on how full a bucket is.

A query is answered in its own cells first. The score of the last row it needs among those answers is its floor: the other
cells give back only what reaches it, so the rows made do not grow with the number of cells visited, and none is lost.

A query left with fewer than ``k + 1`` classes, though its vector length has more, is scored against all vectors in blocks:
the expected distance is one for all queries, and too small for those that lie apart.

Every row is indexed. Only the expected distance is fitted, on at most ``SAMPLE`` vectors. Where over a tenth of a block are
candidates they are multiplied as a whole and masked, else gathered. Equal vectors are indexed once with their ``k + 1``
smallest ids, which is all that a result of ``k`` rows with ties to smaller ids can hold.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors are compared with those of their own length; repeated rows are candidates each (of one
id, the pair with itself is left out); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import product
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shared_dir, small_batches

TABLES, HASHES, WIDTH, TARGET = 3, 6, 1.3, 0.96
SAMPLE, SEED = 4096, 11
CELL, BLOCK, QUERIES = 1 << 13, 1 << 16, 2048
#: Slots that a projection's values spread over, about.
SPREAD = 4


def usable(vectors: DataFrame) -> DataFrame:
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(ok)


class Tables:
    """The projections for one vector length, the same on every machine, and the estimates for probing."""

    def __init__(self, dim: int, norm: float, near: float):
        rng = np.random.default_rng([SEED, dim])
        self.norm, self.near, self.width = norm, near, WIDTH * near
        self.a = rng.normal(size=(TABLES, dim + 1, HASHES))
        self.b = rng.uniform(0, 1, size=(TABLES, HASHES)) * self.width
        self.steps = np.array(list(product((-1, 0, 1), repeat=HASHES)))
        self.share = 1 - (1 - TARGET) ** (1 / TABLES)

    def places(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and the distance from each slot's lower end."""
        f = x @ self.a[t] + self.b[t]
        h = np.floor(f / self.width)
        return h.astype(np.int64), f - h * self.width

    def completed(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))[:, None]])

    def scaled(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q * (self.norm / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])

    def probes(self, rest: np.ndarray) -> list[np.ndarray]:
        """For each row of places in the slots, the steps to visit, likeliest first."""
        ends = np.stack([-self.width - rest, -rest, self.width - rest, 2 * self.width - rest], axis=0) / self.near
        below = normal(ends)
        p = np.diff(below, axis=0)  # step, query, hash
        chance = np.ones((rest.shape[0], len(self.steps)))
        for j in range(HASHES):
            chance *= p[self.steps[:, j] + 1, :, j].T
        order = np.argsort(-chance, axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(chance, order, axis=1), axis=1)
        return [o[: int(np.searchsorted(u, self.share)) + 1] for o, u in zip(order, upto)]


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7, by a fixed rational approximation."""
    x = np.abs(z) / sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * y)


def _codes(h: np.ndarray) -> np.ndarray:
    """One number for each row of slots; slots within one step of each other differ by the same for any row."""
    factors = np.array([np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ** 3 + 0x1234567) & (2**64 - 1)) for j in range(h.shape[1])])
    with np.errstate(over="ignore"):
        return (h.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)


def best_of(ids: np.ndarray, x: np.ndarray, lengths: float, q: np.ndarray, floor: np.ndarray, hits: np.ndarray, k: int):
    """(place of the query, ids, scores) of the k best of the vectors that ``hits`` marks for each query and that reach its floor, ties of the last one by smaller ids."""
    dense = q @ x.T if hits.mean() > 0.1 else None
    for i in range(len(q)):
        at = np.flatnonzero(hits[i])
        s = dense[i, at] if dense is not None else x[at] @ q[i]
        # what rounding may have put below the floor or the k-th stays in
        slack = 1e-9 * lengths * np.linalg.norm(q[i])
        near = s >= floor[i] - slack
        at, s = at[near], s[near]
        if len(at) > k:
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - slack]
        s = (x[at] * q[i]).sum(axis=1)
        at, s = at[s >= floor[i]], s[s >= floor[i]]
        if not len(at):
            continue
        best = np.lexsort((ids[at], -s))[:k]
        yield i, ids[at][best], s[best]


def search_cell(tables: Tables, t: int, ids: np.ndarray, x: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
    """The best of those vectors of a cell whose buckets in table t each query visits, from its floor up."""
    buckets, of = np.unique(_codes(tables.places(tables.completed(x), t)[0]), return_inverse=True)
    stepped, scaled = _codes(tables.steps), tables.scaled(q)
    for lo in range(0, len(q), 64):
        h, rest = tables.places(scaled[lo : lo + 64], t)
        visited = np.zeros((len(h), len(buckets)), bool)
        for i, (own, steps) in enumerate(zip(_codes(h), tables.probes(rest))):
            with np.errstate(over="ignore"):
                visited[i] = np.isin(buckets, stepped[steps] + own)
        for i, got, s in best_of(ids, x, tables.norm, q[lo : lo + 64], floor[lo : lo + 64], visited[:, of], k):
            yield lo + i, got, s


def _array(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), dim)


def _cells(make, first: int, role: str):
    """Rows of (dim, t, cell) and the columns given: each vector in its cell of each table, each query in its own cell ("home") or in the others it visits ("away")."""

    def run(batches):
        for b in batches:
            lengths = np.asarray(b.column("e").value_lengths())
            for dim in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dim))
                tables, x = make(dim), _array(part.column("e"), dim)
                moved = _codes(tables.steps[:, :first])
                for t in range(TABLES):
                    h, rest = tables.places((tables.completed if role == "vector" else tables.scaled)(x), t)
                    own = _codes(h[:, :first])
                    if role == "away":
                        with np.errstate(over="ignore"):
                            seen = [(c := np.unique(moved[steps]) + o)[c != o] for o, steps in zip(own, tables.probes(rest))]
                        at, cell = np.repeat(np.arange(len(x)), [len(c) for c in seen]), np.concatenate(seen)
                    else:
                        at, cell = np.arange(len(x)), own
                    n = len(at)
                    taken = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cell.view(np.int64)), *taken.columns],
                        names=["dim", "t", "cell", *taken.schema.names],
                    )

    return run


FOUND = "class_id long, near_id long, score double"


def _found(rows) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), ()]
    asked = [np.full(len(got), q) for q, got in zip(cols[0], cols[1])]
    a, b, s = (np.concatenate(c) if c else np.zeros(0) for c in (asked, cols[1], cols[2]))
    return pa.table({"class_id": pa.array(a.astype(np.int64)), "near_id": pa.array(b.astype(np.int64)), "score": pa.array(s.astype(float))})


def in_cells(classes: DataFrame, wanted: DataFrame, first: int, role: str, make, k: int) -> DataFrame:
    """The best candidates, from its floor up, of each class in ``wanted`` in its own cells or in the others it visits."""
    spark = classes.sparkSession
    kind = classes.schema["e"].dataType.simpleString()
    keys = ["dim", "t", "cell"]
    placed = classes.select("class_id", "e").mapInArrow(_cells(make, first, "vector"), f"dim int, t int, cell long, class_id long, e {kind}")
    asked = wanted.select(F.col("class_id").alias("query"), "e", "floor").mapInArrow(_cells(make, first, role), f"dim int, t int, cell long, query long, e {kind}, floor double")
    # written, so that the size of what the joins below could broadcast is known and checked
    folder = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    facts = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).join(asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("qparts")), keys)
    facts.write.parquet(folder)
    facts = spark.read.parquet(folder)
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = placed.join(facts, keys).select(*keys, F.pmod(F.xxhash64("class_id"), F.col("parts")).alias("part"), spread("qparts").alias("qpart"), "class_id", "e")
    right = asked.join(facts, keys).select(*(F.col(c).alias(f"q{c}") for c in keys), spread("parts").alias("of"), F.pmod(F.xxhash64("query", F.lit(1)), F.col("qparts")).alias("qof"), "query", F.col("e").alias("qe"), "floor")

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        dim, t = key[0].as_py(), key[1].as_py()
        ids, x, q, asked = left.column("class_id").to_numpy(), _array(left.column("e"), dim), _array(right.column("qe"), dim), right.column("query").to_numpy()
        return _found([(asked[i], got, s) for i, got, s in search_cell(make(dim), t, ids, x, q, right.column("floor").to_numpy(), k)])

    return left.groupBy(*keys, "part", "qpart").cogroup(right.groupBy("qdim", "qt", "qcell", "of", "qof")).applyInArrow(task, FOUND)


def hashed(classes: DataFrame, wanted: DataFrame, n: int, make, k: int) -> DataFrame:
    """The best candidates of each class in ``wanted`` in the cells it visits, its k best among them."""
    first = min(HASHES, max(1, ceil(log(max(1.0, n / CELL), SPREAD))))
    wanted, none = wanted.select("class_id", "e"), F.lit(float("-inf"))
    home = settle(in_cells(classes, wanted.withColumn("floor", none), first, "home", make, k).groupBy("class_id", "near_id").agg(F.max("score").alias("score")))
    ranked = home.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "near_id")))
    floors = ranked.where(F.col("r") == k).select("class_id", F.col("score").alias("floor"))
    bounded = settle(wanted.join(floors, "class_id", "left").withColumn("floor", F.coalesce("floor", none)))
    return home.unionByName(in_cells(classes, bounded, first, "away", make, k))


def everything(classes: DataFrame, wanted: DataFrame, n: int, n_asked: int, norm: float, k: int) -> DataFrame:
    """The best of each block of all vectors for each class in ``wanted``."""
    blocks, query_blocks = -(-n // BLOCK), -(-n_asked // QUERIES)

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        dim = key[0].as_py()
        ids, x, q, asked = left.column("class_id").to_numpy(), _array(left.column("e"), dim), _array(right.column("qe"), dim), right.column("query").to_numpy()
        return _found([(asked[lo + i], got, s) for lo in range(0, len(q), 64) for i, got, s in best_of(ids, x, norm, q[lo : lo + 64], np.full(64, -np.inf), np.ones((len(q[lo : lo + 64]), len(x)), bool), k)])

    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = classes.select("class_id", "e", F.size("e").alias("dim"), F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("vb"), spread(query_blocks).alias("qb"))
    right = wanted.select(F.col("class_id").alias("query"), F.col("e").alias("qe"), F.size("e").alias("qdim"), spread(blocks).alias("qvb"), F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(query_blocks)).alias("qqb"))
    return left.groupBy("dim", "vb", "qb").cogroup(right.groupBy("qdim", "qvb", "qqb")).applyInArrow(task, FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``queries`` among all other rows of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    v = usable(vectors)
    first = v.withColumn("n", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = settle(first.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("class_id", F.col("members")[0]))
    asked = settle(usable(queries).withColumnRenamed("vec_id", "query_id").join(classes.select("e", "class_id"), "e").select("query_id", "class_id"))
    wanted = settle(classes.select("class_id", "e").join(asked.select("class_id").distinct(), "class_id", "left_semi"))
    norm = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, b: a + b * b))
    n, most = classes.agg(F.count(F.lit(1)), F.max(norm(F.col("e").cast("array<double>")))).first()
    if not n or not wanted.limit(1).count():
        found = spark.createDataFrame([], FOUND)
    else:
        near, most = {}, float(most)
        sample = classes.select("class_id", "e").orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).collect()
        for dim in {len(r["e"]) for r in sample}:
            near[dim] = expected(np.array([r["e"] for r in sample if len(r["e"]) == dim], float), most, k * len(sample) / n)

        def make(dim: int) -> Tables:
            return Tables(dim, most, near.get(dim, most))

        found = settle(hashed(classes, wanted, n, make, k + 1).groupBy("class_id", "near_id").agg(F.max("score").alias("score")))
        per_dim = classes.groupBy(F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("there"))
        have = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("have"))
        sized = wanted.withColumn("dim", F.size("e")).join(per_dim, "dim").join(have, "class_id", "left")
        short = settle(sized.where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k + 1), "there")).select("class_id", "e"))
        n_short = short.count()
        if n_short:
            found = found.join(short, "class_id", "left_anti").unionByName(everything(classes, short, n, n_short, most, k + 1))
    # of each class, the k + 1 best: the query itself may be one of them
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "near_id"))).where(F.col("r") <= k + 1).drop("r")
    members = classes.select(F.col("class_id").alias("near_id"), F.explode("members").alias("vec_id"))
    rows = best.join(members, "near_id").join(asked, "class_id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def expected(x: np.ndarray, norm: float, rank: float) -> float:
    """The distance within which most neighbours of the wanted rank lie, from up to 256 queries of the sample."""
    q = x[:256]
    full = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(axis=1), 0))[:, None]])
    scaled = np.hstack([q * (norm / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])
    d = np.sqrt(np.maximum((scaled * scaled).sum(axis=1)[:, None] + (full * full).sum(axis=1)[None] - 2 * scaled @ full.T, 0))
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    d.sort(axis=1)
    at = min(max(0, round(rank) - 1), d.shape[1] - 1)
    got = d[:, at][np.isfinite(d[:, at])]
    return max(float(np.quantile(got, 0.6)) if len(got) else norm, 1e-6 * norm)
