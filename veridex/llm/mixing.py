"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have. Equal rows are one unit, which
should have as many times that; the whole part is taken, the fraction is a probability to be rounded. Units of a source
are dealt into blocks; in a block, in falling size, the carried unit meets the next one and random mass moves between
them until one is integral, so the block's expected mass is kept and at most one fractional unit, a small one, is left.
Those residuals meet in blocks of ``FAN``, level by level, until one is left in each source: a reduction tree whose tasks
are all bounded, however large a source is. Random numbers are drawn from seeds made of the source, the level and the
block, so reruns agree. There may be as many sources as documents: ranks and targets come from sorts and sums, too.

Defined cases: null text has size 0; null source is a source of its own, the last; null ids are ids like others; equal rows
share their unit's copies as evenly as can be; a source without words has target 0; an empty table gives an empty result;
extra columns are ignored by ``mix`` and kept by ``take``.
"""

from __future__ import annotations

import zlib
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 2048
FAN = 64
SEED = 7
EPS = 1e-9
#: Equal rows are written out in shares of so many.
CHUNK = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """Units: doc_id, source, size, key (a hash of the text) and m, the number of equal rows."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), F.xxhash64("text").alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("m"))


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source_size, n_units, weight and target.

    Ranks come from a sort whose partitions are counted. A source is full where its weight's share of what is left would pass its cap; what
    it leaves is shared out again by weight among the others, until none is above.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    per = settle(per.orderBy(F.col("source").isNull(), "source")).withColumn("_place", F.monotonically_increasing_id())
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before, upto = {}, 0
    for r in per.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        before[r["part"]], upto = upto, upto + r["count"]
    first = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), part) if before else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((first + within) % len(weights) + 1).cast("int"))
    per = settle(per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("_place"))
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        caps, rest, n = per.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if n == n_full or not rest:
            break
        level, n_full = max(level, (total - caps) / rest), n
    return per.withColumn("target", F.least("cap", F.col("weight") * level) if rest else F.col("cap")).drop("cap")


def pivot(rows: list[tuple[float, int]], rnd: Random) -> tuple[dict[int, int], int, float]:
    """rows: (probability, key) in the order to meet. Returns 0 or 1 for all keys but the carried one, which has (key, probability) or (-1, 0)."""
    done: dict[int, int] = {}
    carried, p = -1, 0.0
    for q, k in rows:
        if q <= EPS or q >= 1 - EPS:
            done[k] = int(q > 0.5)
            continue
        if carried < 0:
            carried, p = k, q
            continue
        s = p + q
        if s < 1 - EPS:
            if rnd.random() * s < q:
                done[carried] = 0
                carried = k
            else:
                done[k] = 0
            p = s
        elif s <= 1 + EPS:
            win = rnd.random() < p
            done[carried], done[k] = int(win), int(not win)
            carried, p = -1, 0.0
        else:
            if rnd.random() * (2 - s) < 1 - q:
                done[carried] = 1
                carried = k
            else:
                done[k] = 1
            p = s - 1
    return done, carried, p


ROUNDED = "doc_id long, source string, size long, key long, m long, whole long, p double, block long, extra int"
NAMES = [x.split()[0] for x in ROUNDED.split(", ")]


def _round(last: bool, level: int, seed: int):
    def run(key, t):
        rows = t.select(["size", "doc_id", "key", "p"]).to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (-rows[i]["size"], rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, rows[i]["key"]))
        rnd = Random(zlib.crc32(f"{seed}|{level}|{key[1].as_py()}|{key[0].as_py()!r}".encode("utf-8", "replace")))
        chances = [r["p"] for r in rows]
        done, carried, p = pivot([(chances[i], i) for i in order], rnd)
        if carried >= 0:
            if last:
                done[carried] = int(rnd.random() < p)
            chances[carried] = p
        t = t.set_column(t.schema.get_field_index("p"), "p", pa.array(chances, pa.float64()))
        return t.set_column(t.schema.get_field_index("extra"), "extra", pa.array([done.get(i) for i in range(len(rows))], pa.int32())).select(NAMES)

    return run


def rounded(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Units with source_size, target and copies, those of all rows of a unit together."""
    units = settle(sizes(docs))
    per = settle(targets(units, weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    facts = per.select(F.col("source").alias("s"), ratio.alias("ratio"), F.ceil(F.col("n_units") / BLOCK).alias("blocks"))
    copies = F.col("ratio") * F.col("m")
    rows = units.join(facts, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "key", "m", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("p"),
        F.pmod(F.xxhash64("doc_id", "size", "key"), F.col("blocks")).alias("block"), F.lit(None).cast("int").alias("extra"),
    )
    most_blocks = per.agg(F.max(F.ceil(F.col("n_units") / BLOCK))).first()[0] or 1
    finished, level = [], 0
    while True:
        last = most_blocks <= 1
        out = settle(rows.groupBy("source", "block").applyInArrow(_round(last, level, seed), ROUNDED))
        finished.append(out.where("extra is not null"))
        if last:
            break
        rows = out.where("extra is null").withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        most_blocks, level = -(-most_blocks // FAN), level + 1
    everything = finished[0]
    for x in finished[1:]:
        everything = everything.unionAll(x)
    facts = per.select(F.col("source").alias("s"), "source_size", "target")
    return everything.join(facts, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "key", "m", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, a row for each row of ``docs``. The options are those of ``rounded``."""
    units = rounded(docs, **options)
    # first in shares, then row by row: no array grows with the number of equal rows
    shares = units.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))))
    rows = shares.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("m"), F.col("lo") + CHUNK) - 1)))
    base = F.floor(F.col("copies") / F.col("m"))
    copies = (base + (F.col("i") < F.col("copies") - base * F.col("m")).cast("long")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns they have."""
    whole = F.xxhash64(*(F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema))
    own = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__row", whole)  # the hash tells null from 0
    # rows of a unit that differ in other columns share its copies in the order of their hashes
    unit = ["doc", "source", "key"]
    kinds = own.select(F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("key"), "__doc", "__row")
    kinds = kinds.groupBy(*kinds.columns).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.withColumn("lo", F.sum("n").over(Window.partitionBy(*unit).orderBy("__row")) - F.col("n"))
    plan = rounded(docs, **options).where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("key").alias("k"), "m", "copies")
    kinds = kinds.join(plan, F.col("doc").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")))
    base = F.floor(F.col("copies") / F.col("m"))
    more = F.least(F.col("n"), F.col("copies") - base * F.col("m") - F.col("lo"))
    kinds = kinds.select("__doc", "__row", (base * F.col("n") + F.greatest(F.lit(0), more)).cast("long").alias("__copies")).where("__copies > 0")
    taken = own.dropDuplicates(["__doc", "__row"]).join(kinds, ["__doc", "__row"])
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*(f"`{c}`" for c in docs.columns))
