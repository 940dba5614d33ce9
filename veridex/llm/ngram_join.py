"""N-gram Jaccard join by T-occurrence search, and the components of its links.

A document's set are the hashes of its distinct shingles, of three words unless asked otherwise; two documents link when
their sets' Jaccard similarity reaches ``PERCENT``, or what was asked. Fractions below are those at 90 percent.
The result is exact up to collisions of 64-bit hashes:

1. Equal sets are one class. Classes that cannot link are left out, by the shingles with the smallest hashes, ``kept`` of
   each set, about an eighth: two linked sets have at least ``least_shared`` of those in common, so a class that has fewer
   in common with all others together is alone. What is left is tested again among sets of like size: linked sets lie in
   the same or in neighbouring bands of sizes, so shingles held outside of them do not count as shared.
2. On the classes left, shingles are ordered by how many classes hold them, rarest first, and only the first tenth and one
   more of each set are indexed, by shingle and band: linked sets share one of those lists.
3. Lists are gathered around their most typical class (whose shingles most others hold): the classes that meet in any list
   with the same centre form one group, so near copies that share hundreds of lists are sent once. A group is one block, or
   several of ``BLOCK`` shingles, each with the centre. In a block, a T-occurrence search finds for a query all classes that
   reach the required overlap (DivideSkip): the shortest inverted lists are merged by a heap, the longest ones are probed
   by binary search for the candidates left. Where the short lists together hold over ``HEAP`` entries, which is when many
   near copies meet, their merge is counted in an array of the block's classes, with the same result. Queries go on until
   all classes that were no query lie in one component, so the links found connect whatever is linked in the block.
4. In a group of several blocks, the classes outside its largest component are queries to all blocks of the group. Pairs inside
   a component cannot change it, so a large group of near copies is never expanded into pairs, and no link is lost.

Components come from star contractions of the found links, by joins and with reliable checkpoints.

Defined cases: null text or no word: an empty set, linked with nothing; fewer words than a shingle: the whole sequence is one
shingle; repeated rows link with each other unless empty; rows that repeat an id with another text are documents of their
own that share the id; texts of any length are used whole; null ids get a null component; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from functools import lru_cache
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, remove, settle, shared_dir, small_batches

#: Words of a shingle and least similarity, unless a caller asks for others.
SIZE, PERCENT = 3, 90
#: Shingles of the sets in a block, and entries of short lists that a heap merges.
BLOCK, HEAP = 1 << 20, 1 << 12
#: Bytes hashed at once.
SLICE = 1 << 19
K1, K2, K3 = KS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def needed(a, b, percent=PERCENT):
    """The least overlap of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n, percent=PERCENT):
    """So many shingles of a set of n that a linked set must have one of them: one more than it can lack."""
    return n - -(-percent * n // 100) + 1


def depth(n, percent=PERCENT):
    """So many shingles must two sets share among the kept ones, if both are of n or more and neither is kept whole."""
    return prefix(n, percent) // 4 + 2


def kept(n, percent=PERCENT):
    """How many of a set's smallest hashes are compared: of each more than the prefix, the linked sets share one more."""
    return min(n, prefix(n, percent) + depth(n, percent) - 1)


def least_shared(n, percent=PERCENT):
    """What a set of n has in common with any linked set among the kept shingles of both: the depth of the smallest one it can link to, or all that they share."""
    least = -(-percent * n // 100)
    return min(least, depth(least, percent))


def band(n, percent: int):
    """Linked sets lie at most one band apart: a band is a little wider than the ratio of their sizes can be."""
    return F.floor(F.log(n) / (1.001 * max(log(100 / percent), 1e-3)))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and a random number for each, the same for both cases of a letter, 0 for white space."""
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    number = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) if word[b] else 0 for b in range(256)], np.uint64)
    return word, number


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for the places of a slice."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(SLICE, np.uint64(k), np.uint64)))) for k in (int(K1), pow(int(K1), -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= K1
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word in the bytes of texts that begin at ``starts``.

    A word's hash is the sum of its bytes' numbers, each times a power for its place in the word, read off the running sums
    over all bytes.
    """
    word, number = _bytes()
    up, down = _powers()
    before, after, scale, places = ([np.zeros(0, np.uint64)] for _ in range(4))
    carry, far_up, far_down = np.uint64(0), np.uint64(1), np.uint64(1)
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), SLICE):
            hi = min(lo + SLICE, len(data))
            b = data[lo:hi]
            own = word[b]
            begin, stop = own.copy(), own.copy()
            begin[1:] &= ~own[:-1]
            stop[:-1] &= ~own[1:]
            begin[0] &= not (lo and word[data[lo - 1]])
            stop[-1] &= not (hi < len(data) and word[data[hi]])
            cuts = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo
            begin[cuts] = own[cuts]
            cuts = starts[np.searchsorted(starts, lo, "right") : np.searchsorted(starts, hi, "right")] - lo - 1
            stop[cuts] = own[cuts]
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(number[b] * up[: len(b)], out=sums[1:])
            sums = sums * far_up + carry
            at, to = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            before.append(sums[at])
            after.append(sums[to])
            scale.append(down[at] * far_down)
            places.append((at + lo).astype(np.uint64))
            carry, far_up, far_down = sums[-1], far_up * up[len(b)], far_down * down[len(b)]
        return mixed((np.concatenate(after) - np.concatenate(before)) * np.concatenate(scale)), np.concatenate(places).astype(np.int64)


def multiplier(j: int) -> np.uint64:
    """Of the word at place j of a shingle."""
    return KS[j] if j < len(KS) else np.uint64(pow(int(K1), 2 * j + 1, 1 << 64))


def all_shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text, its sorted distinct shingle hashes, under 2^63."""
    n = len(texts)
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8, hi)[lo:] if hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    h, places = word_hashes(data, np.unique(offsets[:-1][offsets[:-1] < len(data)]))
    ends = np.searchsorted(places, offsets)  # words of text i: ends[i] to ends[i + 1]
    with np.errstate(over="ignore"):

        def joined(words: np.ndarray, count: int, size: int) -> np.ndarray:
            x = words[:count] * multiplier(0)
            for j in range(1, size):
                w = words[j : j + count]
                x += (w ^ (w >> np.uint64(29 if j % 2 else 31))) * multiplier(j)
            return mixed(x) >> np.uint64(1)

        x = joined(h, max(0, len(h) - size + 1), size)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= size:
                own = np.sort(x[a : b - size + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])].astype(np.int64))
            elif b > a:  # another length, another kind of shingle
                out.append((mixed(joined(h[a:b], 1, b - a) + np.uint64(b - a)) >> np.uint64(1)).astype(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def _arrays(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _class(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


HEADS = "doc_id long, text_id long, n long, class long, head array<long>"


def _heads(size: int, percent: int):
    def run(batches):
        for b in batches:
            sets = all_shingles(b.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), _arrays([s[: kept(len(s), percent)] for s in sets])],
                names=[x.split()[0] for x in HEADS.split(", ")],
            )

    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            sets = all_shingles(b.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _arrays(sets)], names=["doc", "n", "tokens"])

    return run


class Index:
    """Inverted lists of a block of documents, one after the other in the order of their tokens."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.ends = np.concatenate(([0], np.cumsum(count)))
        order = np.argsort(at, kind="stable")  # documents stand in rising order already
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.sets = sets
        #: Place of list and document as one number: a binary search of it probes one list for one document.
        self.keys = at[order].astype(np.int64) * len(sets) + self.owner

    def search(self, q: int, skip: np.ndarray | None = None) -> list[int]:
        """Documents whose overlap with document q reaches what their sizes require, but for q and those marked in ``skip``."""
        return self.like(self.sets[q], np.arange(len(self.sets)) == q if skip is None else skip, 2)  # a list of one holds q alone

    def like(self, own: np.ndarray, skip: np.ndarray, shortest: int = 1) -> list[int]:
        """Documents whose overlap with the set ``own`` reaches what the sizes require. Lists under ``shortest`` entries are left out."""
        at = np.searchsorted(self.tokens, own)
        there = at < len(self.tokens)
        there[there] = self.tokens[at[there]] == own[there]
        at = at[there]
        size = self.ends[at + 1] - self.ends[at]
        order = np.argsort(size, kind="stable")
        at = at[order[np.count_nonzero(size < shortest) :]]
        least = -(-self.percent * len(own) // 100)  # no linked set has a smaller overlap
        if not len(own) or len(at) < least:
            return []
        n_short = len(at) - (least - 1)
        short, long = [self.owner[self.ends[x] : self.ends[x + 1]] for x in at[:n_short].tolist()], at[n_short:]
        if sum(map(len, short)) > HEAP:
            count = np.bincount(np.concatenate(short), minlength=len(self.sizes))
            docs = np.flatnonzero(count)
            count = count[docs]
        else:
            merged = [(doc, sum(1 for _ in run)) for doc, run in groupby(heapq.merge(*(x.tolist() for x in short)))]
            docs, count = (np.array(x, np.int64) for x in zip(*merged))
        need = needed(len(own), self.sizes[docs], self.percent)
        left = len(long)
        while True:
            ok = (count + left >= need) & ~skip[docs]
            docs, count, need = docs[ok], count[ok], need[ok]
            if not left or not len(docs):
                return docs.tolist()
            some = long[len(long) - left :][: max(16, 65536 // len(docs))]
            key = some[None, :] * len(self.sizes) + docs[:, None]
            place = np.searchsorted(self.keys, key)
            count = count + (self.keys[np.minimum(place, len(self.keys) - 1)] == key).sum(axis=1)
            left -= len(some)


def connect(ids: list[int], sets: list[np.ndarray], first: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is linked in the block; document ``first`` is asked first."""
    index, n = Index(sets, percent), len(ids)
    part, size = np.arange(n), np.ones(n, np.int64)
    links: list[tuple[int, int]] = []
    waiting = [first, *(i for i in range(n) if i != first)]
    largest = -1
    while waiting:
        later = []
        for q in waiting:
            if part[q] == largest:  # whatever links to it from outside is asked itself, or it is once another part is the largest
                later.append(q)
                continue
            for y in index.search(q, part == part[q]):
                a, b = int(part[q]), int(part[y])
                if a != b:
                    if size[a] > size[b]:
                        a, b = b, a
                    part[part == a] = b
                    size[b] += size[a]
                    links.append((ids[q], ids[y]))
            largest = int(part[q]) if largest < 0 else int(max(part[q], part[part[largest]], key=lambda x: size[x]))
        waiting = [q for q in later if part[q] != largest]
    return links


def _table(links) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _tokens(t: pa.Table, column: str) -> list[np.ndarray]:
    return [np.asarray(x.values, np.int64) for x in t.column(column)]


def _block(percent: int):
    def run(key, t):
        ids = t.column("doc").to_pylist()
        return _table(connect(ids, _tokens(t, "tokens"), ids.index(key[0].as_py()), percent))

    return run


def _across(percent: int):
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        links = []
        if queries.num_rows and docs.num_rows:
            index, ids, part = Index(_tokens(docs, "tokens"), percent), docs.column("doc").to_pylist(), np.asarray(docs.column("component"))
            for own_set, own, asked in zip(_tokens(queries, "qtokens"), queries.column("qcomponent").to_pylist(), queries.column("query").to_pylist()):
                links += [(asked, ids[y]) for y in index.like(own_set, part == own)]
        return _table(links)

    return run


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest document reachable, for all documents of links (a, b). Large and small stars by turns."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = (0, 0)
    while edges.limit(1).count():
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("doc"), F.col("v").alias("component"))).distinct()


def _own(tokens: DataFrame) -> DataFrame:
    """(few, own0, own1): of rows (key, held), how many keys only one class holds. ``held`` is 62 bits of the class, and its last bit tells two counts apart."""
    alone = tokens.groupBy("key").agg(F.min("held").alias("lo"), F.max("held").alias("hi")).where(F.shiftright("lo", 2) == F.shiftright("hi", 2))
    per = alone.groupBy(F.shiftright("lo", 2).alias("few"), F.col("lo").bitwiseAND(1).alias("side")).agg(F.count(F.lit(1)).alias("own"))
    return per.groupBy("few").agg(F.max(F.when(F.col("side") == 0, F.col("own"))).alias("own0"), F.max(F.when(F.col("side") == 1, F.col("own"))).alias("own1"))


def classes_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_id, n, class (null: an empty set) and component (a class) for each row with an id."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/shingles-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.option("parquet.enable.dictionary", "false").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    heads = keep(docs.mapInArrow(_heads(size, percent), HEADS), "heads")
    info = settle(heads.select("doc_id", "text_id", "n", "class"))

    # 1. classes with too few shared shingles are alone
    least = F.ceil(percent * F.col("n") / 100)
    p = F.col("n") - least + 1
    shared = lambda own: F.least(F.col("n"), p + F.floor(p / 4) + 1) - F.coalesce(own, F.lit(0))
    enough = F.least(least, F.floor((least - F.ceil(percent * least / 100) + 1) / 4) + 2)
    few = F.shiftright("class", 2)
    usable = heads.where("n > 0 and doc_id is not null").select("doc_id", "text_id", "class", "n", "head")
    tokens = usable.select("class", F.explode("head").alias("key")).select("key", (few * 4).alias("held"))
    first = info.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_id")).alias("r"), F.first("n").alias("n"))
    first = first.select("class", few.alias("few"), "n", F.col("r.doc_id").alias("doc_id"), F.col("r.text_id").alias("text_id"))
    left = settle(first.join(_own(tokens), "few", "left").where(shared("own0") >= enough).drop("own0", "own1"))
    release(spark)
    again = usable.join(left.select("doc_id", "text_id"), ["doc_id", "text_id"], "left_semi").withColumn("band", band(F.col("n"), percent))
    again = again.select("class", "band", F.explode("head").alias("token"))
    side = F.posexplode(F.array("band", F.col("band") + 1)).alias("side", "of")
    tokens = again.select("class", "token", side).select(F.xxhash64("token", "of").alias("key"), (few * 4 + F.col("side")).alias("held"))
    left = left.join(_own(tokens), "few", "left").where((shared("own0") >= enough) | (shared("own1") >= enough))
    left = settle(left.select("doc_id", "text_id"))
    remove(spark, f"{folder}/heads")
    release(spark)

    # 2. the rarest shingles of each class are indexed
    texts = docs.join(left, ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"]).select("text")
    sets = keep(texts.mapInArrow(_sets(size), "doc long, n long, tokens array<long>"), "sets")
    release(spark)
    exploded = sets.select("doc", "n", F.explode("tokens").alias("token"))
    common = exploded.join(exploded.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "token")
    by_doc = Window.partitionBy("doc")
    ranked = common.withColumn("r", F.row_number().over(by_doc.orderBy("c", "token"))).withColumn("shared", F.count(F.lit(1)).over(by_doc)).withColumn("held", F.sum("c").over(by_doc))
    own = F.col("n") - F.col("shared")
    # how many classes hold a shingle of the class, on average: the text that copies were made from has most
    typical = (F.col("held") + own) / F.col("n")
    lists = ranked.where(F.col("r") <= p - own).withColumn("band", band(F.col("n"), percent))
    lists = keep(lists.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "doc", "n", typical.alias("typical")), "lists")
    release(spark)

    # 3. groups around the most typical class of each list
    centre = lists.groupBy("token", "band").agg(F.max(F.struct("typical", "doc")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "band", F.col("m.doc").alias("centre"))
    members = settle(lists.join(centre, ["token", "band"]).select("centre", "doc", "n").distinct())
    groups = members.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    place = F.pmod(F.xxhash64("doc"), F.col("parts"))
    everywhere = lambda parts: F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)
    dealt = members.join(groups, "centre").select("centre", "doc", F.explode(F.when(F.col("doc") == F.col("centre"), everywhere("parts")).otherwise(F.array(place))).alias("part"))
    blocks = dealt.join(sets.select("doc", "tokens"), "doc")
    links = keep(blocks.groupBy("centre", "part").applyInArrow(_block(percent), "a long, b long"), "links")
    release(spark)

    # 4. groups of several blocks: what is outside their largest component meets all blocks
    final = components(links)
    wide = settle(groups.where("parts > 1"))
    if wide.limit(1).count():
        marked = members.join(wide, "centre").join(final, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        marked = settle(marked.select("centre", "doc", "n", "parts", "component"))
        per = marked.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("size"))
        per = per.groupBy("centre").agg(F.max(F.struct("size", "component")).alias("m")).select("centre", F.col("m.component").alias("main"))
        outside = marked.join(per, "centre").where("component <> main")
        asked = outside.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK).alias("qparts"))
        left = outside.join(asked, "centre").select("centre", F.col("component").alias("qcomponent"), F.col("doc").alias("query"), F.pmod(F.xxhash64("doc"), F.col("qparts")).alias("qpart"), F.explode(everywhere("parts")).alias("part"))
        left = left.join(sets.select(F.col("doc").alias("query"), F.col("tokens").alias("qtokens")), "query")
        right = marked.join(asked, "centre").select(F.col("centre").alias("of"), "component", "doc", F.explode(everywhere("qparts")).alias("qof"), place.alias("pof"))
        right = right.join(sets.select("doc", "tokens"), "doc")
        more = left.groupBy("centre", "qpart", "part").cogroup(right.groupBy("of", "qof", "pof")).applyInArrow(_across(percent), "a long, b long")
        final = components(links.unionAll(keep(more, "more")))
    found = final.select(F.col("doc").alias("class"), "component")
    return info.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row, by shingles of ``size`` words and a similarity of ``percent``."""
    rows = settle(classes_of(docs, size, percent))
    least = settle(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")))  # settled: a join of two plain tables can split a large component
    first = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, but only one of those that link, however far: that with the smallest id. A row that is there several times is kept once; rows without an id are all kept."""
    rows = settle(classes_of(docs.select("doc_id", "text"), size, percent).where("doc_id is not null"))
    kept = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_id")).alias("r")).select("r.*")
    kept = kept.unionByName(rows.where("component is null").select("doc_id", "text_id").distinct()).toDF("__id", "__text_id")
    own = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text_id", F.xxhash64("text"))
    single = own.join(kept, ["__id", "__text_id"], "left_semi").dropDuplicates(["__id", "__text_id"])
    return docs.where(F.col("doc_id").cast("long").isNull()).unionByName(single.select(*docs.columns))
