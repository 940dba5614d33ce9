"""Scoring texts by the likelihood of a subword lattice.

A text is a sequence of words and one end. A word, with a space mark before it, is spelled by any sequence of vocabulary
pieces that joins to it, and its probability is the sum over all of them, by a forward recursion in log space over words
of equal length at once. The pieces are weighed by the scores of an existing vocabulary (for a merge vocabulary, whose
scores are ranks, by the reciprocal of the rank), brought up to the corpus as the maximum a posteriori does: those weights
are a Dirichlet prior of ``PRIOR`` observations, and one round of expectation-maximisation on the words of all training
documents adds the expected piece counts under the vocabulary's scores, from the forward and backward recursions,
weighted by how often a word occurs. ``score`` uses the weights so found, ``vocabulary_score`` the vocabulary's alone. They are
numbers per piece, so what is collected is bounded by the vocabulary. Characters without a piece are spelled by byte pieces. The end has a weight of its own, learned from the number of texts, so the model is a
distribution over texts up to the kind of white space.

The base score is that of single words with add-one smoothing.

Word counts are gathered over the whole corpus by shuffles: documents are dealt into blocks of about ``BLOCK_BYTES`` of
text, each block lists its distinct words once, and the counts and lattice scores of those come back to the block by a
join. So a very common word is one row a block, no count table is broadcast, and no task holds more than a block.

Defined cases: null text is empty (only the end is scored); repeated rows are learned from and scored each; texts of any
length are used whole; without training documents all counts are 0; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spm
from .common import shared_dir, small_batches

BLOCK_BYTES = 24 << 20
#: Bytes of text to a part of the distinct words.
PART_BYTES = 16 << 20
#: Observations that the vocabulary's own weights stand for, per piece of the vocabulary.
PRIOR = 1.0
RANK_OFFSET = 10.0
#: Words that go through the lattice together, and bytes of them.
TOGETHER, TOGETHER_BYTES = 1 << 14, 4 << 20


class Lattice(spm.Pieces):
    """All segmentations of words by the pieces of a model, with one log weight a piece."""

    def __init__(self, model):
        super().__init__(model)
        self.usable = np.zeros(self.size, bool)
        self.usable[list(self.ids.values())] = True
        self.usable[self.byte_ids[self.byte_ids >= 0]] = True
        start = np.full(self.size, -np.inf)
        start[self.usable] = self.score[self.usable] if self.unigram else -np.log(np.minimum(-self.score[self.usable], self.size) + RANK_OFFSET)
        start[self.byte_ids[self.byte_ids >= 0]] = start[self.usable].min() - 2.0
        self.start = start - np.logaddexp.reduce(start[self.usable])
        # every piece is an edge here, also those no merge leads to
        self.tables = self.keyed(self.ids)

    def edges(self, words: list[str], weight: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and log weights by word, end and length; a character without a piece weighs as its bytes."""
        ids = self.found(words) if ids is None else ids
        w = np.where(ids >= 0, weight[ids], -np.inf)
        r, j = np.nonzero(ids[:, :, 0] < 0)
        if len(r):
            lone = {c: float(weight[self.char_ids(c)].sum()) for c in {words[a][b] for a, b in zip(r.tolist(), j.tolist())}}
            w[r, j, 0] = [lone[words[a][b]] for a, b in zip(r.tolist(), j.tolist())]
        return ids, w

    def forward(self, words: list[str], weight: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None, ids: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words of one length; with counts, their expected piece counts are added to ``expected``."""
        ids, w = self.edges(words, weight, ids)
        n, length, most = ids.shape
        a = np.full((n, length + 1), -np.inf)
        a[:, 0] = 0
        for j in range(1, length + 1):
            k = min(j, most)
            x = a[:, j - k : j][:, ::-1] + w[:, j - 1, :k]
            top = x.max(axis=1)
            a[:, j] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        if expected is not None:
            b = np.full((n, length + 1), -np.inf)
            b[:, length] = 0
            for i in range(length - 1, -1, -1):
                k = min(most, length - i)
                at = np.arange(k)
                x = b[:, i + 1 : i + 1 + k] + w[:, i + at, at]
                top = x.max(axis=1)
                b[:, i] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            for k in range(1, most + 1):
                post = np.exp(a[:, : length + 1 - k] + w[:, k - 1 :, k - 1] + b[:, k:] - a[:, length :]) * counts[:, None]
                own = ids[:, k - 1 :, k - 1]
                expected += np.bincount(own[own >= 0], weights=post[own >= 0], minlength=self.size)
                if k == 1:
                    for r, j in zip(*(x.tolist() for x in np.nonzero(own < 0))):
                        np.add.at(expected, self.char_ids(words[r][j]), post[r, j])
        return a[:, length]

    def by_length(self, words: list[str]):
        """Places of words of one length, in shares of bounded size."""
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for n, at in groups.items():
            share = max(1, 1_000_000 // ((n + 1) * self.longest))
            for i in range(0, len(at), share):
                yield at[i : i + share]


@lru_cache(maxsize=1)
def lattice(model) -> Lattice:
    return Lattice(model)


def marked(words: list[str]) -> list[str]:
    return [spm.MARK + w for w in words]


def block_words(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() touch exactly A-Z and the six white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _list(key, t):
    """The distinct words of a block, with how often its training documents hold them."""
    n: Counter = Counter()
    seen: set[bytes] = set()
    for text, train in zip(t.column("text").to_pylist(), t.column("train").to_pylist()):
        words = block_words(text)
        if train:
            n.update(words)
        else:
            seen.update(words)
    words = list(seen.union(n))
    return pa.table({"block": pa.array([key[0].as_py()] * len(words), pa.int64()), "word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array([n[w] for w in words], pa.int64())})


def together(batches):
    """Batches joined up to ``TOGETHER`` rows and ``TOGETHER_BYTES`` bytes: a step of the recursion costs about the same for a few words of a length as for hundreds."""
    held, rows, size = [], 0, 0
    for b in batches:
        if held and (rows + b.num_rows > TOGETHER or size + b.nbytes > TOGETHER_BYTES):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
    if held:
        yield pa.concat_batches(held)


def _expect(model, weight):
    def run(batches):
        lat = lattice(model)
        total = np.zeros(lat.size)
        for b in together(batches):
            words, c = marked(b.column("word").to_pylist()), np.asarray(b.column("c"), float)
            for at in lat.by_length(words):
                lat.forward([words[i] for i in at], weight if weight is not None else lat.start, c[at], total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "n"])

    return run


def _weigh(model, weight):
    def run(batches):
        lat = lattice(model)
        w = weight.value
        for b in together(batches):
            words = b.column("word").to_pylist()
            spelled, out, own = marked(words), np.zeros(len(words)), np.zeros(len(words))
            for at in lat.by_length(spelled):
                some = [spelled[i] for i in at]
                ids = lat.found(some)
                out[at] = lat.forward(some, w, ids=ids) / log(10)
                own[at] = lat.forward(some, lat.start, ids=ids) / log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(out), pa.array(own)], names=["word", "c", "lp", "vp"])

    return run


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary_score double"


def _score(train_tokens: int, distinct: int, ends: int, log_end: float):
    low = log10(train_tokens + distinct + 1)

    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        c = np.append(np.asarray(words.column("c"), np.int64), ends)
        base = np.log10(c + 1) - low
        lp, vp = (np.append(np.asarray(words.column(x), float), log_end) for x in ("lp", "vp"))
        place = {w.encode(): i for i, w in enumerate(words.column("word").to_pylist())}
        rows = []
        for text in docs.column("text").to_pylist():
            at = np.fromiter(chain(map(place.__getitem__, block_words(text)), (len(c) - 1,)), np.int64)
            rows.append((len(at), int((c[at] > 0).sum()), train_tokens, float(base[at].sum()), float(lp[at].sum()), float(vp[at].sum())))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
        return pa.table([docs.column("doc_id"), docs.column("train"), *(pa.array(x, t) for x, t in zip(cols, kinds))], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, train, model: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score. ``train``: the column that marks training rows."""
    spark = docs.sparkSession
    model = model or spm.default_model()
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n_bytes // block_bytes))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("long"))
    # Written, not kept in memory: both the counts and the blocks read it, and a lost executor costs no recount.
    folder = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    dealt.groupBy("block").applyInArrow(_list, "block long, word string, n long").write.parquet(f"{folder}/listed")
    listed = spark.read.parquet(f"{folder}/listed")
    # words are short and their lattices long: more and smaller parts than their bytes ask for
    listed.groupBy("word").agg(F.sum("n").alias("c")).repartition(max(1, -(-n_bytes // PART_BYTES))).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, distinct = tokens + ends, distinct + bool(ends)
    lat = lattice(model)
    got = counts.where("c > 0").mapInArrow(_expect(model, None), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(lat.size)
    for r in got:
        n[r["piece"]] = r["n"]
    n[lat.usable] += PRIOR * lat.usable.sum() * np.exp(lat.start[lat.usable])
    total = n.sum() + ends + PRIOR
    weight = spark.sparkContext.broadcast(np.where(n > 0, np.log(np.maximum(n, 1e-300) / total), -np.inf))
    scored = counts.mapInArrow(_weigh(model, weight), "word string, c long, lp double, vp double")
    back = listed.select("block", "word").join(scored, "word").select(F.col("block").alias("of"), "word", "c", "lp", "vp")
    return dealt.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_score(tokens, distinct, ends, log10((ends + PRIOR) / total)), SCORED)
