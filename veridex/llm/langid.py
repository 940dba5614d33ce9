"""Language identification as inference of a mixture.

A document is taken as a mixture of languages: each of its character n-grams is drawn from one of them. The n-gram
likelihoods per language are hashed counts of trigrams (``BUCKETS`` numbers a language, a proven bound on the model),
learned from all labelled training documents with whole texts. For a document, expectation-maximisation estimates the
proportions; the language set is selected by penalised likelihood: starting from all learned languages, the smallest share
goes as long as the penalty saved exceeds the log-likelihood lost.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is everything when no labelled document
exists; null labels are not learned from; repeated rows count each; texts are used whole; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 14
ALPHA = 0.1
ROUNDS = 12
#: Overlapping n-grams are not independent: each counts as this share of an observation.
WEIGHT = 1 / 3
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, itself if a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for block in range(0, 0x110000, 0x1000):
        for c in range(block, block + 0x1000):
            if chr(c).isalpha():
                table[c] = c
    return table


def grams(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of the lower-cased letters, words bounded by single spaces; None if there is no letter."""
    if not text:
        return None
    a = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if (a == 32).all():
        return None
    a = np.concatenate(([np.uint32(32)], a, [np.uint32(32), np.uint32(32)])).astype(np.uint64)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    a = np.append(a[keep], np.uint64(32))
    h = a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:] * np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(50)).astype(np.int64)


def _learn(batches):
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            if (g := grams(text)) is not None:
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(g, minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """Probabilities of hashed n-grams by language."""

    def __init__(self, rows):
        self.langs = sorted({r["lang"] for r in rows})
        n = np.zeros((BUCKETS, len(self.langs)))
        at = {x: i for i, x in enumerate(self.langs)}
        for r in rows:
            n[r["bucket"], at[r["lang"]]] = r["n"]
        self.p = (n + ALPHA) / (n.sum(axis=0) + ALPHA * BUCKETS)
        self.log_p = np.log(self.p)

    def mixture(self, text: str | None) -> tuple[list[str], np.ndarray, float]:
        """The selected languages, largest share first, their shares, and how sure the first is."""
        return self.infer(text)[:3]

    def infer(self, text: str | None) -> tuple[list[str], np.ndarray, float, float]:
        """What ``mixture`` gives, and the evidence: the mean log-likelihood of an n-gram over that of one drawn evenly from all buckets."""
        g = grams(text) if self.langs else None
        if g is None:
            return [UND], np.ones(1), 0.0, 0.0
        count = np.bincount(g, minlength=BUCKETS)
        at = np.flatnonzero(count)
        c = count[at] * WEIGHT
        total = c.sum()
        alone = c @ self.log_p[at]
        have = np.argsort(-alone, kind="stable")
        odds = np.exp(alone[have] - alone[have[0]])
        sure = float(1 / odds.sum())
        share = np.full(len(have), 1 / len(have))
        p = self.p[np.ix_(at, have)]

        def fit(p, share):
            for _ in range(ROUNDS):
                mix = p @ share
                new = share * ((c / mix) @ p) / total
                done = np.abs(new - share).max() < 1e-3
                share = new
                if done:
                    break
            return share, float(c @ np.log(p @ share))

        share, like = fit(p, share)
        penalty = 0.5 * np.log(max(total, 2.0)) + 1.0
        while len(have) > 1:
            if len(have) == 2:
                k = int(np.argmin(alone[have]))
                less, fewer = np.ones(1), float(alone[np.delete(have, k)][0])
            else:
                k = int(np.argmin(share))
                rest = np.delete(share, k)
                less, fewer = fit(np.delete(p, k, axis=1), rest / rest.sum())
            if like - fewer > penalty:
                break
            have, p, share, like = np.delete(have, k), np.delete(p, k, axis=1), less, fewer
        order = np.argsort(-share, kind="stable")
        return [self.langs[i] for i in have[order]], share[order], sure, like / total + float(np.log(BUCKETS))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the first language's share, times how sure it is where it stands alone."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and evidence."""
        langs, share, sure, evidence = self.infer(text)
        return langs[0], float(min(1.0, max(0.0, share[0] * (sure if len(langs) == 1 else 1.0)))), evidence


def train(docs: DataFrame) -> Model:
    """From rows with text and lang. What is collected is bounded by BUCKETS rows a language."""
    small_batches(docs.sparkSession)
    known = docs.select("text", "lang").where("text is not null and lang is not null")
    rows = known.mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    return Model(rows)


def attach(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, with lang_pred, score and evidence added (columns of those names are replaced). Without evidence (0 or less), chance explains the text as well as any language learned."""
    docs = docs.drop("lang_pred", "score", "evidence")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [shared.value.judge(t) for t in b.column("text").to_pylist()]
            b = b.append_column("lang_pred", pa.array([x[0] for x in got], pa.string()))
            yield b.append_column("score", pa.array([x[1] for x in got], pa.float64())).append_column("evidence", pa.array([x[2] for x in got], pa.float64()))

    return docs.mapInArrow(run, docs.selectExpr("*", "'' as lang_pred", "0D as score", "0D as evidence").schema)
