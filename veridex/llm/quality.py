"""Quality rules with adaptive cutoffs.

Every document gets a few counts; the ratios made of them go into log-bucketed quantile sketches (relative error
``ACCURACY``), one per language, source and ratio. A sketch is a table of bucket counts, so sketches merge by adding:
Spark's partial aggregation merges them map-side, and the sketches of all sources of a language, or of everything, are
sums of the same rows. A group with under ``MIN_GROUP`` documents takes its language's sketch, and a language with too
few takes that of all documents. Cutoffs are read off the sketch alone, as ``median + SPREAD * (upper - median)`` and the
mirror image below, ``upper`` and the lower one being the quantiles ``HIGH_Q`` and ``LOW_Q``, and joined back to the
documents. Only where a sketch has no spread on a side (median and quantile in one bucket), so that nothing can be read
off it, a ratio's fixed slack stands in.

Defined cases: null or blank text has no words and fails the base rule; null language or source is a group of its own;
repeated rows count as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches, words_of

SYMBOLS = "#*$%&|<>"
ACCURACY = 0.01
LOG_GAMMA = log((1 + ACCURACY) / (1 - ACCURACY))
MIN_GROUP = 50
LOW_Q, HIGH_Q = 0.1, 0.9
SPREAD = 5.0
#: ratio -> (numerator, denominator, slack above the median where there is no spread, that below it or None: no lower cutoff)
RATIOS = {
    "word_len": ("word_chars", "n_words", 2.0, 1.5),
    "symbols": ("n_symbols", "n_words", 0.1, None),
    "dup_lines": ("n_dup_lines", "n_lines", 0.35, None),
    "repeats": ("n_repeat_words", "n_words", 0.3, None),
    "variety": ("n_distinct", "n_words", 1.0, 0.3),
    "letters": ("n_alpha", "word_chars", 1.0, 0.2),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_alpha")
FEATURES = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts in the order of COUNTS. Repeated words are those covered by a 3-word window that occurs twice."""
    words = words_of(text)
    if not words:
        return (0,) * len(COUNTS)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    repeated = 0
    if len(often) < len(windows):
        upto = 0  # words before this place are counted already
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    odd = symbols + sum(text.count(c) for c in "0123456789.,;:!?'\"()[]{}=+-_/\\@~^`")
    return n, chars, symbols, dup, repeated, lines, len(set(words)), chars - odd


def _count(batches):
    for batch in batches:
        cols = list(zip(*map(counts_of, batch.column("text").to_pylist()))) or [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in cols)],
            names=["doc_id", "lang", "source", *COUNTS],
        )


def features(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(_count, FEATURES)


def _bucket(v):
    return F.when(v <= 0, F.lit(-1_000_000)).otherwise(F.ceil(F.log(v) / LOG_GAMMA)).cast("int")


def _value(bucket):
    return F.when(bucket <= -1_000_000, F.lit(0.0)).otherwise(F.exp((bucket - 0.5) * LOG_GAMMA))


def sketches(feats: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): mergeable by summing n."""
    each = [F.struct(F.lit(k).alias("ratio"), _bucket(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias("bucket")) for k, (a, b, _, _) in RATIOS.items()]
    return (
        feats.where("n_words > 0")
        .select("lang", "source", F.inline(F.array(*each)))
        .groupBy("lang", "source", "ratio", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _cutoffs(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Merge to the given keys and read the cutoffs off. Buckets are bounded by the accuracy, so a window is small."""
    merged = sk.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "ratio")
    cum = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: _value(F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bucket"))))
    return cum.groupBy(*keys, "ratio").agg(F.max("all").alias("docs"), at(LOW_Q).alias("lo"), at(0.5).alias("mid"), at(HIGH_Q).alias("hi"))


def _wide(cut: DataFrame, keys: list[str], tag: str) -> DataFrame:
    cols = [F.max("docs").alias(f"{tag}_docs")]
    for k, (_, _, up, down) in RATIOS.items():
        pick = lambda c: F.max(F.when(F.col("ratio") == k, F.col(c)))  # noqa: E731, B023
        above, below = pick("hi") - pick("mid"), pick("mid") - pick("lo")
        cols.append((pick("mid") + F.when(above > 0, SPREAD * above).otherwise(F.lit(up))).alias(f"{tag}_{k}_max"))
        cols.append((F.lit(-1.0) if down is None else pick("mid") - F.when(below > 0, SPREAD * below).otherwise(F.lit(down))).alias(f"{tag}_{k}_min"))
    return cut.groupBy(*keys).agg(*cols) if keys else cut.agg(*cols)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the cutoffs that held, base_failed and kept."""
    feats = settle(features(docs))
    sk = settle(sketches(feats))
    own = _wide(_cutoffs(sk, ["lang", "source"]), ["lang", "source"], "own").withColumnsRenamed({"lang": "l1", "source": "s1"})
    lang = _wide(_cutoffs(sk, ["lang"]), ["lang"], "lang").withColumnsRenamed({"lang": "l2"})
    whole = _wide(_cutoffs(sk, []), [], "all")
    cuts = own.withColumn("one", F.lit(1)).join(lang, F.col("l1").eqNullSafe(F.col("l2")), "left").join(whole.withColumn("one", F.lit(1)), "one")  # whole: one row
    for k in RATIOS:
        for end in ("max", "min"):
            cuts = cuts.withColumn(
                f"{k}_{end}",
                F.when(F.col("own_docs") >= MIN_GROUP, F.col(f"own_{k}_{end}")).when(F.col("lang_docs") >= MIN_GROUP, F.col(f"lang_{k}_{end}")).otherwise(F.col(f"all_{k}_{end}")),
            )
    cuts = cuts.select("l1", "s1", *(f"{k}_{end}" for k in RATIOS for end in ("max", "min")))
    joined = feats.join(cuts, F.col("lang").eqNullSafe(F.col("l1")) & F.col("source").eqNullSafe(F.col("s1")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.lit(True)
    for k, (a, b, _, _) in RATIOS.items():
        v = F.col(a) / F.greatest(F.col(b), F.lit(1))
        fine = fine & (v <= F.col(f"{k}_max")) & (v >= F.col(f"{k}_min"))
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & F.coalesce(fine, F.lit(True))).drop("l1", "s1")
