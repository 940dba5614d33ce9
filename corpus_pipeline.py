"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next.

Language id drops what is no language it knows (no letters, or n-grams that no mixture of the learned languages explains
better than chance; a text in several known languages stays), the n-gram join keeps one document of each group of near
duplicates, the secret scan takes secrets out of the texts, mixing repeats documents towards the sources' target weights,
and the last stage encodes the texts.

Defined cases: a null, empty or blank text is no language and goes; rows with a null id are kept by the n-gram join, each of
them; a row that is there several times is kept once by it; null sources are a source; an empty table gives an empty
result; of extra columns none is passed on. Each run writes into a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm import langid, mixing, ngram_join, secrets, spm
from veridex.llm.common import crc_mod, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle, and percent of similarity from which documents are near copies.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False))))
    return langid.attach(docs, model).where((F.col("lang_pred") != langid.UND) & (F.col("evidence") > 0)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, NEAR_SIZE, NEAR_PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces, a row for each copy."""
    return spm.encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "ids", F.greatest(F.size("ids"), F.lit(0)).alias("n_pieces"))


STAGES = [
    ("language id", known_language),
    ("n-gram join", without_near_copies),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Four of the stages are beyond SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
