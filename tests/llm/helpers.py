"""Small documents with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()), StructField("n", LongType()), StructField("word", StringType()), StructField("score", StringType()), StructField("block", StringType()),
])


def prose(seed, n, words=None):
    rnd = random.Random(seed)
    words = words or ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    return " ".join(rnd.choice(words) for _ in range(n))


def hard_rows():
    base = prose(1, 200)
    rows = [
        (1, base, "en", "s0"), (2, base, "en", "s0"), (3, base + " tail", "de", None), (4, None, None, "s1"), (5, "", "en", "s1"), (6, " \n\t ", "en", "s1"),
        (7, "one", "en", "s2"), (8, "one two", "en", "s2"), (9, "one two", "fr", "s2"), (10, prose(2, 20_000), "en", "s0"), (10, prose(2, 20_000), "en", "s0"),
        (11, "x" * 30_000, None, "s3"), (12, 'é 猫 🙂 <|endoftext|> token = "0123456789abcdef0123456789abcdef" #$%', "fr", "s1"), (None, "no id here at all", "en", "s0"),
        (13, base.replace(" ", "\n"), "en", "s0"), (14, base.upper(), "en", "s0"), (15, "a b c\x1cd\x85e", "en", "s0"),
    ]
    rows += [(100 + i, prose(100 + i, 60 + i), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(30)]
    return [(i, t, la, s, len(t or ""), 7, "clash", "clash", "clash") for i, t, la, s in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
