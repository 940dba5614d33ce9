"""The pipeline's stages, each against what it should do to the rows it is given, and all together."""

from collections import Counter

import corpus_pipeline
import sentencepiece

from veridex.llm import secrets, spm

from .helpers import frame, hard_rows
from .test_join_sizes import components
from .test_pairs import families


def test_pipeline(spark, tmp_path):
    rows = [r for r in hard_rows() if r[0] is not None] + families()
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
        if i < len(corpus_pipeline.STAGES) - 1:
            columns = columns or docs.columns
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    known, single, clean, mixed, ids = seen
    gone = {r[0] for r in rows} - {r["doc_id"] for r in known}
    assert {4, 5, 6} <= gone and len(gone) < 12
    want = components([(r["doc_id"], r["text"]) for r in known], 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, (_, c) in want.items() if c == i)
    assert {r["doc_id"]: r["text"] for r in clean} == {r["doc_id"]: secrets.redacted(r["text"]) for r in single}
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed) and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == sorted((r["doc_id"], lib.encode(r["text"])) for r in mixed)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in again) == sorted((r["doc_id"], r["ids"]) for r in ids)
