"""The round trip through ids is one Python step, so that a task keeps one worker with the vocabulary."""

from __future__ import annotations

import corpus_pipeline
from quaystone.llm import bpe, queries


def _rows(df):
    return sorted((r.doc_id, bytes(r.ids), r.text) for r in df.collect())


def test_round_trip_equals_both_steps(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 40)
    docs = spark.createDataFrame([(1, "Some words, again some words. " * 9), (2, None), (3, ""), (3, "é ½ 漢字 <|endoftext|>"), (4, "x" * 200)], "doc_id long, text string")
    assert _rows(bpe.round_trip(docs)) == _rows(bpe.decode_documents(bpe.encode_documents(docs)))
    assert bpe.round_trip(docs.where("false")).count() == 0


def test_one_python_step(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", "en", "a", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for df in (corpus_pipeline.to_tokens(spark, docs, ""), queries.queries()["op1_bpe"](spark, str(tmp_path))):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
