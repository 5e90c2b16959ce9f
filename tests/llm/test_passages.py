"""Repeats by bytes and by words in one pass (op3_suffix_dedup)."""

import hashlib
import random

import numpy as np
import pytest

from quaystone.llm import queries, suffix_dedup

DOCS = "doc_id long, text string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    short, long = words(rng, 55), words(rng, 120)  # 329 and 719 bytes
    found = [(i, f"{words(rng, 30)} {short if i % 2 else long} {words(rng, 40)}") for i in range(12)]
    return [*found, (20, None), (21, ""), (22, words(rng, 200)), (23, short), (24, "é" * 500), (25, "é" * 500), (26, short)]


def test_query_shows_passages_below_the_contracts_length(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    texts = [(r[1] or "").encode() for r in rows]
    by_bytes, by_words = suffix_dedup.brute_force(texts, 400), suffix_dedup.brute_force_words(texts, 50)
    assert len(got) == len(rows)
    for (i, text), data, want, left in zip(rows, texts, by_bytes, by_words, strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), *want)
        assert r.passage_bytes == len(data) - len(left) and r.text == (None if text is None else left.decode())
    assert got[1].n_removed == 0 and got[1].passage_bytes == 329


@pytest.mark.parametrize("length", [20, 400])
def test_both_forms_at_once(spark, rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    got = suffix_dedup.cut(spark.createDataFrame(rows, DOCS), length, unit_bytes=3000, passages=12).collect()
    by_bytes, by_words = suffix_dedup.brute_force(texts, length), suffix_dedup.brute_force_words(texts, 12)
    want = {r[0]: (b[2], w.decode()) for r, b, w in zip(rows, by_bytes, by_words, strict=True)}
    assert {r.doc_id: (hashlib.sha256(r.cut.kept).hexdigest(), r.cut_passages.kept) for r in got} == want


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_names_are_packed_without_loss(kind):
    top = np.iinfo(kind).max
    for names in ([], [0], [top], [0, 1, top - 1, top], np.unique(np.random.default_rng(1).integers(0, top, 5000, dtype=kind))):
        names = np.array(names, kind)
        assert np.array_equal(suffix_dedup.unpack(suffix_dedup.pack(names), kind), names)
