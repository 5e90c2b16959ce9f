"""A corpus pipeline of five of the corpus operators, from raw documents to tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.

Defined results
    null text: scored and deduplicated as the empty text, has no words and so leaves
    the mix. Texts that are empty, or have become so, leave with it. Very long texts are
    worked on whole. Null and repeated ids: rows are told apart by themselves, never by
    id. Repeated rows: one stays. Ties: the least id, then the first row. Empty table:
    empty result. Columns beyond those of ``documents``, of any name, are carried along
    to the last stage and end there.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import bpe, mixing, near_dup, quality, suffix_dedup
from quaystone.llm.shared import materialise, read_table, small_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dup.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur again are cut out; documents stay."""
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row."""
    decoded = bpe.round_trip(docs)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def _stage(function):
    """A stage with the batches that whole texts need."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return function(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _stage(keep_quality)),
    ("near_dup", _stage(keep_one_of_each)),
    ("suffix_dedup", _stage(remove_repeats)),
    ("mixing", _stage(mix_sources)),
    ("bpe", _stage(to_tokens)),
]

#: SQL cannot express the classifier, the signatures and the tokens; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
