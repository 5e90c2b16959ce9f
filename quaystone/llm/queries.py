"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import ann, bpe, conversations, license_scan, media, mixing, near_dup, quality, ranked_search, suffix_dedup, token_counts, url_filter, warc
from quaystone.llm.shared import materialise, read_table, scratch_path, small_batches


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(read_table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("text").alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.cut(read_table(spark, sf_dir, "documents").select("doc_id", "text"), passages=suffix_dedup.PASSAGE_WORDS)
    removed = lambda cut: F.aggregate(f"{cut}.removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    kept = F.try_validate_utf8(F.col("cut.kept").cast("string"))  # null where a cut parts a character
    digests = "doc_id", "cut.n_bytes", removed("cut").alias("n_removed"), F.size("cut.removed").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"), kept.alias("kept_text")
    # beyond the contract's strings of 400 bytes: repeated passages of 50 words and more, and the text without them
    return done.select(*digests, removed("cut_passages").alias("passage_bytes"), F.when(F.col("text").isNotNull(), F.col("cut_passages.kept")).alias("text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), license_scan.document_path(docs).alias("path"), "text")
    return license_scan.scan(files).withColumnRenamed("file_id", "doc_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.encode(read_table(spark, sf_dir, "documents"))).drop("problem")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(warc.write_archives(read_table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own: a query's result does not depend on what ran before."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit_damaged(read_table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _with_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_quality, op3_suffix_dedup, op4_url_filter, op5_license_scan, op6_ann, op7_near_dup, op8_media, op9_mixing, op10_warc, op11_token_counts, op12_conversations, op13_ranked_search)
    return {f.__name__: _with_small_batches(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.SQL, "op9_mixing": mixing.SQL, "op10_warc": warc.SQL, "op12_conversations": conversations.SQL, "op13_ranked_search": ranked_search.SQL}
