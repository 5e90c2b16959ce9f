"""Token counts of texts from a digest cache.

A text's key is the SHA-256 digest of its normalised content; a tokenizer's version is
the digest of its file, its library's name and version, and of `RULES`. The cache is a
table of Parquet files, a folder per version, with a row per key. `count_tokens`

1. makes the keys of all rows (in the JVM, texts stay where they are) and counts how
   many rows each key has;
2. takes away the keys that the cache holds: what is left are the distinct misses;
3. encodes one text of each miss and appends the counts to the cache;
4. joins all rows' keys to the cache.

So a second run over the same texts, or over copies of them, encodes nothing. Only the
texts of misses are shuffled, and of keys that very many rows share only one per
partition. Few misses are sent to the texts instead (`FEW` keys at the most).

Normalised content is what the tokenizer tells apart: a sentencepiece model whose
normaliser is the identity writes blanks as U+2581, so texts that differ only in that are
one key. Others' contents are the texts themselves.

Texts of such a model are encoded in parts of about `PART` characters: no piece has
U+2581 after another character, so a single blank between two other characters ends what
can be merged, and the next part begins with the blank that the model puts before it.

A run that ends early leaves the cache with some of its misses, or none; counts are facts,
so two runs that append the same key do no harm.

Defined results
    null text: as the empty text (0 bytes, 0 tokens). Very long texts: counted whole.
    Repeated rows: each has a result, the text is encoded once. Null and repeated ids: rows
    are never told apart by id. Ties do not occur. Empty table: empty result, and the cache
    stays as it is. Columns other than ``doc_id`` and ``text``, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.shared import HOT_KEYS, HOT_ROWS, materialise, spread_join

LIMIT = 4096
#: Characters of a text encoded at once, and of texts in one call.
PART, CALL = 1 << 16, 1 << 18
#: Bytes of texts for each encoding task, where the session's number of partitions would make larger ones.
TASK_BYTES = 32 << 20
#: So many missing keys (of 32 bytes) are sent to all tasks; more are joined by a shuffle.
FEW = 50_000
#: Part of the version: how texts are encoded beyond what the file says.
RULES = "no begin, end or added special tokens; special strings as the library's default; no truncation, no padding"
CACHE = "digest binary, n_tokens long, version string"

_BLANK = "▁"
_CUT = re.compile("(?<=[^ ▁])[ ▁](?=[^ ▁])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts tokens with one of the two libraries, by the kind of file."""

    def __init__(self, content: bytes, kind: str):
        if kind == "model":
            import sentencepiece

            self.library = f"sentencepiece {sentencepiece.__version__}"
            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
            probe = "ﬁ１\t a▁b "
            self.folds = model.normalize(probe) == _BLANK + probe.replace(" ", _BLANK)
            self.parts = self.folds and all(re.fullmatch(f"{_BLANK}*[^{_BLANK}]*", model.id_to_piece(i)) for i in range(model.get_piece_size()))
        elif kind == "json":
            import tokenizers

            self.library = f"tokenizers {tokenizers.__version__}"
            model = tokenizers.Tokenizer.from_str(content.decode())
            model.no_truncation()
            model.no_padding()
            self._ids = lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
            self.folds = self.parts = False
        else:
            raise ValueError(f"a tokenizer file ends in .model or .json, not in .{kind}")
        self.version = hashlib.sha256(b"\0".join([content, self.library.encode(), RULES.encode()])).hexdigest()

    def cut(self, text: str) -> Iterator[str]:
        """Parts of ``text`` whose tokens are those of the whole, the blanks between them left out."""
        at = 0
        while self.parts and len(text) - at > PART:
            found = _CUT.search(text, at + PART)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:] if at else text

    def counts(self, texts: list[str]) -> list[int]:
        out, call, owner, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            for k, ids in zip(owner, self._ids(call), strict=True):
                out[k] += len(ids)
            call.clear()
            owner.clear()

        for k, text in enumerate(texts):
            for part in self.cut(text):
                call.append(part)
                owner.append(k)
                size += len(part)
                if size > CALL:
                    flush()
                    size = 0
        if call:
            flush()
        return out


@lru_cache(2)
def counter_for(content: bytes, kind: str) -> Counter:
    return Counter(content, kind)


def _read(path: str | None) -> tuple[bytes, str]:
    path = path or default_vocabulary()
    with open(path, "rb") as f:
        return f.read(), path.rpartition(".")[2]


def normalised(text: Column, folds: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.translate(text, _BLANK, " ") if folds else text


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one version, a row per key."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # nothing has been stored yet
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def compact(spark: SparkSession, cache: str, version: str, into: str) -> None:
    """Writes one version's keys once, in few files, as a new cache."""
    stored(spark, cache, version).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(into)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each ``digest`` in this partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


def one_text_each(texts: DataFrame, misses: DataFrame, total: int, parts: int) -> DataFrame:
    """Rows of ``texts(digest, text)`` whose digest is in ``misses(digest, n)``, equal digests in one partition and all but bounded numbers of them gone."""
    if misses.count() <= FEW:
        return texts.join(F.broadcast(misses.select("digest")), "digest", "left_semi").mapInArrow(_once, texts.schema).repartition(parts, "digest")
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(misses.where(F.col("n") > limit).select(F.col("digest").alias("hot")))  # fewer than HOT_KEYS
    near = texts.join(hot, F.col("digest") == F.col("hot"), "left")
    often = near.where("hot is not null").drop("hot").mapInArrow(_once, texts.schema).repartition(parts, "digest")
    rest = misses.where(F.col("n") <= limit).select("digest").hint("shuffle_hash")
    return near.where("hot is null").drop("hot").repartition(parts, "digest").join(rest, "digest", "left_semi").unionByName(often)


def _encoded(content, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(content.value, kind)
        for batch in _once(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def fill(docs: DataFrame, keys: DataFrame, total: int, n_bytes: int, cache: str, path: str | None = None) -> int:
    """Encodes a text for each of ``keys(digest, n)`` that the cache lacks and appends the counts; how many there were.

    ``docs`` has ``total`` rows with texts of ``n_bytes`` in all.
    """
    spark = docs.sparkSession
    content, kind = _read(path)
    counter = counter_for(content, kind)
    known = stored(spark, cache, counter.version).select("digest")
    misses = materialise(keys.join(known, "digest", "left_anti"), "token-misses")
    found = misses.count()
    if found:
        text = normalised(F.col("text"), counter.folds)
        texts = docs.select(digest(text).alias("digest"), text.alias("text"))
        parts = max(-(-n_bytes // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
        made = one_text_each(texts, misses, total, parts).mapInArrow(_encoded(spark.sparkContext.broadcast(content), kind), "digest binary, n_tokens long")
        made.withColumn("version", F.lit(counter.version)).write.mode("append").partitionBy("version").parquet(cache)
    return found


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``.

    ``cache`` is the cache's path in storage that all executors share; ``path`` is the
    tokenizer's file, read by the driver.
    """
    spark = docs.sparkSession
    counter = counter_for(*_read(path))
    text = normalised(F.col("text"), counter.folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest(text).alias("digest"))
    rows = materialise(rows, "token-keys")
    keys = materialise(rows.groupBy("digest").agg(F.count("*").alias("n")), "token-digests")
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    fill(docs, keys, total, n_bytes, cache, path)
    counts = keys.join(stored(spark, cache, counter.version), "digest")
    found = spread_join(rows, "digest", counts, "n", total)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
