"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="quaystone-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share, the session's ``spark.checkpoint.dir``.

    It has to be set on a cluster, as a folder of one machine would not be seen elsewhere. Where
    driver and executor are one process, a folder that ends with it takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = f"file://{_own_folder().name}"
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that hold whole texts go to Python in batches of at most so many rows and bytes:
#: each worker, and Spark's side of it, holds a batch or two.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits the batches of a session that runs whole texts; for applications (queries, stages), no operator calls it."""
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not held or not 0 < int(held[1]) <= most:
            spark.conf.set(key, str(most))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key`` (a group never spans two)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < least_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[key].combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = 0 if cut else size // 2
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with equal keys together and in order, for `whole_groups`."""
    return df.repartition(key).sortWithinPartitions(key)


#: Keys with more than 1 / HOT_KEYS of the rows are hot; there are fewer than HOT_KEYS of
#: them, so their rows of a table with one row per key can be sent to all tasks.
HOT_KEYS, HOT_ROWS = 20_000, 1000


def spread_join(rows: DataFrame, key: str, table: DataFrame, size: str, total: int, how: str = "inner", written: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key`` and in ``size`` how many rows hold that key.

    Rows of hot keys meet a broadcast of fewer than ``HOT_KEYS`` rows where they are;
    only the others are shuffled, so no task gets more of a key than that share.
    ``total`` is at least the sum of ``size``. ``key`` must not be null in ``table``,
    which is written first if it is not ``written``.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if total <= limit:
        return rows.join(table.drop(size), key, how)
    if not written:
        table = materialise(table, "keys")
    heavy = table.where(F.col(size) > limit).drop(size)
    if heavy.isEmpty():
        return rows.join(table.drop(size), key, how)
    heavy = F.broadcast(heavy)
    near = rows.join(heavy.select(F.col(key).alias("_hot")), F.col(key) == F.col("_hot"), "left")
    hot = near.where("_hot is not null").drop("_hot").join(heavy, key)
    return hot.unionByName(near.where("_hot is null").drop("_hot").join(table.where(F.col(size) <= limit).drop(size), key, how))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, component`` (its least node) for every node of ``edges(a, b)``.

    Alternates large-star and small-star steps until nothing moves. Each step is
    aggregations and joins on the nodes, with hubs spread out (`spread_join`); every
    round is written to the shared folder.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree")), label)
        large = spread_join(both, "a", least, "degree", 2 * before[0], written=True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, label)
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = spread_join(large, "a", lower, "degree", 2 * before[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), label)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
