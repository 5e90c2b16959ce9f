"""The log: tables in the shape of Spark's Kafka source, and options for Kafka itself.

Kafka and JDBC need packages that are not part of Spark; their options are given
here, but only the table form is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.schema import RETENTION_DAYS


def kafka_source_options(servers: str, topics: list[str]) -> dict[str, str]:
    """From the earliest offset, committed records only."""
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "kafka.isolation.level": "read_committed", "includeHeaders": "true"}


def kafka_sink_options(servers: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.compression.type": "lz4", "includeHeaders": "true"}


def jdbc_options(url: str, table: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "isolationLevel": "READ_COMMITTED", "truncate": "true"}


def scan(log: DataFrame, topics: list[str]) -> DataFrame:
    return log.where(F.col("topic").isin(*topics))


def key_partition(key: Column, partitions: int | Column) -> Column:
    """The partition of a key: the first 32 bits of its MD5, modulo the number of partitions; null without a key."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), partitions if isinstance(partitions, Column) else F.lit(partitions)).cast("int")


def read_committed(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose ``batch_id`` is in the ledger of finished batches."""
    return log.join(ledger.select("batch_id").distinct(), "batch_id", "left_semi")


def prune(log: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that are younger than the retention time."""
    return log.where(F.col("timestamp") > now - F.expr(f"interval {days} days"))


def compact(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row written last for each key; sums of maxima, so a hot key is no hot task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def compact_onto(current: DataFrame, changes: DataFrame, key: str, order: list[str], gone: Column) -> DataFrame:
    """A compacted log after ``changes`` (same columns): the last row of each key, and no row of keys whose last one is ``gone``.

    A tombstone that is to be seen for a while is ``gone`` only after a delay: until then it
    stays, so that it still removes its key from copies that are brought up to date later.
    """
    return compact(current.unionByName(changes), key, order).where(~F.coalesce(gone, F.lit(False)))


def tombstone(now: Column, delay: str) -> Column:
    """Whether a row without a value is older than ``delay`` (as ``24 hours``)."""
    return F.col("value").isNull() & (F.col("timestamp") <= now - F.expr(f"interval {delay}"))


def next_offsets(log: DataFrame) -> DataFrame:
    """Per topic and partition, one past the highest offset."""
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset")).orderBy("topic", "partition")
