"""A log that is written: records go under their key to a partition and get offsets there.

Data lie under ``path`` by topic, day, producer and batch; ``<path>_segments`` says which
of them are part of the log. A batch is dealt out in ranges of (topic, partition, order),
each task writes its range with places that grow within it, and a segment gives the
places of one topic's partition in one range their first offset. Segments are sums over
the ranges before, so no task ever numbers a whole partition, and offsets go on from the
log's end without gaps. A batch's segments are written last, in one file: until then
nothing of it is read, and a batch that has them is never written again. So a redone batch
leaves the log as it is.

One writer appends at a time, as with a table.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quaystone.schema import LOG, PARTITIONS, RETENTION_DAYS
from quaystone.sources.folders import remove, subfolders
from quaystone.sources.log import key_partition

#: Bits of a place that count within a range, as Spark's own row numbers do.
RANGE_BITS = 33
WRITTEN = "partition int, timestamp timestamp, key binary, value binary, headers array<struct<key:string,value:binary>>, place long, topic string, day date, producer string, batch long"
SEGMENTS = "topic string, partition int, range long, first long, n long, start long, producer string, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], schema)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}_segments", SEGMENTS)


def finished(spark: SparkSession, path: str, producer: str, batch: int) -> bool:
    return not segments(spark, path).where((F.col("producer") == producer) & (F.col("batch") == batch)).isEmpty()


def partition_of(key: Column, otherwise: Column, topic: Column, partitions: dict[str, int]) -> Column:
    """The partition of a record: by its key, records without one by ``otherwise``; topics not named have one partition."""
    known = F.create_map(*[F.lit(x) for pair in partitions.items() for x in pair])
    n = F.coalesce(F.try_element_at(known, topic), F.lit(1))
    return F.coalesce(key_partition(key, n), F.pmod(otherwise, n).cast("int"))


def append(records: DataFrame, path: str, producer: str, batch: int, order: list[str], partitions: dict[str, int] = PARTITIONS) -> bool:
    """Appends ``records(topic, timestamp, key, value, headers)``, in ``order`` within a partition; whether it had to.

    ``order`` are columns of ``records`` and should tell them apart: records equal in all
    of them have no order of their own.
    """
    spark = records.sparkSession
    if finished(spark, path, producer, batch):
        return False
    place = ["topic", "partition", *(f"_{i}" for i in range(len(order)))]
    rows = records.withColumns({f"_{i}": F.col(c) for i, c in enumerate(order)})
    rows = rows.withColumn("partition", partition_of(F.col("key"), F.xxhash64("value", *place[2:]), F.col("topic"), partitions))
    rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    rows = rows.select("partition", "timestamp", "key", "value", "headers", F.monotonically_increasing_id().alias("place"), "topic", F.to_date("timestamp").alias("day"), F.lit(producer).alias("producer"), F.lit(batch).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "day", "producer", "batch").parquet(path)
    mine = _table(spark, path, WRITTEN).where((F.col("producer") == producer) & (F.col("batch") == batch))
    counts = mine.groupBy("topic", "partition", F.shiftright("place", RANGE_BITS).alias("range")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # A row per range and partition, so a partition's windows are as long as there are tasks.
    before = Window.partitionBy("topic", "partition").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    end = segments(spark, path).groupBy("topic", "partition").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    start = F.coalesce("end", F.lit(0)) + F.coalesce(F.sum("n").over(before), F.lit(0))
    made = counts.join(end, ["topic", "partition"], "left").select("topic", "partition", "range", "first", "n", start.cast("long").alias("start"), F.lit(producer).alias("producer"), F.lit(batch).cast("long").alias("batch"))
    made.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("producer", "batch").parquet(f"{path}_segments")
    return True


def read(spark: SparkSession, path: str, topics: list[str] | None = None, *also: str) -> DataFrame:
    """The log as rows of `schema.LOG`, finished batches only, ``also`` with ``producer`` or ``batch``."""
    rows = _table(spark, path, WRITTEN)
    if topics is not None:
        rows = rows.where(F.col("topic").isin(*topics))
    rows = rows.withColumn("range", F.shiftright("place", RANGE_BITS))
    rows = rows.join(segments(spark, path), ["topic", "partition", "range", "producer", "batch"])
    return rows.withColumn("offset", F.col("start") + F.col("place") - F.col("first")).select(*LOG.fieldNames(), *also)


def next_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``topic, partition, next_offset`` of all that is finished, from the segments alone."""
    return segments(spark, path).groupBy("topic", "partition").agg(F.max(F.col("start") + F.col("n")).alias("next_offset"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, producer: str, order: list[str], partitions: dict[str, int] = PARTITIONS) -> StreamingQuery:
    """Appends a stream of records, each of its batches once."""

    def write(batch: DataFrame, number: int) -> None:
        append(batch, path, producer, number, order, partitions)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(spark: SparkSession, path: str, topics: list[str], today: datetime.date, days: int = RETENTION_DAYS) -> list[str]:
    """Deletes the days of ``topics`` that are wholly past their time; which folders went.

    Offsets are not used again: the segments stay. The last day is cut by `log.prune`.
    """
    gone = []
    for topic in topics:
        for folder in subfolders(spark, f"{path}/topic={topic}/day=*"):
            day = folder.rpartition("day=")[2]
            if day != "__HIVE_DEFAULT_PARTITION__" and datetime.date.fromisoformat(day) < today - datetime.timedelta(days=days):
                remove(spark, folder)
                gone.append(folder)
    return gone
