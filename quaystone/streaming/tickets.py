"""Structured Streaming forms of the ticket operators.

The stateless operators of `quaystone.operators` work on streams as they are. Here
are those that keep state, and sinks that are exactly-once by batch.

Lateness: `window_counts` uses Spark's watermark, which moves between batches, so rows
that are late within one batch are counted. `strict_window_counts` judges each row by
the rows before it, as the batch operator of that name does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from quaystone.operators import windows
from quaystone.operators.sink import sink_dead_letters, sink_split, upsert
from quaystone.operators.windows import by_dimension
from quaystone.sources.folders import remove, subfolders
from quaystone.sources.log import read_committed

#: Settings these operators need: state that survives and can be large, and late rows
#: judged by the newest watermark.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
}

LATEST_ROW = "customer_id string, created_ms long, arrival long, event_id long"
CLOSED_ROW = "dimension string, value string, window_start long, window_end long, count long"


def configure(spark: SparkSession) -> None:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A growing table of files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def window_counts(enriched: DataFrame, size: str = "300 seconds", grace: str = "60 seconds") -> DataFrame:
    """One row per closed window, dimension and value; ``enriched`` has ``created_ms``.

    The watermark is set after all topics are united, so any topic's newer row moves it.
    """
    rows = by_dimension(enriched).withColumn("created_at", F.timestamp_millis("created_ms")).withWatermark("created_at", grace)
    counts = rows.groupBy(F.window("created_at", size), "dimension", "value").agg(F.count("*").alias("count"))
    return counts.select("dimension", "value", F.unix_millis("window.start").alias("window_start"), F.unix_millis("window.end").alias("window_end"), "count")


class NewerGuard(StatefulProcessor):
    """Per customer, passes a row on if it was created after all rows before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen_ms", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = self.seen.get()[0] if self.seen.exists() else -1
        for row in sorted(rows, key=lambda r: (r.arrival, r.event_id)):
            if row.created_ms > seen:
                seen = row.created_ms
                yield Row(customer_id=row.customer_id, created_ms=row.created_ms, arrival=row.arrival, event_id=row.event_id)
        self.seen.update((seen,))

    def close(self) -> None:
        pass


def newer_guard(tickets: DataFrame) -> DataFrame:
    rows = tickets.select("customer_id", "created_ms", "arrival", "event_id")
    return rows.groupBy("customer_id").transformWithState(statefulProcessor=NewerGuard(), outputStructType=LATEST_ROW, outputMode="Append", timeMode="None")


class StrictWindows(StatefulProcessor):
    """Per dimension and bucket: counts of open windows and the newest event time.

    A window closes with the first row at or after its end plus grace, in arrival
    order; later rows of it are not counted.
    """

    def __init__(self, size_ms: int, grace_ms: int):
        self.size, self.grace = size_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest_ms", "ms long")
        self.open = handle.getMapState("open", "value string, window_start long", "count long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        counts = {(k[0], k[1]): v[0] for k, v in self.open.iterator()}
        touched: set = set()
        for row in sorted(rows, key=lambda r: (r.arrival, r.event_id)):
            newest = row.created_ms if newest is None else max(newest, row.created_ms)
            at = (row.value, row.created_ms - row.created_ms % self.size)
            if at[1] + self.size + self.grace > newest:
                counts[at] = counts.get(at, 0) + 1
                touched.add(at)
        for at in sorted(counts):
            if at[1] + self.size + self.grace <= newest:
                self.open.removeKey(at)
                yield Row(dimension=key[0], value=at[0], window_start=at[1], window_end=at[1] + self.size, count=counts[at])
            elif at in touched:
                self.open.updateValue(at, (counts[at],))
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def strict_window_counts(enriched: DataFrame, size_ms: int, grace_ms: int, buckets: int = 1) -> DataFrame:
    """As the batch operator of this name; each bucket of values has its own clock."""
    rows = by_dimension(enriched, "arrival", "event_id").withColumn("bucket", F.pmod(F.hash("value"), F.lit(buckets)))
    return rows.groupBy("dimension", "bucket").transformWithState(statefulProcessor=StrictWindows(size_ms, grace_ms), outputStructType=CLOSED_ROW, outputMode="Append", timeMode="None")


def dedup(rows: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """Drops repeats of a key that come within ``horizon`` of event time (at-least-once inputs)."""
    return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def write_batches(stream: DataFrame, path: str, checkpoint: str, topic: Column | None = None) -> StreamingQuery:
    """Exactly-once output of several topics: a batch is one partition of the table, which a redone batch overwrites.

    Readers take the batches that the ledger ``<path>_ledger`` names; its row is written last.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if topic is None else batch.withColumn("topic", topic)
        rows.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        spark.createDataFrame([(number, number)], "batch_id long, done long").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}_ledger")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Rules:
    """What a table takes: rows that could be converted, with values in ``required`` and texts within ``limits``."""

    decodable: Column
    required: list[str]
    limits: dict[str, int]


#: Where a refused row is counted in the ledger; tables have no such bucket.
REFUSED = -1


def upsert_batches(
    stream: DataFrame, path: str, checkpoint: str, columns: str, keys: list[str], written: list[str], now: Callable[[int], Column], buckets: int = 16, rules: Rules | None = None
) -> StreamingQuery:
    """Keyed upserts (`sink.upsert`) of a stream into a table of files.

    The table lies in ``buckets`` of its keys' hash, and a batch rewrites only the
    buckets it has keys of, as a new version; `read_upserted` reads the versions that
    the ledger names, and its row is written last. A redone batch starts from the
    version before it and overwrites its own, so each batch counts once. `vacuum_upserts` deletes what was replaced.

    With ``rules``, rows that they refuse go to ``<path>_refused`` as dead letters of the
    sink (stage, position and reason as headers, `read_refused`), under the same row of the
    ledger as the batch's other rows, which are written all the same. ``stream`` then has ``topic,
    partition, offset, key, value`` beside the table's columns.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        batch = (batch if rules is None else sink_split(batch, rules.decodable, rules.required, rules.limits)).persist()
        try:
            entries = []
            if rules is not None:
                refused = sink_dead_letters(batch).select("out_topic", "key", "value", "headers", "stage")
                if not refused.isEmpty():
                    _put(refused, f"{path}_refused", number)
                    entries.append((number, REFUSED, number))
            good = bucket(batch if rules is None else batch.where("stage is null"))
            touched = [r[0] for r in good.select("bucket").distinct().collect()]  # at most ``buckets``
            if touched:
                current = read_upserted(spark, path, columns, before=number).where(F.col("bucket").isin(touched))
                table = upsert(current.drop("bucket", "version"), good.drop("bucket"), keys, written, now(number))
                bucket(table).withColumn("version", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(path)
                entries += [(number, b, number) for b in touched]
            if entries:
                done = spark.createDataFrame(entries, "version long, bucket int, done long")
                done.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("done").parquet(f"{path}_ledger")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REFUSED_ROW = "out_topic string, key binary, value binary, headers array<struct<key:string,value:binary>>, stage string, batch_id long"


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    """Dead letters of the finished batches of `upsert_batches`."""
    done = _stored(spark, f"{path}_ledger", "version long, bucket int, done long").where(F.col("bucket") == REFUSED)
    return read_committed(_stored(spark, f"{path}_refused", REFUSED_ROW), done.select(F.col("version").alias("batch_id"))).drop("batch_id")


def read_upserted(spark: SparkSession, path: str, columns: str, before: int | None = None) -> DataFrame:
    """The table of `upsert_batches`: each bucket's newest finished version (before a batch)."""
    empty = spark.createDataFrame([], f"{columns}, version long, bucket int")
    try:
        ledger = spark.read.schema("version long, bucket int, done long").parquet(f"{path}_ledger")
    except AnalysisException:  # nothing is written yet
        return empty
    if before is not None:
        ledger = ledger.where(F.col("version") < before)
    newest = ledger.groupBy("bucket").agg(F.max("version").alias("version"))
    rows = spark.read.schema(f"{columns}, version long, bucket int").parquet(path)
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi")  # a row per bucket


def vacuum_upserts(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes versions of buckets of `upsert_batches` that ``keep`` newer finished ones have replaced; which folders went.

    Versions beyond the newest finished one are left alone: a batch may be writing them. A
    reader that still uses a replaced version needs a larger ``keep``.
    """
    versions: dict[int, list[int]] = {}
    for r in spark.read.schema("version long, bucket int, done long").parquet(f"{path}_ledger").select("bucket", "version").distinct().collect():
        versions.setdefault(r.bucket, []).append(r.version)  # as many rows as batches times buckets they touched
    gone = []
    for folder in subfolders(spark, f"{path}/version=*/bucket=*"):
        version, bucket = (int(part.split("=")[1]) for part in folder.split("/")[-2:])
        newer = sorted(v for v in versions.get(bucket, []) if v > version)
        if len(newer) >= keep:
            remove(spark, folder)
            gone.append(folder)
    return gone


# Strict windows by batches: nothing of a batch is held in one worker.

OPEN = "dimension string, bucket int, value string, window_start long, window_end long, count long, batch_id long"
NEWEST = "dimension string, bucket int, before_ms long, batch_id long"
CLOSED = f"{CLOSED_ROW}, batch_id long"
LATE_ROW = "ticket_id string, dimension string, value string, window_start long, window_end long, late_by_ms long, topic string, partition int, offset long, batch_id long"
DONE = "batch_id long, done long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], schema)


def _put(rows: DataFrame, path: str, number: int) -> None:
    rows.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _finish(spark: SparkSession, path: str, number: int) -> None:
    _put(spark.createDataFrame([(number,)], "done long"), f"{path}_ledger", number)


def _finished(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return read_committed(_stored(spark, f"{path}_{name}", schema), _stored(spark, f"{path}_ledger", DONE))


def strict_window_batches(stream: DataFrame, path: str, checkpoint: str, size_ms: int, grace_ms: int, buckets: int = 1, order: Sequence[str] = windows.ORDER) -> StreamingQuery:
    """Strict windows with two outputs per batch: windows that closed (`read_closed`) and rows that came too late (`read_late`).

    The same rows as the batch operators give. A batch is judged by the running maximum
    in ranges, starting from the newest time of the batches before, which is a row per
    dimension and bucket; open windows are a table that each finished batch replaces. All
    tables of a batch become visible with its row of the ledger, written last, and a redone batch
    overwrites its own. ``stream`` has the columns of a ticket and of its place in the log.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _stored(spark, f"{path}_ledger", DONE).where(F.col("batch_id") < number).agg(F.max("batch_id")).first()[0]
        before = lambda name, schema: _stored(spark, f"{path}_{name}", schema).where(F.col("batch_id") == (-1 if last is None else last)).drop("batch_id")
        newest, batch = before("newest", NEWEST), batch.persist()
        try:
            rows = windows.judged_lateness(batch, size_ms, grace_ms, buckets, order=order, carry=windows.POSITION, before=newest).persist()
            _put(rows.where("late_by_ms >= 0").select(*windows.LATE), f"{path}_late", number)
            window = ["dimension", "bucket", "value", "window_start", "window_end"]
            counts = rows.where("late_by_ms < 0").groupBy(*window).agg(F.count("*").alias("count")).unionByName(before("open", OPEN)).groupBy(*window).agg(F.sum("count").alias("count"))
            now = rows.groupBy("dimension", "bucket").agg(F.max("newest_ms").alias("before_ms")).unionByName(newest).groupBy("dimension", "bucket").agg(F.max("before_ms").alias("before_ms"))
            _put(now.coalesce(1), f"{path}_newest", number)
            counts = counts.join(F.broadcast(now), ["dimension", "bucket"])  # a row per clock
            closes = F.col("window_end") + grace_ms <= F.col("before_ms")
            _put(counts.where(closes).select("dimension", "value", "window_start", "window_end", "count"), f"{path}_closed", number)
            _put(counts.where(~closes).drop("before_ms"), f"{path}_open", number)
            _finish(spark, path, number)
            rows.unpersist()
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_closed(spark: SparkSession, path: str) -> DataFrame:
    return _finished(spark, path, "closed", CLOSED).drop("batch_id")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    return _finished(spark, path, "late", LATE_ROW).drop("batch_id")


# Counters


def counted(rows: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """``rows`` with run counters that listeners see per batch."""
    return rows.observe(name, F.count(F.lit(1)).alias("seen"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


COUNTER = "counter string, n long, query string, batch_id long"


class Counters(StreamingQueryListener):
    """Writes what `counted` observes under ``name`` to a table, a folder per query and batch.

    A query keeps its id over restarts and a redone batch its number, so it overwrites its
    own counts and `totals` counts each batch once.
    """

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        seen = (progress.observedMetrics or {}).get(self.name)
        if seen is None:
            return
        rows = [(k, v, str(progress.id), progress.batchId) for k, v in seen.asDict().items()]
        self.spark.createDataFrame(rows, COUNTER).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("query", "batch_id").parquet(self.path)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``counter, n`` over all queries and batches of a table of `Counters`."""
    return _stored(spark, path, COUNTER).groupBy("counter").agg(F.sum("n").alias("n"))
