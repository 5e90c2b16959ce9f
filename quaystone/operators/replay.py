"""Replay of dead letters within a snapshot of offsets taken at the start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.columns import headers, replay_target
from quaystone.schema import DEAD
from quaystone.sources import log_table


def snapshot(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of ``log`` with ``next_offset <= offset < high`` of ``bounds(partition, next_offset, high)``.

    There is a bound per partition of the log, so the small side is a few rows.
    """
    b = F.broadcast(bounds.select(F.col("partition").alias("b_partition"), "next_offset", "high"))
    inside = (F.col("partition") == F.col("b_partition")) & (F.col("offset") >= F.col("next_offset")) & (F.col("offset") < F.col("high"))
    return log.join(b, inside).drop("b_partition", "next_offset", "high")


def plan(log: DataFrame, bounds: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows to be seen with their ``target`` (null: skipped). The limit counts seen rows."""
    rows = snapshot(log, bounds)
    if limit is not None:
        rows = rows.orderBy("partition", "offset").limit(limit)
    return rows.withColumn("target", replay_target(F.col("headers")))


def records(planned: DataFrame, *order: str) -> DataFrame:
    """What is written: original key and value to the target, with where it came from (and columns to put them in ``order``)."""
    origin = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return planned.where("target is not null").select(F.col("target").alias("topic"), "key", "value", headers({"replayed.from": origin}).alias("headers"), *order)


def counts(planned: DataFrame) -> DataFrame:
    return planned.agg(F.count("*").alias("seen"), F.count("target").alias("replayed"), F.count_if(F.col("target").isNull()).alias("skipped"))


def progress(planned: DataFrame, bounds: DataFrame, dry_run: bool = False) -> DataFrame:
    """The next offsets afterwards: past all seen rows, skipped ones too; unchanged in a dry run."""
    seen = planned.groupBy("partition").agg((F.max("offset") + 1).alias("seen_to")).withColumnRenamed("partition", "p")
    new = F.col("next_offset") if dry_run else F.coalesce("seen_to", "next_offset")
    return bounds.join(seen, F.col("partition") == F.col("p"), "left").select("partition", new.alias("next_offset"))


LEDGER = "run int, partition int, low long, high long, at timestamp, state string"


@dataclass(frozen=True)
class Replayed:
    """Counts of a run: rows looked at, sent back, and left for want of an origin."""

    seen: int = 0
    replayed: int = 0
    skipped: int = 0


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was planned and what is done: a row per run, state and partition."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:  # no run yet
        return spark.createDataFrame([], LEDGER)


def _enter(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "state").parquet(path)


def run(spark: SparkSession, log: str, progress_path: str, now: Column, topic: str = DEAD, limit: int | None = None, dry_run: bool = False) -> Replayed:
    """Sends the dead letters that are in the log table ``log`` now back to where they came from.

    Progress is a table, ``progress_path``. A run's bounds (and the time its records get)
    are entered as planned before anything is written, and as done after the records are
    visible. A run that was planned and not done is taken up with its own bounds, and its
    batch of the log is not written again if it is there: so a crash at any point loses
    nothing and sends nothing twice. Letters that arrive after the bounds were taken
    wait for the next run, those that the run itself causes too. The last offset need
    not be readable. A dry run gives the same counts and enters nothing.
    """
    entries = ledger(spark, progress_path)
    done = entries.where("state = 'done'")
    # A row per run and partition of one topic.
    pending = entries.where("state = 'planned'").join(done.select("run").distinct(), "run", "left_anti")
    bounds = pending.select("run", "partition", F.col("low").alias("next_offset"), "high", "at").collect()
    fresh = not bounds
    if fresh:
        number = (done.agg(F.max("run")).first()[0] or 0) + 1
        before = done.groupBy("partition").agg(F.max("high").alias("next_offset"))
        ends = log_table.next_offsets(spark, log).where(F.col("topic") == topic).select("partition", F.col("next_offset").alias("high"))
        bounds = ends.join(before, "partition", "left").select(F.lit(number).alias("run"), "partition", F.coalesce("next_offset", F.lit(0).cast("long")).alias("next_offset"), "high", now.alias("at")).collect()
        bounds = [b for b in bounds if b.next_offset < b.high]
    if not bounds:
        return Replayed()
    number = bounds[0].run
    table = lambda rows: spark.createDataFrame(rows, "run int, partition int, next_offset long, high long, at timestamp")
    letters = log_table.read(spark, log, [topic])
    planned = plan(letters, table(bounds), limit if fresh else None)
    found = counts(planned).first()
    if fresh and limit is not None and found.seen >= limit:
        to = {r.partition: r.seen_to for r in planned.groupBy("partition").agg((F.max("offset") + 1).alias("seen_to")).collect()}
        bounds = [(b.run, b.partition, b.next_offset, to.get(b.partition, b.next_offset), b.at) for b in bounds]
        planned = plan(letters, table(bounds))
    if not dry_run:
        entry = table(bounds).select("run", "partition", F.col("next_offset").alias("low"), "high", "at")
        if fresh:
            _enter(entry.withColumn("state", F.lit("planned")), progress_path)
        again = records(planned, "partition", "offset").withColumn("timestamp", F.lit(bounds[0][4]))
        log_table.append(again, log, f"replay of {topic}", number, ["partition", "offset"])
        _enter(entry.withColumn("state", F.lit("done")), progress_path)
    return Replayed(found.seen, found.replayed, found.skipped)
