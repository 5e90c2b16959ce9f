"""Keyed upserts into tables, the sink's own dead letters, and checks before writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.columns import headers
from quaystone.schema import SINK_DEAD


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], written: list[str], now: Column) -> DataFrame:
    """The table after ``incoming`` (same columns but ``loaded_at``) is merged into ``current``.

    Per key the row written last wins; ``loaded_at`` is that of the first insert.
    """
    values = [c for c in current.columns if c not in (*keys, "loaded_at")]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*written)).alias("new")).toDF(*[f"_{k}" for k in keys], "new")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = current.join(last, on, "full_outer")
    fresh = F.col("new").isNotNull()
    columns = {k: F.when(fresh, F.col(f"_{k}")).otherwise(F.col(k)) for k in keys} | {v: F.when(fresh, F.col(f"new.{v}")).otherwise(F.col(v)) for v in values}
    columns["loaded_at"] = F.coalesce("loaded_at", now)
    return both.select(*[columns[c].alias(c) for c in current.columns])


def with_source_topic(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kafka_topic", F.col("topic"))


def sink_split(rows: DataFrame, decodable: Column, required: list[str], limits: dict[str, int]) -> DataFrame:
    """``rows`` with ``stage`` and ``reason``: VALUE_CONVERTER for rows that cannot be read, TASK_PUT for
    rows the table refuses (nulls, texts over their limit), null for rows to write."""
    null = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    long = F.array_compact(F.array(*[F.when(F.char_length(c) > n, F.lit(c)) for c, n in limits.items()])) if limits else F.array().cast("array<string>")
    stage = F.when(~decodable, "VALUE_CONVERTER").when((F.size(null) > 0) | (F.size(long) > 0), "TASK_PUT")
    reason = F.when(~decodable, "value cannot be converted").when(F.size(null) > 0, F.concat(F.lit("null in "), F.array_join(null, ","))).when(F.size(long) > 0, F.concat(F.lit("too long: "), F.array_join(long, ",")))
    return rows.withColumn("stage", stage).withColumn("reason", reason)


def sink_dead_letters(split: DataFrame) -> DataFrame:
    """The rows that were not written, for the sink's dead-letter topic."""
    names = {"stage": "stage", "topic": "topic", "partition": "partition", "offset": "offset", "exception.message": "reason"}
    made = headers({f"__connect.errors.{k}": F.col(c) for k, c in names.items()})
    return split.where("stage is not null").withColumn("headers", made).withColumn("out_topic", F.lit(SINK_DEAD))


def missing_tables(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Names in ``required(table)`` that are not in ``existing(table)``, sorted."""
    return required.select("table").distinct().join(existing.select("table"), "table", "left_anti").orderBy("table")


def dedup(rows: DataFrame, key: str = "ticket_id") -> DataFrame:
    """One row per key of an at-least-once log, the first written (``arrival``)."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "arrival").alias("row")).select(key, "row.*")
