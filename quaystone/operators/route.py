"""Where records go: valid or dead letters, category topics, urgent copies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.columns import headers, pinned, route_topics, truncate_error
from quaystone.operators.decode import JSON, UNDECODABLE, Codec, decode_body, encode, read_frames
from quaystone.operators.validate import cleaned, enriched_errors, ticket_errors
from quaystone.schema import DEAD, ENRICHED, TICKET, VALID

TOMBSTONE = "message has no value"


def is_tombstone() -> Column:
    """A record without a value: a dead letter for validator and enricher, skipped by the aggregator."""
    return F.col("value").isNull()


@dataclass(frozen=True)
class Kind:
    """What a log's records are read as: the reader's schema, the record's name, and its rules."""

    reader: T.StructType
    record: str
    errors: Callable[[Callable[[str], Column]], Column]


TICKETS = Kind(TICKET, "Ticket", ticket_errors)
ENRICHED_TICKETS = Kind(ENRICHED, "EnrichedTicket", enriched_errors)


def dead_headers(error_type: Column, message: Column, failed_at: Column) -> Column:
    """The six headers of a dead letter, about the row's own log position."""
    position = {"source.topic": F.col("topic"), "source.partition": F.col("partition"), "source.offset": F.col("offset")}
    return headers({"error.type": error_type, "error.message": truncate_error(message)} | position | {"failed_at": failed_at})


def judged(log: DataFrame, schemas: DataFrame, kind: Kind = TICKETS, codec: Codec = JSON) -> DataFrame:
    """``log`` decoded and checked: struct ``r`` (fields `cleaned`), ``error_type``, ``error_message``."""
    rows = decode_body(read_frames(log, schemas), kind.reader, kind.record, codec)
    kept = [cleaned(n, F.col(f"r.{n}")).alias(n) for n in kind.reader.fieldNames()]
    rows = pinned(rows, clean=F.when(F.col("r").isNotNull(), F.struct(*kept))).drop("r").withColumnRenamed("clean", "r")
    errors = kind.errors(lambda n: F.col(f"r.{n}"))
    rows = pinned(rows, errors=F.when(F.col("r").isNotNull(), errors).otherwise(F.array().cast("array<string>")))
    kind_of_error = F.when(is_tombstone(), "ValueError").when(F.col("error").isNotNull(), UNDECODABLE).when(F.size("errors") > 0, "ValidationError")
    message = F.when(is_tombstone(), TOMBSTONE).otherwise(F.coalesce("error", F.when(F.size("errors") > 0, F.concat(F.lit("invalid: "), F.array_join("errors", ", ")))))
    return rows.withColumn("error_type", kind_of_error).withColumn("error_message", message)


def validate_split(log: DataFrame, schemas: DataFrame, failed_at: Column, schema: int = 2, codec: Codec = JSON) -> DataFrame:
    """One output row per input row: ``out_topic, out_key, out_value, out_headers`` beside the source.

    Valid tickets are written anew in the reader's schema under their customer;
    others keep key and bytes and get the headers of a dead letter.
    """
    good = F.col("error_type").isNull()
    rows = judged(log, schemas, codec=codec).withColumn("good", F.when(good, F.col("r")))
    rows = encode(rows, "good", schema, TICKET, codec)
    return rows.select(
        "topic", "partition", "offset", "error_type", "error_message",
        F.when(good, VALID).otherwise(DEAD).alias("out_topic"),
        F.when(good, F.encode(F.col("r.customer_id"), "UTF-8")).otherwise(F.col("key")).alias("out_key"),
        F.when(good, F.col("encoded")).otherwise(F.col("value")).alias("out_value"),
        F.when(~good, dead_headers(F.col("error_type"), F.col("error_message"), failed_at)).otherwise(F.array().cast("array<struct<key:string,value:binary>>")).alias("out_headers"),
    )


def fan_out(enriched: DataFrame) -> DataFrame:
    """A row per output of an enriched ticket: ``topic`` and its place ``copy`` (0, then 1 for the urgent copy)."""
    return enriched.select("*", F.posexplode(route_topics(F.col("category"), F.col("priority"))).alias("copy", "topic"))


def aggregator_input(log: DataFrame, schemas: DataFrame, kind: Kind = ENRICHED_TICKETS, codec: Codec = JSON) -> DataFrame:
    """The enriched log as `judged`, with ``outcome``: counted, dead_letter, or skipped for a record without a value."""
    rows = judged(log, schemas, kind, codec)
    return rows.withColumn("outcome", F.when(is_tombstone(), "skipped").when(F.col("error_type").isNotNull(), "dead_letter").otherwise("counted"))
