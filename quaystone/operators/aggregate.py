"""The aggregator: what comes of the log of enriched tickets, as records of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.columns import stats_key
from quaystone.operators import windows
from quaystone.operators.decode import JSON, Codec, encode
from quaystone.operators.latest import newer_guard
from quaystone.operators.route import aggregator_input, dead_headers
from quaystone.operators.validate import stats_errors
from quaystone.schema import DEAD, ENRICHED, ENRICHED_SCHEMA, LATEST, STATS, STATS_RECORD, STATS_SCHEMA
from quaystone.sources.folders import written


def no_headers() -> Column:
    return F.array().cast("array<struct<key:string,value:binary>>")


def judged_tickets(judged: DataFrame, order: Sequence[str]) -> DataFrame:
    """The countable rows of `route.aggregator_input`: the ticket's fields, ``created_ms``, and where each row lies in the log."""
    position = [c for c in ("topic", "partition", "offset") if c not in order]
    return judged.where("outcome = 'counted'").select("r.*", F.col("r.created_at").alias("created_ms"), "r", *position, *order)


def dead_letters(judged: DataFrame, failed_at: Column) -> DataFrame:
    """Records that cannot be read or break a rule, with key and bytes as they were. Tombstones are left out."""
    made = dead_headers(F.col("error_type"), F.col("error_message"), failed_at)
    return judged.where("outcome = 'dead_letter'").select(F.lit(DEAD).alias("out_topic"), F.col("key").alias("out_key"), F.col("value").alias("out_value"), made.alias("out_headers"))


def stats_records(counts: DataFrame, codec: Codec = JSON) -> DataFrame:
    """Closed windows as framed records under their key. A row that breaks the rules of statistics stops the job: it would be our fault."""
    broken = stats_errors()
    record = F.when(F.size(broken) == 0, F.struct(*STATS_RECORD.fieldNames())).otherwise(F.raise_error(F.concat(F.lit("a row of statistics breaks "), F.array_join(broken, ", "))))
    rows = encode(counts.withColumn("record", record), "record", STATS_SCHEMA, STATS_RECORD, codec)
    return rows.select(F.lit(STATS).alias("out_topic"), F.encode(stats_key(F.col("dimension"), F.col("value")), "UTF-8").alias("out_key"), F.col("encoded").alias("out_value"), no_headers().alias("out_headers"))


def latest_records(tickets: DataFrame, order: Sequence[str], codec: Codec = JSON) -> DataFrame:
    """Tickets newer than all before them of their customer, framed under the customer's key; the last one of a key is its newest."""
    rows = encode(newer_guard(tickets, [*order]), "r", ENRICHED_SCHEMA, ENRICHED, codec)
    return rows.select(F.lit(LATEST).alias("out_topic"), F.encode("customer_id", "UTF-8").alias("out_key"), F.col("encoded").alias("out_value"), no_headers().alias("out_headers"), *order)


def aggregate_records(log: DataFrame, schemas: DataFrame, size_ms: int, grace_ms: int, failed_at: Column, order: Sequence[str], buckets: int = 1, codec: Codec = JSON) -> DataFrame:
    """Everything the aggregator writes: ``out_topic, out_key, out_value, out_headers`` of dead letters, closed windows and newest tickets.

    ``order`` is the order of arrival, a whole number first; ``latest`` records are to be
    written in it, so it comes along (null for the others). Late rows are counted nowhere,
    see `windows.late_report`. The log is read and decoded once: what comes of it is written,
    and each of the outputs reads the columns it needs. Bytes are kept of dead letters only, which come in ``order``.
    """
    judged = aggregator_input(log, schemas, codec=codec).where("outcome <> 'skipped'")
    bytes_ = {c: F.when(F.col("outcome") == "dead_letter", F.col(c)).alias(c) for c in ("key", "value")}
    needed = dict.fromkeys(["topic", "partition", "offset", "key", "value", "r", "error_type", "error_message", "outcome", *order])
    judged = written(judged.select(*[bytes_.get(c, c) for c in needed]), "aggregate")
    tickets = judged_tickets(judged, order)
    counts = windows.window_counts_strict(tickets, size_ms, grace_ms, buckets, order)
    out = dead_letters(judged.orderBy(*order), failed_at).unionByName(stats_records(counts, codec))
    return out.unionByName(latest_records(tickets, order, codec), allowMissingColumns=True)
