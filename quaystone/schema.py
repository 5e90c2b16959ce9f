"""Record types, value domains and topic names of the ticket pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
CHANNELS = ("email", "chat", "phone")
TIERS = ("free", "pro", "enterprise")
CATEGORIES = ("billing", "technical", "account", "other")
PRIORITIES = ("low", "medium", "high", "urgent")
DIMENSIONS = ("category", "priority")

RAW, VALID, DEAD = "tickets.raw", "tickets.valid", "tickets.dlq"
BILLING, TECH, OTHER, URGENT = "tickets.billing", "tickets.tech", "tickets.enriched.other", "tickets.urgent"
STATS, LATEST, SINK_DEAD = "tickets.stats", "customers.latest", "tickets.sink.dlq"
#: Each enriched ticket once: the urgent topic holds copies only.
COUNTED_TOPICS = (BILLING, TECH, OTHER)

DEFAULT_TIER = "free"
#: Values of fields that a writer's schema may lack, and the symbols of enum fields.
DEFAULTS = {"tier": DEFAULT_TIER}
SYMBOLS = {"channel": CHANNELS, "tier": TIERS, "category": CATEGORIES, "priority": PRIORITIES, "dimension": DIMENSIONS}
#: Partitions of each topic; dead letters have one.
PARTITIONS = {RAW: 6, VALID: 6, DEAD: 1, BILLING: 3, TECH: 3, OTHER: 3, URGENT: 3, STATS: 3, LATEST: 3, SINK_DEAD: 1}
MAX_SUBJECT, MAX_SUMMARY, MAX_ERROR = 200, 300, 1000
RETENTION_DAYS = 30

#: A row of a log, in the shape of Spark's Kafka source.
LOG = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
    ]
)

#: Bodies on the wire; times are milliseconds.
TICKET_V1 = T.StructType([T.StructField(n, T.LongType() if n == "created_at" else T.StringType()) for n in ("ticket_id", "customer_id", "created_at", "channel", "product", "subject", "body")])
TICKET = T.StructType([*TICKET_V1.fields, T.StructField("tier", T.StringType())])
ENRICHED = T.StructType(
    [
        *TICKET.fields,
        T.StructField("category", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("sentiment", T.DoubleType()),
        T.StructField("summary", T.StringType()),
        T.StructField("enriched_at", T.LongType()),
        T.StructField("model", T.StringType()),
    ]
)

STATS_RECORD = T.StructType([T.StructField(n, T.StringType() if n in ("dimension", "value") else T.LongType()) for n in ("dimension", "value", "window_start", "window_end", "count")])

#: Ids of the schemas that records are written in.
TICKET_SCHEMA, ENRICHED_SCHEMA, STATS_SCHEMA = 2, 3, 4
#: Writer schemas by id: (schema_id, subject, version, record, fields).
CATALOG = (
    (1, "tickets.raw-value", 1, "Ticket", TICKET_V1.fieldNames()),
    (TICKET_SCHEMA, "tickets.raw-value", 2, "Ticket", TICKET.fieldNames()),
    (ENRICHED_SCHEMA, "tickets.enriched-value", 1, "EnrichedTicket", ENRICHED.fieldNames()),
    (STATS_SCHEMA, "tickets.stats-value", 1, "TicketStats", STATS_RECORD.fieldNames()),
)
CATALOG_TYPE = "schema_id long, subject string, version int, record string, fields array<string>"
