"""One query per operator over the driver's tables, each with its SQL for DuckDB.

Every query is a function ``(spark, sf_dir) -> DataFrame``; `query` registers it with
the SQL text. Texts that start with a comma or a select continue `tickets.SQL`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions import columns as C
from quaystone.operators import aggregate, decode, enrich, latest, replay, reports, route, sink, validate, windows
from quaystone.plans import tickets as P
from quaystone.plans.tickets import NOW_MS, dead_bounds, dead_log, enriched_log, raw_log, tickets
from quaystone.schema import BILLING, COUNTED_TOPICS, DEAD, ENRICHED, LATEST, OTHER, PARTITIONS, PRIORITIES, RAW, STATS, STATS_RECORD, TECH, TICKET, VALID
from quaystone.sources import log as L
from quaystone.sources import log_table
from quaystone.sources.folders import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR, SIX_HOURS = 3_600_000, 21_600_000


def query(sql: str | None, name: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = P.SQL + sql if not sql.lstrip().startswith("with") else sql
        return f

    return register


def text(column: str) -> F.Column:
    return F.decode(column, "UTF-8")


# Sources and sinks


@query("select 'tickets.raw' as topic, part as partition, count(*) as n, min(event_id // 3) as first_offset, max(event_id // 3) as last_offset from t group by part")
def log_scan(spark, sf_dir):
    rows = L.scan(raw_log(spark, sf_dir), [RAW])
    return rows.groupBy("topic", F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query("select cast(('0x' || substr(md5(customer_id), 1, 8)) as bigint) % 6 as partition, customer_id, count(*) as n from t group by all")
def keyed_partitioning(spark, sf_dir):
    rows = tickets(spark, sf_dir).withColumn("partition", L.key_partition(F.encode("customer_id", "UTF-8"), 6).cast("long"))
    return rows.groupBy("partition", "customer_id").agg(F.count("*").alias("n"))


ROUTED = """, r as (select *, unnest(case when priority = 'urgent' then [0, 1] else [0] end) as copy from t),
routed as (select *, case when copy = 1 then 'tickets.urgent' when category = 'billing' then 'tickets.billing' when category = 'technical' then 'tickets.tech' else 'tickets.enriched.other' end as topic from r)
"""


def routed(spark, sf_dir):
    return route.fan_out(tickets(spark, sf_dir))


@query(
    ROUTED
    + f"""select ticket_id, customer_id, priority, arg_max(topic, row(arrival, event_id, copy)) as kafka_topic, case when any_value(event_id) % 10 = 0 then any_value(created_ms) + 5 else {NOW_MS} end as loaded_at
from routed group by ticket_id, customer_id, priority"""
)
def upsert_tickets(spark, sf_dir):
    columns = ["ticket_id", "customer_id", "priority", "kafka_topic"]
    incoming = sink.with_source_topic(routed(spark, sf_dir)).select(*columns, "arrival", "event_id", "copy")
    current = tickets(spark, sf_dir).where("event_id % 10 = 0").select("ticket_id", "customer_id", "priority", F.lit("tickets.old").alias("kafka_topic"), (F.col("created_ms") + 5).alias("loaded_at"))
    return sink.upsert(current, incoming, ["ticket_id"], ["arrival", "event_id", "copy"], F.lit(NOW_MS))


def hourly(spark, sf_dir):
    return windows.window_counts(tickets(spark, sf_dir), HOUR)


@query(
    """, w as (select 'category' as dimension, category as v, created_ms, event_id from t union all select 'priority', priority, created_ms, event_id from t),
a as (select dimension, v, created_ms - created_ms % 3600000 as ws, count(*) as n, count(*) filter (where event_id % 2 = 0) as half from w group by all)
select dimension, v as value, ws as window_start, ws + 3600000 as window_end, n as count, case when half > 0 then 7 else 9 end as loaded_at from a"""
)
def upsert_stats(spark, sf_dir):
    t = tickets(spark, sf_dir)
    keys = ["dimension", "value", "window_start", "window_end"]
    current = windows.window_counts(t.where("event_id % 2 = 0"), HOUR).withColumn("loaded_at", F.lit(7).cast("long"))
    incoming = windows.window_counts(t.where("event_id % 2 = 1"), HOUR).withColumn("at", F.lit(1)).unionByName(windows.window_counts(t, HOUR).withColumn("at", F.lit(2)))
    return sink.upsert(current, incoming, keys, ["at"], F.lit(9).cast("long"))


@query(
    """, x as (select event_id, case event_id % 11 when 3 then null else summary end as summary, subject, event_id % 13 = 4 as broken from t)
select event_id, case when broken then 'VALUE_CONVERTER' else 'TASK_PUT' end as stage,
  case when broken then 'value cannot be converted' when summary is null then 'null in summary' else 'too long: subject' end as reason,
  cast(event_id % 3 as varchar) as at_partition from x where broken or summary is null or length(subject) > 200"""
)
def sink_dead_letters(spark, sf_dir):
    t = tickets(spark, sf_dir).withColumn("summary", F.when(F.col("event_id") % 11 != 3, F.col("summary")))
    t = t.withColumn("topic", F.lit("tickets.tech")).withColumn("partition", F.col("part")).withColumn("offset", F.col("event_id"))
    dead = sink.sink_dead_letters(sink.sink_split(t, F.col("event_id") % 13 != 4, ["ticket_id", "summary"], {"subject": 200}))
    return dead.select("event_id", "stage", "reason", F.element_at(C.header_map(F.col("headers")), "__connect.errors.partition").alias("at_partition"))


@query('select distinct customer_id as "table" from t where customer_id not in (select customer_id from t where value >= 200)')
def missing_tables(spark, sf_dir):
    t = tickets(spark, sf_dir)
    return sink.missing_tables(t.select(F.col("customer_id").alias("table")), t.where("value >= 200").select(F.col("customer_id").alias("table")))


@query(f"select event_id from t where created_ms > {NOW_MS} - 20 * 86400000")
def retention_prune(spark, sf_dir):
    return L.prune(raw_log(spark, sf_dir), F.timestamp_millis(F.lit(NOW_MS)), 20).select("event_id")


@query("select customer_id, max(row(arrival, event_id)).event_id as event_id from (select customer_id, {'arrival': arrival, 'event_id': event_id} as row from t) group by customer_id".replace("max(row(arrival, event_id)).event_id", "max(row).event_id"))
def compact_latest(spark, sf_dir):
    return L.compact(tickets(spark, sf_dir).select("customer_id", "arrival", "event_id"), "customer_id", ["arrival", "event_id"]).select("customer_id", "event_id")


@query(
    f""", x as (select *, event_id % 6 = 1 as empty from t), m as (select customer_id, arg_max(event_id, row(arrival, event_id)) as event_id from x group by customer_id)
select customer_id, event_id from x join m using (customer_id, event_id) where not (empty and created_ms <= {NOW_MS} - 86400000)"""
)
def compact_tombstones(spark, sf_dir):
    """In two steps: the first half of the log, then the rest onto what it left."""
    t = tickets(spark, sf_dir)
    value = F.when(F.col("event_id") % 6 != 1, F.col("ticket_id"))
    rows = t.select("customer_id", "arrival", "event_id", F.timestamp_millis("created_ms").alias("timestamp"), value.alias("value"))
    gone = L.tombstone(F.timestamp_millis(F.lit(NOW_MS)), "24 hours")
    early = F.col("arrival") < 5000
    half = L.compact_onto(rows.limit(0), rows.where(early), "customer_id", ["arrival", "event_id"], gone)
    return L.compact_onto(half, rows.where(~early), "customer_id", ["arrival", "event_id"], gone).select("customer_id", "event_id")


# Decoding

LOGGED = f", k as (select *, {P.KIND} as kind from t)\n"


@query(LOGGED + "select event_id, case kind when 'short' then '4 bytes are too short for a frame' when 'json' then 'magic byte 123 instead of 0' end as problem from k where kind <> 'tombstone'")
def frame_check(spark, sf_dir):
    return raw_log(spark, sf_dir).where("value is not null").select("event_id", decode.frame_error(F.col("value")).alias("problem"))


@query(
    LOGGED
    + """select event_id, case kind when 'unknown' then 999999 when 'v1' then 1 when 'enriched' then 3 else 2 end as schema_id,
  case kind when 'unknown' then null when 'v1' then 'Ticket1' when 'enriched' then 'EnrichedTicket1' else 'Ticket2' end as writer, case kind when 'unknown' then 'unknown schema id 999999' end as problem
from k where kind not in ('tombstone', 'short', 'json')"""
)
def schema_lookup(spark, sf_dir):
    rows = decode.read_frames(raw_log(spark, sf_dir), decode.catalog(spark)).where("schema_id is not null")
    return rows.select("event_id", "schema_id", F.concat("record", F.col("version").cast("string")).alias("writer"), F.col("error").alias("problem"))


@query(
    LOGGED
    + f"""select event_id, case when kind in ('v1', 'v2') then {P.WIRE_ID} end as ticket_id, case when kind in ('v1', 'v2') then created_ms end as created_at, case when kind in ('v1', 'v2') then body end as body,
  case kind when 'cut' then 'body cannot be read' when 'symbol' then 'unknown symbol' when 'enriched' then 'written as EnrichedTicket' end as problem
from k where kind in ('v1', 'v2', 'cut', 'symbol', 'enriched')"""
)
def decode_body(spark, sf_dir):
    framed = decode.read_frames(raw_log(spark, sf_dir), decode.catalog(spark)).where("error is null and value is not null")
    return decode.decode_body(framed).select("event_id", "r.ticket_id", "r.created_at", "r.body", F.col("error").alias("problem"))


@query(LOGGED + "select case kind when 'v1' then 1 else 2 end as version, case kind when 'v1' then 'free' else tier end as tier, count(*) as n from k where kind in ('v1', 'v2') group by all")
def evolve_v1_to_v2(spark, sf_dir):
    rows = decode.decode_body(decode.read_frames(raw_log(spark, sf_dir), decode.catalog(spark))).where("r is not null")
    return rows.groupBy("version", "r.tier").agg(F.count("*").alias("n"))


@query("select event_id, created_ms as ms from t")
def ts_millis(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.unix_millis(C.to_millis(F.col("ts").cast("timestamp"))).alias("ms"))


# Validation

_RE2_BLANK = r"[\t\n\x0B\f\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    rf"""with p as (select conv_id, turn, chr(9) || chr(160) || text || case turn % 3 when 0 then chr(8195) || ' ' when 1 then chr(8203) else chr(10) end as padded from conversations)
select conv_id, turn, regexp_replace(regexp_replace(padded, '^{_RE2_BLANK}', ''), '{_RE2_BLANK}$', '') as stripped from p"""
)
def strip_text(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tail = F.when(F.col("turn") % 3 == 0, F.lit(" " + " ")).when(F.col("turn") % 3 == 1, F.lit("​")).otherwise(F.lit("\n"))
    return c.select("conv_id", "turn", C.strip(F.concat(F.lit("\t "), F.col("text"), tail)).alias("stripped"))


_TICKET_RULES = "case when not regexp_full_match(customer_id, 'C-[0-9]{4}') then 'customer_id' end, case when length(subject) not between 1 and 200 then 'subject' end, case when trim(body) = '' then 'body' end"


@query(f"select event_id, concat_ws(',', {_TICKET_RULES}) as errors from t")
def validate_tickets(spark, sf_dir):
    rows = validate.stripped(tickets(spark, sf_dir))
    return rows.select("event_id", F.array_join(validate.ticket_errors(time="created_ms"), ",").alias("errors"))


_TWISTED = "case when event_id % 17 = 3 then 'spam' else category end as category, case when event_id % 19 = 4 then 'nan'::double when event_id % 23 = 5 then 1.7 else sentiment end as sentiment, case event_id % 31 when 6 then ' ' when 7 then repeat('s', 301) else summary end as summary"


@query(
    f""", x as (select event_id, customer_id, subject, body, {_TWISTED} from t)
select event_id, concat_ws(',', {_TICKET_RULES}, case when category = 'spam' then 'category' end, case when isnan(sentiment) or sentiment > 1 then 'sentiment' end, case when length(trim(summary)) not between 1 and 300 then 'summary' end) as errors from x"""
)
def validate_enriched(spark, sf_dir):
    t = tickets(spark, sf_dir).selectExpr(
        "* except (category, sentiment, summary)", *[x.strip() for x in _TWISTED.replace("'nan'::double", "double('NaN')").replace("1.7", "1.7D").replace(", case", "|case").split("|")]
    )
    return validate.stripped(t).select("event_id", F.array_join(validate.enriched_errors(time="created_ms", enriched="enriched_ms"), ",").alias("errors"))


@query(
    """, x as (select event_id, case event_id % 3 when 0 then 'category' when 1 then 'priority' else 'channel' end as dimension, case event_id % 2 when 0 then category else priority end as v, event_id % 4 as n from t)
select event_id, concat_ws(',', case when dimension = 'channel' then 'dimension' end,
  case when not coalesce(case dimension when 'category' then v in ('billing', 'technical', 'account', 'other') when 'priority' then v in ('low', 'medium', 'high', 'urgent') end, false) then 'value' end,
  case when n < 1 then 'count' end) as errors from x"""
)
def validate_stats(spark, sf_dir):
    t = tickets(spark, sf_dir)
    rows = t.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "category").when(F.col("event_id") % 3 == 1, "priority").otherwise("channel").alias("dimension"),
        F.when(F.col("event_id") % 2 == 0, F.col("category")).otherwise(F.col("priority")).alias("value"), F.col("created_ms").alias("window_start"), F.col("created_ms").alias("window_end"), (F.col("event_id") % 4).alias("count"),
    )
    return rows.select("event_id", F.array_join(validate.stats_errors(), ",").alias("errors"))


@query(LOGGED + "select part as partition, count(*) filter (where kind = 'tombstone') as dead_letters, count(*) filter (where kind <> 'tombstone') as with_value from k group by part")
def tombstones(spark, sf_dir):
    rows = raw_log(spark, sf_dir)  # no value needs to be decoded for this
    return rows.groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count_if(route.is_tombstone()).alias("dead_letters"), F.count("value").alias("with_value"))


# Routing and dead letters

_JUDGED = (
    LOGGED
    + f""", j as (select *, case kind when 'v1' then 'free' else tier end as new_tier, concat_ws(', ', {_TICKET_RULES}) as broken from k),
o as (select *, case when kind = 'tombstone' then 'ValueError' when kind not in ('v1', 'v2') then 'UndecodableMessage' when broken <> '' then 'ValidationError' end as error_type,
  case kind when 'tombstone' then 'message has no value' when 'short' then '4 bytes are too short for a frame' when 'json' then 'magic byte 123 instead of 0' when 'unknown' then 'unknown schema id 999999' when 'cut' then 'body cannot be read'
    when 'symbol' then 'unknown symbol' when 'enriched' then 'written as EnrichedTicket' else case when broken <> '' then 'invalid: ' || broken end end as error_message from j)
"""
)


@query(_JUDGED + "select part as partition, event_id // 3 as \"offset\", case when error_type is null then 'tickets.valid' else 'tickets.dlq' end as out_topic, customer_id as out_key, error_type, case when error_type is null then ticket_id end as ticket_id, case when error_type is null then new_tier end as tier, case when error_type is null then trim(body) end as body from o")
def validate_split(spark, sf_dir):
    schemas = decode.catalog(spark)
    out = route.validate_split(raw_log(spark, sf_dir), schemas, F.lit("2024-01-30T12:00:00Z"))
    again = decode.decode_body(decode.read_frames(out.withColumn("value", F.when(F.col("out_topic") == VALID, F.col("out_value"))), schemas))
    return again.select(F.col("partition").cast("long").alias("partition"), "offset", "out_topic", text("out_key").alias("out_key"), "error_type", "r.ticket_id", "r.tier", "r.body")


@query(
    _JUDGED
    + """select event_id // 3 as "offset", part as partition, error_type, error_message, 'tickets.raw' as source_topic, cast(part as varchar) as source_partition, cast(event_id // 3 as varchar) as source_offset, '2024-01-30T12:00:00Z' as failed_at
from o where error_type is not null"""
)
def dead_letter_record(spark, sf_dir):
    out = route.validate_split(raw_log(spark, sf_dir), decode.catalog(spark), F.lit("2024-01-30T12:00:00Z")).where("error_type is not null")
    out = out.withColumn("h", C.header_map(F.col("out_headers")))
    h = F.col("h")
    names = ("error.type", "error.message", "source.topic", "source.partition", "source.offset", "failed_at")
    return out.select("offset", F.col("partition").cast("long").alias("partition"), *[F.element_at(h, F.lit(n)).alias(n.replace(".", "_")) for n in names])


@query("with x as (select doc_id, substr(text, 1, 1000) as cut from documents) select doc_id, cast(length(cut) as bigint) as n, md5(cut) as digest from x")
def error_truncate(spark, sf_dir):
    cut = C.truncate_error(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.char_length(cut).cast("long").alias("n"), F.md5(cut.cast("binary")).alias("digest"))


@query(ROUTED + "select event_id, copy, topic from routed")
def route_topics(spark, sf_dir):
    return routed(spark, sf_dir).select("event_id", "copy", "topic")


@query(
    f""", k as (select *, {P.ENRICHED_KIND} as kind from t),
j as (select *, concat_ws(', ', {_TICKET_RULES}, case when kind = 'range' then 'sentiment' end) as broken from k),
o as (select *, case when kind = 'tombstone' then 'ValueError' when kind in ('ticket', 'cut', 'symbol', 'missing') then 'UndecodableMessage' when broken <> '' then 'ValidationError' end as error_type,
  case kind when 'tombstone' then 'message has no value' when 'ticket' then 'written as Ticket' when 'cut' then 'body cannot be read' when 'missing' then 'body cannot be read' when 'symbol' then 'unknown symbol'
    else case when broken <> '' then 'invalid: ' || broken end end as error_message from j)
select event_id, case when kind = 'tombstone' then 'skipped' when error_type is not null then 'dead_letter' else 'counted' end as outcome, error_type, error_message,
  case when error_type is null then category end as category, case when error_type is null then sentiment end as sentiment from o"""
)
def agg_dead_letters(spark, sf_dir):
    rows = route.aggregator_input(enriched_log(spark, sf_dir), decode.catalog(spark))
    good = F.col("error_type").isNull()
    return rows.select("event_id", "outcome", "error_type", "error_message", F.when(good, F.col("r.category")).alias("category"), F.when(good, F.col("r.sentiment")).alias("sentiment"))


@query(
    """, x as (select event_id, tier, case event_id % 10 when 2 then null when 4 then '' else summary end as summary, case event_id % 10 when 6 then 'fax' else channel end as channel, event_id % 10 = 8 as gone from t)
select event_id, case when gone then null when summary is null then 'missing body' when channel = 'fax' then 'unknown symbol in channel' end as refused,
  case when gone or summary is null or channel = 'fax' then null else summary end as body, case when gone or summary is null or channel = 'fax' then null else tier end as tier from x"""
)
def encode(spark, sf_dir):
    t = tickets(spark, sf_dir).withColumn("created_at", F.col("created_ms"))
    t = t.withColumn("body", F.when(F.col("event_id") % 10 == 4, "").when(F.col("event_id") % 10 != 2, F.col("summary"))).withColumn("channel", F.when(F.col("event_id") % 10 == 6, "fax").otherwise(F.col("channel")))
    rows = C.pinned(t, record=F.when(F.col("event_id") % 10 != 8, F.struct(*TICKET.fieldNames())))
    out = C.pinned(decode.encode(rows, "record", 2, TICKET).select("event_id", "encode_error", "encoded"), value=F.col("encoded"))
    again = decode.decode_body(decode.read_frames(out, decode.catalog(spark)))
    return again.select("event_id", F.col("encode_error").alias("refused"), "r.body", "r.tier")


# Enrichment


@query(
    r"""select event_id, md5('Classify this support ticket.' || chr(10) || 'Product: ' || product || chr(10) || 'Channel: ' || channel || chr(10) || 'Subject: ' || subject || chr(10) || 'Body: ' || body || chr(10) || chr(10) ||
'Answer in JSON with category (billing, technical, account, other), priority (low, medium, high, urgent), sentiment (-1.0 to 1.0) and summary (one sentence). Urgent is only for customers who are blocked or lose money.') as digest from t"""
)
def classify_prompt(spark, sf_dir):
    prompt = enrich.classify_prompt(F.col("product"), F.col("channel"), F.col("subject"), F.col("body"))
    return tickets(spark, sf_dir).select("event_id", F.md5(prompt.cast("binary")).alias("digest"))


_RULED = """, c as (select ticket_id, event_id, tier, split_part(subject, ' ', 1) as about from t),
ruled as (select *, case about when 'purchase' then 'billing' when 'error' then 'technical' when 'signup' then 'account' else 'other' end as category,
  case about when 'error' then 'high' when 'purchase' then 'medium' else 'low' end as priority, case about when 'error' then -0.5::double else 0.25::double end as sentiment, 'Customer reports ' || about as summary from c)
"""


@query(_RULED + "select ticket_id, category, priority, sentiment, summary from ruled")
def classify_rules(spark, sf_dir):
    return enrich.classify(tickets(spark, sf_dir).select("ticket_id", "subject"), lambda: enrich.classify_rules).select("ticket_id", "category", "priority", "sentiment", "summary")


@query(
    f""", x as (select event_id, {_TWISTED.replace("'nan'::double", "-3.0")}, priority, event_id % 29 = 8 as cut from t),
y as (select *, case when cut then 'unreadable' else nullif(concat_ws(',', case when category = 'spam' then 'category' end, case when sentiment not between -1 and 1 then 'sentiment' end, case when length(trim(summary)) not between 1 and 300 then 'summary' end), '') end as error from x)
select event_id, error, case when error is null then category end as category, case when error is null then summary end as summary from y"""
)
def parse_classification(spark, sf_dir):
    t = tickets(spark, sf_dir).selectExpr("event_id", "priority", *[x.strip() for x in _TWISTED.replace("'nan'::double", "-3.0D").replace("1.7", "1.7D").replace(", case", "|case").split("|")])
    answer = F.to_json(F.struct("category", "priority", "sentiment", "summary"))
    t = t.select("event_id", F.when(F.col("event_id") % 29 == 8, F.substring(answer, 1, 25)).otherwise(answer).alias("answer"))
    return enrich.checked_answers(t).select("event_id", "error", "category", "summary")


def _flaky():
    """A classifier that fails a number of times given by the ticket's id."""
    failed: dict[str, int] = {}

    def call(ticket: dict) -> dict:
        k = failed[ticket["ticket_id"]] = failed.get(ticket["ticket_id"], 0) + 1
        if k <= int(ticket["ticket_id"][0], 16) % 6:
            raise enrich.ClassifierError("busy")
        return enrich.classify_rules(ticket)

    return call


@query(", x as (select ticket_id, cast('0x' || substr(ticket_id, 1, 1) as bigint) % 6 as fails from t) select ticket_id, least(fails + 1, 4) as attempts, case when fails >= 4 then 'gave up after 4 attempts: busy' end as error from x")
def classify_retry(spark, sf_dir):
    return enrich.classify(tickets(spark, sf_dir).select("ticket_id", "subject"), _flaky, sleep=lambda s: None).select("ticket_id", F.col("attempts").cast("long").alias("attempts"), "error")


@query(_RULED + f"select ticket_id, tier, category, priority, {NOW_MS} as enriched_at, 'rules' as model from ruled", name="enrich")
def enrich_tickets(spark, sf_dir):
    t = tickets(spark, sf_dir).select("ticket_id", "subject", "tier")
    return enrich.enrich(t, lambda: enrich.classify_rules, F.lit(NOW_MS), "rules").select("ticket_id", "tier", "category", "priority", "enriched_at", "model")


def _picky():
    """A classifier that is down for some tickets, answers others badly, and refuses some."""

    def call(ticket: dict) -> dict | str:
        k = int(ticket["ticket_id"][:2], 16) % 9
        if k == 1:
            raise enrich.ClassifierError("busy")
        if k == 2:
            raise ValueError("not a language we know")
        answer = enrich.classify_rules(ticket)
        if k == 3:
            return answer | {"summary": "  ", "sentiment": 2}
        return json.dumps(answer | {"summary": f" {answer['summary']}\n", "priority": "urgent" if k == 4 else answer["priority"]})

    return call


@query(
    _JUDGED
    + f""", q as (select *, cast('0x' || substr(ticket_id, 1, 2) as bigint) % 9 as k, split_part(trim(subject), ' ', 1) as about, unnest(case when event_id % 7 = 0 then [0, 1] else [0] end) as delivery from o),
a as (select *, case about when 'purchase' then 'billing' when 'error' then 'technical' when 'signup' then 'account' else 'other' end as given, coalesce(error_type, case k when 1 then 'LLMError' when 2 then 'ValueError' when 3 then 'LLMError' end) as type,
  coalesce(error_message, case k when 1 then 'gave up after 4 attempts: busy' when 2 then 'not a language we know' when 3 then 'gave up after 4 attempts: unusable answer: sentiment, summary' end) as message from q),
p as (select *, case when k = 4 then 'urgent' else case given when 'technical' then 'high' when 'billing' then 'medium' else 'low' end end as prio from a),
x as (select *, unnest(case when type is null and prio = 'urgent' then [0, 1] else [0] end) as copy from p)
select event_id // 3 + delivery * 1000000000 as "offset", part as partition, copy, case when type is not null then 'tickets.dlq' when copy = 1 then 'tickets.urgent' when given = 'billing' then 'tickets.billing' when given = 'technical' then 'tickets.tech' else 'tickets.enriched.other' end as out_topic,
  customer_id as out_key, type as error_type, message as error_message, case when type is not null then 'tickets.valid' end as source_topic,
  case when type is null then ticket_id end as ticket_id, case when type is null then given end as category, case when type is null then prio end as priority, case when type is null then 'Customer reports ' || about end as summary, case when type is null then {NOW_MS}::bigint end as enriched_at
from x""",
)
def enrich_split(spark, sf_dir):
    log = raw_log(spark, sf_dir).withColumn("topic", F.lit(VALID))
    log = log.unionByName(log.where("event_id % 7 = 0").withColumn("offset", F.col("offset") + 1_000_000_000))  # delivered twice
    schemas = decode.catalog(spark)
    out = enrich.enrich_split(log, schemas, _picky, F.lit(NOW_MS).cast("long"), F.lit("now"), "rules", sleep=lambda s: None)
    out = C.pinned(out, h=C.header_map(F.col("out_headers")))
    framed = out.withColumn("value", F.when(F.col("error_type").isNull(), F.col("out_value")))
    again = decode.decode_body(decode.read_frames(framed, schemas), ENRICHED, "EnrichedTicket")
    told = [F.element_at("h", F.lit(n)).alias(c) for n, c in (("error.type", "error_type"), ("error.message", "error_message"), ("source.topic", "source_topic"))]
    return again.select("offset", F.col("partition").cast("long").alias("partition"), "copy", "out_topic", text("out_key").alias("out_key"), *told, "r.ticket_id", "r.category", "r.priority", "r.summary", "r.enriched_at")


@query("select event_id, case when customer_id[-1] = '0' then 'enterprise' when customer_id[-1] in ('1', '2', '3') then 'pro' else 'free' end as tier from t")
def tier_for(spark, sf_dir):
    return tickets(spark, sf_dir).select("event_id", C.tier_for(F.col("customer_id")).alias("tier"))


# Aggregation


@query(ROUTED + "select topic, count(*) as n, count(distinct event_id) as tickets from routed where topic <> 'tickets.urgent' group by topic")
def enriched_union(spark, sf_dir):
    rows = L.scan(routed(spark, sf_dir), [*COUNTED_TOPICS])
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("tickets"))


@query("select event_id, case when event_id % 6 = 1 then enriched_ms else created_ms end as ms from t")
def event_time(spark, sf_dir):
    t = tickets(spark, sf_dir)
    created = F.when(F.col("event_id") % 6 != 1, F.timestamp_millis("created_ms"))
    return t.select("event_id", C.event_time_ms(created, F.timestamp_millis("enriched_ms")).alias("ms"))


_AGG = (
    f""", k as (select *, {P.ENRICHED_KIND} as kind from t),
j as (select *, concat_ws(', ', {_TICKET_RULES}, case when kind = 'range' then 'sentiment' end) as broken from k),
bad as (select *, case when kind in ('ticket', 'cut', 'symbol', 'missing') then 'UndecodableMessage' else 'ValidationError' end as type,
  case kind when 'ticket' then 'written as Ticket' when 'cut' then 'body cannot be read' when 'missing' then 'body cannot be read' when 'symbol' then 'unknown symbol' else 'invalid: ' || broken end as message from j where kind <> 'tombstone' and (kind in ('ticket', 'cut', 'symbol', 'missing') or broken <> '')),
c as (select * from j where kind <> 'tombstone' and event_id not in (select event_id from bad)),
w as (select 'category' as dimension, category as v, created_ms, arrival, event_id, ticket_id, part from c union all select 'priority', priority, created_ms, arrival, event_id, ticket_id, part from c),
n as (select *, created_ms - created_ms % {SIX_HOURS} as ws, max(created_ms) over (partition by dimension order by arrival, event_id) as newest, max(created_ms) over (partition by dimension) as last from w),
l as (select *, newest - (ws + {SIX_HOURS}) - {HOUR} as late from n),
g as (select *, max(created_ms) over (partition by customer_id order by arrival, event_id rows between unbounded preceding and 1 preceding) as seen from c)
"""
)


@query(
    _AGG
    + f"""select 'tickets.dlq' as out_topic, customer_id as out_key, concat_ws('|', type, message, case category when 'billing' then 'tickets.billing' when 'technical' then 'tickets.tech' else 'tickets.enriched.other' end, part, event_id // 3) as content from bad
union all select 'tickets.stats', dimension || '=' || v, concat_ws('|', dimension, v, ws, ws + {SIX_HOURS}, count(*)) from l where late < 0 and ws + {SIX_HOURS + HOUR} <= last group by dimension, v, ws
union all select 'customers.latest', customer_id, concat_ws('|', ticket_id, created_ms, priority) from g where created_ms > greatest(coalesce(seen, -1), -1)"""
)
def aggregate_records(spark, sf_dir):
    schemas = decode.catalog(spark)
    out = aggregate.aggregate_records(enriched_log(spark, sf_dir), schemas, SIX_HOURS, HOUR, F.lit("now"), ["arrival", "event_id"])
    out = C.pinned(out.withColumnRenamed("out_value", "value"), h=C.header_map(F.col("out_headers")))
    of = lambda topic, reader, record: decode.decode_body(decode.read_frames(out.where(F.col("out_topic") == topic), schemas), reader, record)
    joined = lambda *c: F.concat_ws("|", *c).alias("content")
    dead = out.where(F.col("out_topic") == DEAD).select("out_topic", "out_key", joined(*[F.element_at("h", F.lit(n)) for n in ("error.type", "error.message", "source.topic", "source.partition", "source.offset")]))
    stats = of(STATS, STATS_RECORD, "TicketStats").select("out_topic", "out_key", joined(*[F.col(f"r.{n}") for n in STATS_RECORD.fieldNames()]))
    latest_ = of(LATEST, ENRICHED, "EnrichedTicket").select("out_topic", "out_key", joined("r.ticket_id", "r.created_at", "r.priority"))
    return dead.unionByName(stats).unionByName(latest_).withColumn("out_key", text("out_key"))


@query(
    _AGG
    + f"select l.ticket_id, dimension, v as value, ws as window_start, ws + {SIX_HOURS} as window_end, late as late_by_ms, case t.category when 'billing' then 'tickets.billing' when 'technical' then 'tickets.tech' else 'tickets.enriched.other' end as topic, l.part as partition, l.event_id // 3 as \"offset\" from l join t using (event_id) where late >= 0"
)
def late_report(spark, sf_dir):
    judged = route.aggregator_input(enriched_log(spark, sf_dir), decode.catalog(spark))
    order = ["arrival", "event_id"]
    return windows.late_report(aggregate.judged_tickets(judged, order), SIX_HOURS, HOUR, order=order).withColumn("partition", F.col("partition").cast("long"))


_BY_DIMENSION = ", w as (select 'category' as dimension, category as v, created_ms, arrival, event_id from t union all select 'priority', priority, created_ms, arrival, event_id from t)\n"


@query(_BY_DIMENSION + "select dimension, v as value, created_ms - created_ms % 300000 as window_start, created_ms - created_ms % 300000 + 300000 as window_end, count(*) as count from w group by all")
def window_counts(spark, sf_dir):
    return windows.window_counts(tickets(spark, sf_dir))


_LATE = (
    _BY_DIMENSION
    + f""", n as (select *, created_ms - created_ms % {SIX_HOURS} as ws, max(created_ms) over (partition by dimension order by arrival, event_id) as newest, max(created_ms) over (partition by dimension) as last from w),
l as (select *, newest - (ws + {SIX_HOURS}) - {HOUR} as late from n)
"""
)


@query(_LATE + f"select dimension, v as value, ws as window_start, ws + {SIX_HOURS} as window_end, count(*) as count from l where late < 0 and ws + {SIX_HOURS + HOUR} <= last group by all")
def window_counts_strict(spark, sf_dir):
    return windows.window_counts_strict(tickets(spark, sf_dir), SIX_HOURS, HOUR)


@query(_LATE + f"select event_id, dimension, v as value, ws as window_start, ws + {SIX_HOURS} as window_end, late as late_by_ms from l where late >= 0")
def late_rows(spark, sf_dir):
    return windows.late_rows(tickets(spark, sf_dir), SIX_HOURS, HOUR)


@query(_BY_DIMENSION + "select dimension || '=' || v as key, count(*) as n from w group by all")
def stats_key(spark, sf_dir):
    rows = windows.by_dimension(tickets(spark, sf_dir))
    return rows.groupBy(C.stats_key(F.col("dimension"), F.col("value")).alias("key")).agg(F.count("*").alias("n"))


_ORDERED = ", g as (select *, event_id + (event_id * 37) % 601 as shifted from t), seen as (select *, max(created_ms) over (partition by customer_id order by shifted, event_id rows between unbounded preceding and 1 preceding) as newest from g)\n"


def shifted(spark, sf_dir):
    return tickets(spark, sf_dir).withColumn("shifted", F.expr("event_id + (event_id * 37) % 601"))


@query(_ORDERED + "select customer_id, event_id, created_ms from seen where created_ms > greatest(coalesce(newest, -1), -1)")
def newer_guard(spark, sf_dir):
    return latest.newer_guard(shifted(spark, sf_dir), ["shifted", "event_id"]).select("customer_id", "event_id", "created_ms")


@query(_ORDERED + "select customer_id, arg_max(event_id, row(created_ms, -shifted, -event_id)) as event_id, max(created_ms) as created_ms from g where created_ms >= 0 group by customer_id")
def customers_latest(spark, sf_dir):
    return latest.customers_latest(shifted(spark, sf_dir).select("customer_id", "event_id", "created_ms", "shifted"), ["shifted", "event_id"]).select("customer_id", "event_id", "created_ms")


# Delivery


@query("select ticket_id, event_id from t")
def dedup_tickets(spark, sf_dir):
    t = tickets(spark, sf_dir).select("ticket_id", "event_id", "arrival")
    twice = t.unionByName(t.where("event_id % 3 = 0").withColumn("arrival", F.col("arrival") + 500))
    return sink.dedup(twice).select("ticket_id", "event_id")


@query("select event_id from t where (event_id // 100) % 4 <> 1")
def read_committed(spark, sf_dir):
    rows = raw_log(spark, sf_dir).withColumn("batch_id", F.expr("event_id div 100"))
    return L.read_committed(rows, rows.where("batch_id % 4 <> 1").select("batch_id")).select("event_id")


@query("select 'tickets.raw' as topic, part as partition, max(event_id // 3) + 1 as next_offset from t group by part")
def next_offsets(spark, sf_dir):
    return L.next_offsets(raw_log(spark, sf_dir)).withColumn("partition", F.col("partition").cast("long"))


@query(
    _JUDGED
    + """, v as (select *, cast('0x' || substr(ticket_id, 1, 1) as bigint) % 6 < 4 as answered, case split_part(trim(subject), ' ', 1) when 'purchase' then 'billing' when 'error' then 'technical' when 'signup' then 'account' else 'other' end as kind_of from o)
select count(*) as seen, count(*) filter (where error_type is null) as valid, count(error_type) as dead_lettered, count(*) filter (where error_type = 'UndecodableMessage') as undecodable,
  count(*) filter (where error_type is null and answered) as enriched, count(*) filter (where error_type is null and not answered) as failed,
  count(*) filter (where error_type is null and answered and kind_of = 'billing') as routed_billing, count(*) filter (where error_type is null and answered and kind_of = 'technical') as routed_tech,
  count(*) filter (where error_type is null and answered and kind_of in ('account', 'other')) as routed_other from v"""
)
def run_counters(spark, sf_dir):
    rows = route.judged(raw_log(spark, sf_dir), decode.catalog(spark))
    valid = rows.where("error_type is null").select("r.ticket_id", "r.subject")
    answers = enrich.classify(valid, _flaky, sleep=lambda s: None)
    topics = C.route_topics(F.col("category"), F.col("priority"))
    routed_to = lambda t: F.count_if(F.array_contains(topics, t))
    first = rows.agg(F.count("*").alias("seen"), F.count_if(F.col("error_type").isNull()).alias("valid"), F.count("error_type").alias("dead_lettered"), F.count_if(F.col("error_type") == "UndecodableMessage").alias("undecodable"))
    second = answers.agg(F.count_if(F.col("error").isNull()).alias("enriched"), F.count("error").alias("failed"), routed_to(BILLING).alias("routed_billing"), routed_to(TECH).alias("routed_tech"), routed_to(OTHER).alias("routed_other"))
    return first.join(F.broadcast(second), F.lit(True))  # one row each


# Logs that are written


def _appended(spark, t, batches=3, **topics):
    """Tickets appended to a log in some batches (by ``event_id``), one of them twice; where it is."""
    path = scratch(spark, "log")
    rows = t.withColumn("timestamp", F.timestamp_millis("created_ms")).withColumn("headers", aggregate.no_headers())
    for number in [*range(batches), batches - 1]:
        log_table.append(rows.where(F.col("event_id") % batches == number), path, "tickets", number, ["arrival", "event_id"], topics or PARTITIONS)
    return path


_KEYED = "cast(('0x' || substr(md5(customer_id), 1, 8)) as bigint)"


@query(f", n as (select *, {_KEYED} % 6 as p from t) select p as partition, row_number() over (partition by p order by event_id % 3, arrival, event_id) - 1 as \"offset\", customer_id as key, ticket_id as value from n")
def keyed_log_sink(spark, sf_dir):
    t = tickets(spark, sf_dir).select(F.lit(RAW).alias("topic"), "created_ms", "arrival", "event_id", F.encode("customer_id", "UTF-8").alias("key"), F.encode("ticket_id", "UTF-8").alias("value"))
    return log_table.read(spark, _appended(spark, t), [RAW]).select(F.col("partition").cast("long").alias("partition"), "offset", text("key").alias("key"), text("value").alias("value"))


@query(
    """, n as (select *, row_number() over (order by event_id) - 1 as off, case when event_id % 5 = 2 then null when event_id % 2 = 0 then 'tickets.raw' else 'tickets.valid' end as target from t),
l as (select * from n order by off limit 40)
select n.ticket_id as value, target as topic, 'tickets.dlq:0:' || off as origin, case when l.off is null then 2 else 1 end as batch from n left join l using (off) where target is not null""".replace("n.ticket_id as value, target as topic, 'tickets.dlq:0:' || off", "n.ticket_id as value, n.target as topic, 'tickets.dlq:0:' || n.off").replace("where target is", "where n.target is")
)
def replay_run(spark, sf_dir):
    """Two runs with a dry one between them; the first stops at its limit, a third finds nothing."""
    named = C.headers({"source.topic": F.when(F.col("event_id") % 2 == 0, RAW).otherwise(VALID)})
    t = tickets(spark, sf_dir).select(F.lit(DEAD).alias("topic"), F.timestamp_millis("created_ms").alias("timestamp"), F.encode("customer_id", "UTF-8").alias("key"), F.encode("ticket_id", "UTF-8").alias("value"), F.when(F.col("event_id") % 5 == 2, aggregate.no_headers()).otherwise(named).alias("headers"), "event_id")
    path, progress = scratch(spark, "log"), scratch(spark, "replay")
    log_table.append(t, path, "dead", 0, ["event_id"])
    now = F.timestamp_millis(F.lit(NOW_MS))
    for limit, dry in ((40, False), (None, True), (None, False), (None, False)):
        replay.run(spark, path, progress, now, limit=limit, dry_run=dry)
    again = log_table.read(spark, path, [RAW, VALID], "batch")
    return again.select(text("value").alias("value"), "topic", F.element_at(C.header_map(F.col("headers")), "replayed.from").alias("origin"), "batch")


# Replay


@query(P.DEAD_SQL + "select event_id, 'kind' || (event_id % 4) as error_type, case when event_id % 5 = 2 then 1 else 2 end as entries from d")
def header_map(spark, sf_dir):
    rows = dead_log(spark, sf_dir).select("event_id", C.header_map(F.col("headers")).alias("h"))
    return rows.select("event_id", F.element_at("h", F.lit("error.type")).alias("error_type"), F.size("h").cast("long").alias("entries"))


@query(P.DEAD_SQL + "select event_id, target from d")
def replay_target(spark, sf_dir):
    return dead_log(spark, sf_dir).select("event_id", C.replay_target(F.col("headers")).alias("target"))


def _replayed(spark, sf_dir, limit=None):
    log = dead_log(spark, sf_dir)
    bounds = dead_bounds(log)
    return replay.plan(log, bounds, limit), bounds


@query(P.DEAD_SQL + "select dpart as partition, doff as \"offset\" from s")
def replay_snapshot(spark, sf_dir):
    return _replayed(spark, sf_dir)[0].select(F.col("partition").cast("long").alias("partition"), "offset")


@query(P.DEAD_SQL + ", m as (select * from s order by dpart, doff limit 50) select dpart as partition, doff as \"offset\", target from m")
def replay_limit(spark, sf_dir):
    return _replayed(spark, sf_dir, 50)[0].select(F.col("partition").cast("long").alias("partition"), "offset", "target")


@query(P.DEAD_SQL + "select target as topic, customer_id as key, summary as value, 'tickets.dlq:' || dpart || ':' || doff as origin from s where target is not null")
def replay_rows(spark, sf_dir):
    out = replay.records(_replayed(spark, sf_dir)[0])
    return out.select("topic", text("key").alias("key"), text("value").alias("value"), F.element_at(C.header_map(F.col("headers")), "replayed.from").alias("origin"))


@query(
    P.DEAD_SQL
    + """, c as (select count(*) as seen, count(target) as replayed, count(*) - count(target) as skipped from s), p as (select bpart, coalesce((select max(doff) + 1 from s where dpart = bpart), next_offset) as after, next_offset from b)
select bpart as partition, next_offset as dry_offset, after as real_offset, seen, replayed, skipped from p, c"""
)
def replay_dry_run(spark, sf_dir):
    planned, bounds = _replayed(spark, sf_dir)
    dry, real = replay.progress(planned, bounds, True), replay.progress(planned, bounds)
    both = dry.withColumnRenamed("next_offset", "dry_offset").join(real.withColumnRenamed("next_offset", "real_offset"), "partition")
    # one row of counts beside a row per partition
    return both.join(F.broadcast(replay.counts(planned)), F.lit(True)).withColumn("partition", F.col("partition").cast("long"))


# Reports


@query(
    f"""select count(*) as total, count(*) filter (where created_ms > {NOW_MS - HOUR}) as last_hour,
  round(quantile_cont(enriched_ms - created_ms, 0.5) filter (where enriched_ms > {NOW_MS - HOUR}) / 1000, 6) as classify_seconds,
  round(quantile_cont(loaded_ms - enriched_ms, 0.5) filter (where enriched_ms > {NOW_MS - HOUR}) / 1000, 6) as sink_seconds from t"""
)
def headline(spark, sf_dir):
    return reports.headline(tickets(spark, sf_dir), NOW_MS)


_STATS = _BY_DIMENSION + ", st as (select dimension, v as value, created_ms - created_ms % 3600000 as window_start, count(*) as count from w group by all)\n"


@query(_STATS + "select window_start, value, count from st where dimension = 'category' and window_start >= (select min(window_start) from (select distinct window_start from st where dimension = 'category' order by 1 desc limit 24))")
def recent_windows(spark, sf_dir):
    return reports.recent_windows(hourly(spark, sf_dir), "category")


@query("select category, round(avg(sentiment), 6) as avg_sentiment, count(*) as n from t group by category")
def sentiment_by_category(spark, sf_dir):
    return reports.sentiment_by_category(tickets(spark, sf_dir))


@query("select created_ms, customer_id, category, priority, sentiment, summary from t order by created_ms desc, ticket_id limit 20")
def latest_tickets(spark, sf_dir):
    return reports.latest_tickets(tickets(spark, sf_dir))


@query(
    _STATS
    + """select window_start, coalesce(sum(count) filter (where value = 'low'), 0)::bigint as low, coalesce(sum(count) filter (where value = 'medium'), 0)::bigint as medium,
  coalesce(sum(count) filter (where value = 'high'), 0)::bigint as high, coalesce(sum(count) filter (where value = 'urgent'), 0)::bigint as urgent from st where dimension = 'priority' group by window_start"""
)
def stats_pivot(spark, sf_dir):
    return reports.stats_pivot(hourly(spark, sf_dir).where("dimension = 'priority'"), PRIORITIES)


@query(
    """, x as (select event_id, case when event_id % 13 = 0 then null when event_id % 5 = 1 then (event_id % 3000) / 20.0::double when event_id % 5 = 2 then (event_id % 400) / 16.0::double else ((event_id * 7919) % 1000000) / 1000.0::double / (1 + 500 * (event_id % 3)) + 0.00013 end as s from t)
select event_id, case when s is null then '—' when s < 1 then printf('%.0f', s * 1000) || ' ms' when s < 60 then printf('%.1f', s) || ' s' else printf('%.1f', s / 60) || ' min' end as shown from x"""
)
def format_duration(spark, sf_dir):
    ties = F.when(F.col("event_id") % 5 == 1, F.expr("(event_id % 3000) / 20.0D")).when(F.col("event_id") % 5 == 2, F.expr("(event_id % 400) / 16.0D"))
    s = F.when(F.col("event_id") % 13 != 0, F.coalesce(ties, F.expr("((event_id * 7919) % 1000000) / 1000.0D / (1 + 500 * (event_id % 3)) + 0.00013D")))
    return tickets(spark, sf_dir).select("event_id", C.format_duration(s).alias("shown"))
