"""The ticket domain over the driver's ``events``: tickets, logs and tables.

The same mapping is given as SQL for DuckDB, so queries can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.columns import pinned, route_topics
from quaystone.operators.decode import frame
from quaystone.schema import DEAD, ENRICHED, RAW

NOW_MS = 1_706_616_000_000  # 2024-01-30 12:00:00 UTC

_COLUMNS = """
  concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) as ticket_id,
  case when event_id % 40 = 11 then 'C-42' else concat('C-', lpad(cast(user_id as {text}),4,'0')) end as customer_id,
  created_ms,
  case event_id % 3 when 0 then 'email' when 1 then 'chat' else 'phone' end as channel,
  case event_id % 5 when 0 then 'SmartHome Hub' when 1 then 'CloudDrive Pro' when 2 then 'FitTrack Watch'
                    when 3 then 'StreamBox TV' else 'PayWallet App' end as product,
  case when event_id % 50 = 13 then repeat('x',201) else concat(event_type,' issue') end as subject,
  case when event_id % 20 = 7 then '  ' else concat('details: ', props) end as body,
  case when user_id % 10 = 0 then 'enterprise' when user_id % 10 <= 3 then 'pro' else 'free' end as tier,
  case event_type when 'purchase' then 'billing' when 'error' then 'technical'
                  when 'signup' then 'account' else 'other' end as category,
  case when value >= 100 then 'urgent' when value >= 60 then 'high' when value >= 20 then 'medium' else 'low' end as priority,
  round(least(1e0, greatest(-1e0, 1e0 - value/50e0)),4) as sentiment,
  concat('Customer reports ', event_type) as summary,
  created_ms + 1000 + (event_id % 9) * 500 as enriched_ms,
  created_ms + 1000 + (event_id % 9) * 500 + (event_id % 7) * 1000 as loaded_ms,
  'stub' as model, event_id % 3 as part, event_id + (event_id*37) % 101 as arrival, event_id, event_type, user_id, value
"""

#: Begins a statement for DuckDB: the tickets as ``t``.
SQL = f"""with e as (select *, epoch_us(ts) // 1000 as created_ms, md5(cast(event_id as varchar)) as h from events),
t as (select {_COLUMNS.format(text="varchar")} from e)
"""


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched tickets, a row per event. ``events.ts`` has no zone and is read as UTC."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    e = events.withColumn("created_ms", millis).withColumn("h", F.md5(F.col("event_id").cast("string").cast("binary")))
    return e.selectExpr(*_split(_COLUMNS.format(text="string")))


def _split(columns: str) -> list[str]:
    """The columns of a select list (commas inside brackets do not part them)."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


#: What is wrong with a row of the raw log, by ``event_id % 29``.
KIND = "case event_id % 29 when 3 then 'tombstone' when 5 then 'short' when 7 then 'json' when 9 then 'unknown' when 11 then 'cut' when 13 then 'symbol' when 15 then 'enriched' else case when event_id % 2 = 0 then 'v1' else 'v2' end end"


def _logged(t: DataFrame, topic: Column, value: Column, *columns: str) -> DataFrame:
    """Rows of a log; the value is made once per row, not again in each use."""
    log = pinned(t, framed=value)
    return log.select(
        topic.alias("topic"), F.col("part").cast("int").alias("partition"), F.expr("event_id div 3").alias("offset"), F.timestamp_millis("created_ms").alias("timestamp"),
        F.encode("customer_id", "UTF-8").alias("key"), F.col("framed").alias("value"), F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), *columns,
    )


#: A ticket's id as it is written on the wire, in one of its forms.
WIRE_ID = "case event_id % 5 when 1 then upper(ticket_id) when 2 then concat('{', ticket_id, '}') when 3 then concat('urn:uuid:', ticket_id) when 4 then replace(ticket_id, '-', '') else ticket_id end"


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed tickets of both versions with ids in all forms, and a share of broken rows (`KIND`)."""
    t = tickets(spark, sf_dir).withColumn("kind", F.expr(KIND)).withColumn("created_at", F.col("created_ms"))
    v1 = ("ticket_id", "customer_id", "created_at", "channel", "product", "subject", "body")
    # One record per row: version 1 has no tier, and a null field is left out.
    changed = {"channel": F.when(F.col("kind") == "symbol", F.lit("fax")).otherwise(F.col("channel")), "ticket_id": F.expr(WIRE_ID)}
    fields = [changed.get(c, F.col(c)).alias(c) for c in v1]
    text = F.encode(F.to_json(F.struct(*fields, F.when(F.col("kind") != "v1", F.col("tier")).alias("tier"))), "UTF-8")
    t = pinned(t, text=text)
    number = F.when(F.col("kind") == "v1", 1).when(F.col("kind") == "unknown", 999999).when(F.col("kind") == "enriched", 3).otherwise(2)
    content = F.when(F.col("kind") == "cut", F.substring("text", 1, 40)).otherwise(F.col("text"))
    value = F.when(F.col("kind") == "short", F.unhex(F.lit("00000002"))).when(F.col("kind") == "json", F.col("text")).when(F.col("kind") != "tombstone", frame(number, content))
    return _logged(t, F.lit(RAW), value, "event_id", "kind")


#: What is wrong with a row of the enriched log, by ``event_id % 37``.
ENRICHED_KIND = "case event_id % 37 when 2 then 'tombstone' when 4 then 'ticket' when 6 then 'cut' when 8 then 'symbol' when 10 then 'range' when 12 then 'missing' else 'good' end"


def enriched_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed enriched tickets under their category's topic, and a share of broken rows (`ENRICHED_KIND`)."""
    t = tickets(spark, sf_dir).withColumn("kind", F.expr(ENRICHED_KIND)).withColumns({"created_at": F.col("created_ms"), "enriched_at": F.col("enriched_ms")})
    changed = {
        "category": F.when(F.col("kind") != "symbol", F.col("category")).otherwise(F.lit("spam")), "sentiment": F.when(F.col("kind") != "range", F.col("sentiment")).otherwise(F.lit(1.5)),
        "model": F.when(F.col("kind") != "missing", F.col("model")),
    }
    t = pinned(t, text=F.encode(F.to_json(F.struct(*[changed.get(n, F.col(n)).alias(n) for n in ENRICHED.fieldNames()])), "UTF-8"))
    content = F.when(F.col("kind") == "cut", F.substring("text", 1, 40)).otherwise(F.col("text"))
    value = F.when(F.col("kind") != "tombstone", frame(F.when(F.col("kind") == "ticket", 2).otherwise(3), content))
    return _logged(t, route_topics(F.col("category"), F.lit("low"))[0], value, "event_id", "kind", "arrival")


def dead_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dead letter of every ticket; some name no origin, all have a repeated and a null header."""
    t = tickets(spark, sf_dir)
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    always = [header("error.type", F.lit("first")), header("error.type", F.concat(F.lit("kind"), (F.col("event_id") % 4).cast("string"))), header("empty", F.lit(None).cast("string"))]
    named = header("source.topic", F.when(F.col("event_id") % 2 == 0, F.lit(RAW)).otherwise(F.lit("tickets.valid")))
    return t.select(
        F.lit(DEAD).alias("topic"), F.col("part").cast("int").alias("partition"), F.expr("event_id div 3").alias("offset"), F.timestamp_millis("created_ms").alias("timestamp"),
        F.encode("customer_id", "UTF-8").alias("key"), F.encode("summary", "UTF-8").alias("value"), F.when(F.col("event_id") % 5 == 2, F.array(*always)).otherwise(F.array(*always, named)).alias("headers"), "event_id",
    )


def dead_bounds(log: DataFrame) -> DataFrame:
    """Offsets already replayed, and an end before the log's own."""
    return log.groupBy("partition").agg((F.col("partition") + 5).cast("long").alias("next_offset"), F.expr("(max(offset) * 2) div 3").alias("high"))


#: The dead letters and their bounds for DuckDB, to follow `SQL`.
DEAD_SQL = """, d as (select *, part as dpart, event_id // 3 as doff,
  case when event_id % 5 = 2 then null when event_id % 2 = 0 then 'tickets.raw' else 'tickets.valid' end as target from t),
b as (select dpart as bpart, dpart + 5 as next_offset, max(doff) * 2 // 3 as high from d group by dpart),
s as (select d.* from d join b on dpart = bpart and doff >= next_offset and doff < high)
"""
