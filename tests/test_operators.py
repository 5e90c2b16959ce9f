"""Operators on hand-written rows."""

import json
import os
import statistics

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions import columns as C
from quaystone.operators import decode, enrich, latest, replay, reports, route, sink, validate, windows
from quaystone.plans.queries import QUERIES
from quaystone.schema import LOG, TICKET
from quaystone.sources import log as L
from tests.test_queries import SF

BASE = {"ticket_id": "6f1c2f0e-9c39-4c52-8f5e-3c9d6c1f7a10", "customer_id": "C-0042", "created_at": 1, "channel": "email", "product": "Hub", "subject": "Help", "body": "It broke", "tier": "free"}


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_strip_takes_unicode_blanks_only(spark):
    assert one(spark, C.strip(F.col("t")), t="  \t a b \n") == "a b"
    assert one(spark, C.strip(F.col("t")), t="​a\x1c") == "​a\x1c"
    assert one(spark, C.strip(F.col("t")), t="") == ""


def test_uuid_forms(spark):
    want = "6f1c2f0e-9c39-4c52-8f5e-3c9d6c1f7a10"
    for form in (want, want.upper(), want.replace("-", ""), "{" + want + "}", "urn:uuid:" + want):
        assert one(spark, C.canonical_uuid(F.col("t")), t=form) == want
    for form in ("999", want[:-1], want + "0", "{" + want, want + "\n"):
        assert one(spark, C.canonical_uuid(F.col("t")), t=form) is None


def errors(spark, **changes):
    row = BASE | changes
    frame = spark.createDataFrame([Row(**row)], "ticket_id string, customer_id string, created_at long, channel string, product string, subject string, body string, tier string")
    return validate.stripped(frame).select(validate.ticket_errors()).first()[0]


def test_ticket_rules(spark):
    assert errors(spark) == []
    assert errors(spark, body="   ", subject=" ") == ["subject", "body"]
    assert errors(spark, subject="x" * 200) == []
    assert errors(spark, subject="x" * 201) == ["subject"]
    assert errors(spark, customer_id="C-42") == ["customer_id"]
    assert errors(spark, customer_id="C-٠٠٤٢") == []
    assert errors(spark, channel=" email") == ["channel"]
    assert errors(spark, created_at=None, tier=None) == ["created_at", "tier"]


def test_sentiment_outside_or_nan(spark):
    frame = spark.createDataFrame([("billing", "low", s, "x") for s in (1.0, -1.0, 1.01, float("nan"), None)], "category string, priority string, sentiment double, summary string")
    assert [r[0] for r in frame.select(validate.classification_errors()).collect()] == [[], [], ["sentiment"], ["sentiment"], ["sentiment"]]


def raw(spark, *values):
    rows = [("tickets.raw", 0, i, b"k", v, []) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary, headers array<struct<key:string,value:binary>>")


def test_decode_and_split(spark):
    def framed(schema, **fields):
        return b"\0" + schema.to_bytes(4, "big") + json.dumps(fields).encode()

    v1 = {k: v for k, v in BASE.items() if k != "tier"}
    cases = [
        (framed(2, **BASE), None), (framed(1, **v1), None), (framed(2, **v1), "UndecodableMessage"), (framed(2, **(BASE | {"tier": "gold"})), "UndecodableMessage"),
        (framed(999999, **BASE), "UndecodableMessage"), (b'{"a": 1}', "UndecodableMessage"), (b"\xff\xfe", "UndecodableMessage"), (b"", "UndecodableMessage"), (None, "ValueError"),
        (framed(2, **BASE)[:-4], "UndecodableMessage"), (framed(2, **(BASE | {"body": " "})), "ValidationError"), (framed(1, **(v1 | {"extra": 1})), None),
    ]
    out = route.validate_split(raw(spark, *[c[0] for c in cases]), decode.catalog(spark), F.lit("now")).orderBy("offset").collect()
    assert [r.error_type for r in out] == [c[1] for c in cases]
    assert out[1].out_topic == "tickets.valid" and b'"tier":"free"' in out[1].out_value and out[1].out_key == b"C-0042" and out[1].out_headers == []
    bad = {h.key: h.value.decode() for h in out[5].out_headers}
    assert bad == {"error.type": "UndecodableMessage", "error.message": "magic byte 123 instead of 0", "source.topic": "tickets.raw", "source.partition": "0", "source.offset": "5", "failed_at": "now"}
    assert out[5].out_value == cases[5][0] and out[5].out_key == b"k"


def test_error_is_cut_by_characters(spark):
    assert one(spark, C.truncate_error(F.col("t")), t="é" * 1200) == "é" * 1000


def test_routes(spark):
    for category, priority, want in (("billing", "low", ["tickets.billing"]), ("technical", "urgent", ["tickets.tech", "tickets.urgent"]), ("account", "high", ["tickets.enriched.other"]), ("other", "urgent", ["tickets.enriched.other", "tickets.urgent"])):
        assert one(spark, C.route_topics(F.col("c"), F.col("p")), c=category, p=priority) == want


def test_header_map_last_wins(spark):
    rows = spark.createDataFrame([([("a", b"1"), ("b", None), ("a", b"2")],), (None,), ([],)], "h array<struct<key:string,value:binary>>")
    assert [r[0] for r in rows.select(C.header_map(F.col("h"))).collect()] == [{"a": "2"}, {}, {}]


#: (category, priority, seconds): five in a window, one that closes it, one that is late.
STORY = [("billing", "low", 1), ("billing", "high", 2), ("technical", "urgent", 3), ("account", "low", 4), ("other", "urgent", 5), ("billing", "medium", 130), ("billing", "low", 7)]
WANT = {("category", "billing", 2), ("category", "technical", 1), ("category", "account", 1), ("category", "other", 1), ("priority", "low", 2), ("priority", "high", 1), ("priority", "urgent", 2)}


def story(spark, rows=STORY):
    return spark.createDataFrame([(c, p, s * 1000, i, i) for i, (c, p, s) in enumerate(rows)], "category string, priority string, created_ms long, arrival long, event_id long")


def test_strict_windows(spark):
    got = windows.window_counts_strict(story(spark), 60_000, 10_000).collect()
    assert {(r.dimension, r.value, r["count"]) for r in got} == WANT
    late = windows.late_rows(story(spark), 60_000, 10_000).collect()
    assert {(r.event_id, r.value, r.late_by_ms) for r in late} == {(6, "billing", 60_000), (6, "low", 60_000)}
    closing = [*STORY[:5], ("billing", "medium", 70)]
    assert windows.window_counts_strict(story(spark, closing), 60_000, 10_000).count() == 7


def test_running_max_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("id as arrival", "id as event_id", "'c' as customer_id", "(id * 37) % 601 as created_ms")
    whole = {r.event_id for r in latest.newer_guard(rows, ["arrival", "event_id"]).collect()}
    parts = {r.event_id for r in latest.newer_guard(rows, ["arrival", "event_id"], range_size=7).collect()}
    best, want = -1, set()
    for i in range(1000):
        if i * 37 % 601 > best:
            best = i * 37 % 601
            want.add(i)
    assert whole == parts == want


def test_guard_and_latest(spark):
    rows = spark.createDataFrame([("C-1", t, i, i) for i, t in enumerate((10, 5, 20, 10))] + [("C-2", -5, 9, 9)], "customer_id string, created_ms long, arrival long, event_id long")
    assert [r.created_ms for r in latest.newer_guard(rows, ["arrival", "event_id"]).orderBy("arrival").collect()] == [10, 20]
    assert [(r.customer_id, r.created_ms) for r in latest.customers_latest(rows, ["arrival", "event_id"]).collect()] == [("C-1", 20)]


def test_upsert_keeps_first_load(spark):
    current = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "ticket_id string, kafka_topic string, loaded_at long")
    incoming = spark.createDataFrame([("a", "y", 1), ("a", "z", 2), ("c", "y", 1)], "ticket_id string, kafka_topic string, n long")
    got = sink.upsert(current, incoming, ["ticket_id"], ["n"], F.lit(9)).collect()
    assert {tuple(r) for r in got} == {("a", "z", 1), ("b", "x", 2), ("c", "y", 9)}


def test_replay(spark):
    h = lambda t: [("source.topic", t.encode())] if t else []
    rows = spark.createDataFrame([("tickets.dlq", 0, i, b"k", b"v", h(t)) for i, t in enumerate(("tickets.raw", None, "tickets.valid", "tickets.raw"))], "topic string, partition int, offset long, key binary, value binary, headers array<struct<key:string,value:binary>>")
    bounds = spark.createDataFrame([(0, 0, 3)], "partition int, next_offset long, high long")
    planned = replay.plan(rows, bounds)
    assert tuple(replay.counts(planned).first()) == (3, 2, 1)
    assert replay.progress(planned, bounds).first().next_offset == 3
    assert replay.progress(planned, bounds, dry_run=True).first().next_offset == 0
    assert tuple(replay.counts(replay.plan(rows, bounds, 2)).first()) == (2, 1, 1)
    assert replay.records(planned).orderBy("topic").first().headers[0].value == b"tickets.dlq:0:0"


def test_headline_without_recent_rows(spark):
    rows = spark.createDataFrame([(0, 4000, 5000), (0, 6000, 9000)], "created_ms long, enriched_ms long, loaded_ms long")
    assert tuple(reports.headline(rows, 10_000).first()) == (2, 2, 5.0, 2.0)
    assert tuple(reports.headline(rows, 10**12).first()) == (2, 0, None, None)


def test_pivot_has_gaps_and_unexpected_values(spark):
    stats = spark.createDataFrame([(1, 2, "low", 3), (2, 3, "odd", 1), (2, 3, "high", 4)], "window_start long, window_end long, value string, count long")
    got = reports.stats_pivot(stats, ("low", "high")).orderBy("window_start")
    assert got.columns == ["window_start", "low", "high", "odd"]
    assert [tuple(r) for r in got.collect()] == [(1, 3, 0, 0), (2, 0, 4, 1)]
    assert reports.stats_pivot(stats.limit(0), ("low",)).collect() == []


def test_durations(spark):
    for seconds, shown in ((None, "—"), (0.25, "250 ms"), (12.34, "12.3 s"), (90.0, "1.5 min")):
        assert one(spark, C.format_duration(F.col("s").cast("double")), s=seconds) == shown


def test_retries(spark):
    waits = []

    class Broken:
        def __call__(self, ticket):
            raise enrich.ClassifierError("down")

    rows = spark.createDataFrame([("t", "error issue")], "ticket_id string, subject string")
    got = enrich.classify(rows, Broken, sleep=lambda s: waits.append(s)).first()
    assert (got.attempts, got.error) == (4, "gave up after 4 attempts: down")
    assert enrich.Retry().waits() == [1.0, 2.0, 4.0]


def test_log_helpers(spark):
    rows = spark.createDataFrame([("t", 0, 5, "a"), ("t", 0, 7, "a"), ("t", 1, 0, "b")], "topic string, partition int, offset long, k string")
    assert [tuple(r) for r in L.next_offsets(rows).collect()] == [("t", 0, 8), ("t", 1, 1)]
    assert {(r.k, r.offset) for r in L.compact(rows, "k", ["offset"]).collect()} == {("a", 7), ("b", 0)}
    assert L.kafka_source_options("h:1", ["a", "b"])["subscribe"] == "a,b"


def test_encode_refuses_what_the_schema_lacks(spark):
    """A record without a required field or with an unknown symbol is not written; a null record is a tombstone."""
    fields = ("t", "C-0001", 5, "email", "p", "s", "b", "free")
    rows = [fields, (*fields[:6], None, "free"), (*fields[:3], "fax", *fields[4:]), (*fields[:6], "", "free"), None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("record", TICKET)]))
    got = {r.n: r for r in decode.encode(frame, "record", 2, TICKET).collect()}
    assert [got[n].encode_error for n in range(5)] == [None, "missing body", "unknown symbol in channel", None, None]
    assert [got[n].encoded is None for n in range(5)] == [False, True, True, False, True]


def test_another_codec_takes_the_place_of_json(spark):
    """Bodies as comma-separated values."""
    reader = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    corrupt = T.StructType([*reader.fields, T.StructField(decode.CORRUPT, T.StringType())])
    codec = decode.Codec(lambda body, _: F.from_csv(F.decode(body, "UTF-8"), ", ".join(f"{f.name} string" for f in corrupt.fields), {"columnNameOfCorruptRecord": decode.CORRUPT}), lambda r: F.encode(F.concat_ws(",", r["a"], r["b"]), "UTF-8"))
    rows = spark.createDataFrame([(1, ("x", "y")), (2, ("x", None))], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("r0", reader)]))
    out = decode.encode(rows, "r0", 7, reader, codec).select("n", F.col("encoded").alias("value"))
    schemas = spark.createDataFrame([(7, "s", 1, "Pair", ["a", "b"])], decode.CATALOG_TYPE)
    got = {r.n: r.r for r in decode.decode_body(decode.read_frames(out, schemas), reader, "Pair", codec).collect()}
    assert tuple(got[1]) == ("x", "y") and got[2] is None


def test_the_aggregator_counts_enriched_tickets(spark):
    """Enriched records are counted; raw tickets, broken bytes and broken rules are dead letters; a null value is skipped."""
    good = {"ticket_id": "00000000-0000-4000-8000-000000000001", "customer_id": "C-0001", "created_at": 1, "channel": "chat", "product": "p", "subject": "s", "body": "b", "tier": "free"}
    more = {"category": "billing", "priority": "low", "sentiment": 0.5, "summary": " fine ", "enriched_at": 2, "model": "m"}
    frame = lambda n, fields: b"\0" + n.to_bytes(4, "big") + json.dumps(fields).encode()
    values = [frame(3, good | more), frame(2, good), frame(3, good | more | {"sentiment": 2.0}), frame(3, good | more | {"category": "spam"}), frame(3, good), b"\xff\xfe", None]
    log = spark.createDataFrame([("tickets.billing", 0, i, None, None, v, []) for i, v in enumerate(values)], LOG)
    got = {r.offset: r for r in route.aggregator_input(log, decode.catalog(spark)).collect()}
    assert [got[i].outcome for i in range(7)] == ["counted", *["dead_letter"] * 5, "skipped"]
    assert got[0].r.summary == "fine" and [got[i].error_type for i in range(1, 4)] == ["UndecodableMessage", "ValidationError", "UndecodableMessage"]


@pytest.mark.parametrize("values", [[], [None], [7], [1, 2], [5, 1, 9], [3, 3, 3, 100_000], [0, 70_000, 140_000, 210_000], [-5, -70_000, 8]])
def test_medians(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    known = [v for v in values if v is not None]
    assert reports.median(frame, F.col("v")).first()[0] == (statistics.median(known) if known else None)


def test_pivot_refuses_too_many_columns(spark):
    stats = spark.createDataFrame([(0, 60, f"v{i}", i) for i in range(5)], "window_start long, window_end long, value string, count long")
    assert len(reports.stats_pivot(stats, ("v0",), 4).columns) == 6 and reports.stats_long(stats).count() == 5
    with pytest.raises(ValueError):
        reports.stats_pivot(stats, ("v0",), 3)


def test_no_query_fails_to_compile(spark, capfd):
    """Records are decoded once per row, so generated code stays within bounds."""
    if os.path.isdir(SF):
        for name in ("schema_lookup", "decode_body", "validate_split", "dead_letter_record", "agg_dead_letters", "encode"):
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        assert "grows beyond 64 KB" not in "".join(capfd.readouterr())
