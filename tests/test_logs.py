"""Records that are written: the enricher, logs with offsets, replay runs, the aggregator, batches of streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quaystone.functions import columns as C
from quaystone.operators import aggregate, decode, enrich, replay, route, windows
from quaystone.plans import tickets as P
from quaystone.schema import DEAD, LOG, RAW, STATS_RECORD, VALID
from quaystone.sources import log as L
from quaystone.sources import log_table
from quaystone.streaming import tickets as S
from tests.test_operators import BASE
from tests.test_queries import SF
from tests.test_streaming import append, framed

ID = BASE["ticket_id"]
TICKET = {k: v for k, v in BASE.items()}


def log_rows(spark, *values, topic=VALID):
    return spark.createDataFrame([(topic, 0, n, datetime.datetime(2024, 1, 1), b"k", v, []) for n, v in enumerate(values)], LOG)


def outputs(out):
    return [(r.offset, r.copy, r.out_topic, r.error_type, r.error_message) for r in out.orderBy("offset", "copy").collect()]


# The enricher


def enriched(spark, log, classifier, **more):
    return enrich.enrich_split(log, decode.catalog(spark), lambda: classifier, F.lit(7).cast("long"), F.lit("now"), "m", sleep=lambda s: None, **more)


def test_repeats_stay_one_for_one(spark):
    """Three tickets, one delivered twice: four rows, as outputs and as plain columns."""
    rows = [TICKET | {"ticket_id": ID[:-1] + c} for c in "0110"[:3]] + [TICKET | {"ticket_id": ID[:-1] + "2"}]
    out = enriched(spark, log_rows(spark, *[framed(2, **r) for r in rows]), enrich.classify_rules)
    assert len(outputs(out)) == 4
    t = spark.createDataFrame([(ID, "error here"), (ID, "error here"), (ID[:-1] + "1", "purchase")], "ticket_id string, subject string")
    assert enrich.enrich(t, lambda: enrich.classify_rules, F.lit(1), "m").count() == 3


def test_only_valid_tickets_reach_the_classifier(spark):
    """One that always fails gives a dead letter; what cannot be read, breaks a rule or has no value is not asked about."""

    def down(ticket):
        raise enrich.ClassifierError(f"down for {ticket['ticket_id']}")

    bad = [None, b"", framed(999999, **TICKET), framed(2, **(TICKET | {"body": " "}))]
    out = outputs(enriched(spark, log_rows(spark, *bad, framed(2, **TICKET)), down))
    assert [o[2:4] for o in out] == [(DEAD, "ValueError"), (DEAD, "UndecodableMessage"), (DEAD, "UndecodableMessage"), (DEAD, "ValidationError"), (DEAD, "LLMError")]
    assert out[-1][4] == f"gave up after 4 attempts: down for {ID}" and not any("down" in o[4] for o in out[:-1])


def test_retries_and_outputs(spark):
    waits, asked = [], []

    def second_time(ticket):
        asked.append(ticket)
        if len(asked) < 3:
            raise enrich.ClassifierError("busy")
        return {"category": "technical", "priority": "urgent", "sentiment": -1, "summary": " It broke. "}

    found = enrich.attempt(second_time, TICKET, enrich.Retry(), waits.append)
    assert found == {"category": "technical", "priority": "urgent", "sentiment": -1.0, "summary": "It broke.", "attempts": 3} and waits == [1.0, 2.0]
    log = log_rows(spark, framed(1, **{k: v for k, v in TICKET.items() if k != "tier"}))
    out = enriched(spark, log, lambda t: json.dumps({"category": "technical", "priority": "urgent", "sentiment": 0, "summary": "x"}))
    rows = out.orderBy("copy").collect()
    assert [r.out_topic for r in rows] == ["tickets.tech", "tickets.urgent"] and {bytes(r.out_key) for r in rows} == {b"C-0042"} and all(r.out_headers == [] and r.attempts == 1 for r in rows)
    assert rows[0].out_value == rows[1].out_value and rows[0].out_value[:5] == b"\0\0\0\0\3"
    assert json.loads(rows[0].out_value[5:]) == TICKET | {"category": "technical", "priority": "urgent", "sentiment": 0.0, "summary": "x", "enriched_at": 7, "model": "m"}


@pytest.mark.parametrize(
    ("answer", "problem"),
    [("{", "not JSON"), ("[1]", "not an object"), ({"category": "spam", "priority": "low", "sentiment": 0.0, "summary": "x"}, "category"), ({"category": "other", "priority": "low", "sentiment": float("nan"), "summary": "x" * 301}, "sentiment, summary"), ({}, "category, priority, sentiment, summary")],
)
def test_unusable_answers(answer, problem):
    found = enrich.attempt(lambda t: answer, TICKET, enrich.Retry(attempts=2), lambda s: None)
    assert found == {"error_type": "LLMError", "error": f"gave up after 2 attempts: unusable answer: {problem}", "attempts": 2}


def test_other_errors_stop_the_job(spark):
    def broken(ticket):
        raise RuntimeError("no network")

    with pytest.raises(Exception, match="no network"):
        enriched(spark, log_rows(spark, framed(2, **TICKET)), broken).collect()
    refused = enrich.attempt(lambda t: int("x"), TICKET, enrich.Retry(), lambda s: pytest.fail("waited"))
    assert refused["error_type"] == "ValueError" and refused["attempts"] == 1


def test_enricher_on_a_stream(spark, tmp_path):
    S.configure(spark)
    values = [framed(2, **TICKET), None, b"{}", framed(1, **{k: v for k, v in TICKET.items() if k != "tier"}), framed(2, **TICKET)]
    whole, path = log_rows(spark, *values), str(tmp_path / "in")
    for n in range(len(values)):
        append(whole.where(f"offset = {n}"), path)
    stream = enriched(spark, S.read_table(spark, path, LOG, 2), enrich.classify_rules)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert outputs(spark.read.parquet(str(tmp_path / "out"))) == outputs(enriched(spark, whole, enrich.classify_rules))


def test_uuids_are_written_in_one_form(spark):
    forms = [ID.upper(), "{" + ID + "}", "urn:uuid:" + ID, ID.replace("-", "").upper(), ID]
    out = route.validate_split(log_rows(spark, *[framed(2, **(TICKET | {"ticket_id": f})) for f in forms]), decode.catalog(spark), F.lit("now")).collect()
    assert {json.loads(r.out_value[5:])["ticket_id"] for r in out} == {ID} and {r.out_topic for r in out} == {VALID}
    again = outputs(route.validate_split(log_rows(spark, framed(2, **(TICKET | {"ticket_id": ID[:-1]}))), decode.catalog(spark), F.lit("now")).withColumn("copy", F.lit(0)))
    assert again[0][3:] == ("ValidationError", "invalid: ticket_id")


# Logs with offsets


def letters(spark, *rows, topic=RAW):
    """Records ``(n, key, value, origin)`` in the order of ``n``."""
    made = [(topic, datetime.datetime(2024, 1, 1 + n % 3), k, v, [("source.topic", o.encode())] if o else [], n) for n, k, v, o in rows]
    return spark.createDataFrame(made, "topic string, timestamp timestamp, key binary, value binary, headers array<struct<key:string,value:binary>>, n int")


def listed(df):
    return sorted((r.partition, r.offset, bytes(r.key) if r.key is not None else None, bytes(r.value)) for r in df.collect())


def test_offsets_go_on_without_gaps(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    record = lambda n: (n, b"K%d" % (n % 17) if n % 10 else None, b"v%03d" % n, None)
    assert log_table.append(letters(spark, *map(record, range(200))).repartition(7), path, "p", 0, ["n"])
    assert log_table.append(letters(spark, *map(record, range(200, 260))), path, "p", 1, ["n"])
    rows = listed(log_table.read(spark, path))
    by_partition = {}
    for partition, offset, key, value in rows:
        assert offset == len(by_partition.setdefault(partition, []))
        by_partition[partition].append(value)
    assert len(rows) == 260 and len(by_partition) == 6
    assert all(values == sorted(values) for values in by_partition.values())  # so keys keep their order, too
    where = {}
    for partition, _, key, _ in rows:
        assert key is None or where.setdefault(key, partition) == partition
    assert {(r.partition, r.next_offset) for r in log_table.next_offsets(spark, path).collect()} == {(p, len(v)) for p, v in by_partition.items()}
    # A batch that is there is not written again, whatever comes with it.
    assert not log_table.append(letters(spark, (1, b"x", b"other", None)), path, "p", 1, ["n"])
    assert listed(log_table.read(spark, path)) == rows


def test_an_unfinished_batch_is_not_there(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    log_table.append(letters(spark, (0, b"a", b"one", None)), path, "p", 0, ["n"])
    second = letters(spark, (1, b"a", b"two", None), (2, b"a", b"three", None))

    def crash(*args):
        raise RuntimeError("lost before the segments")

    with monkeypatch.context() as m:
        m.setattr(log_table, "segments", lambda s, p, f=log_table.segments, seen=[]: f(s, p) if not seen and not seen.append(1) else crash())
        with pytest.raises(RuntimeError, match="segments"):
            log_table.append(second, path, "p", 1, ["n"])
    assert [v for *_, v in listed(log_table.read(spark, path))] == [b"one"]
    log_table.append(letters(spark, (1, b"b", b"of another producer", None)), path, "q", 0, ["n"])
    log_table.append(second, path, "p", 1, ["n"])
    found = listed(log_table.read(spark, path))
    assert {v for *_, v in found} == {b"one", b"two", b"three", b"of another producer"} and len({f[:2] for f in found}) == 4


def test_log_from_a_stream(spark, tmp_path):
    S.configure(spark)
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/log"
    rows = letters(spark, *((n, b"K%d" % (n % 3), b"%02d" % n, None) for n in range(20)))
    for k in range(2):
        append(rows.where(f"n div 10 = {k}"), source)
        for checkpoint in ("cp", f"other{k}"):  # the second has lost its progress and redoes all
            assert log_table.append_batches(S.read_table(spark, source, rows.schema), path, str(tmp_path / checkpoint), "s", ["n"]).awaitTermination(120)
    found = log_table.read(spark, path)
    assert sorted(r.value for r in found.collect()) == [b"%02d" % n for n in range(20)]


def test_days_past_their_time_are_deleted(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log_table.append(letters(spark, *((n, b"k", b"%d" % n, None) for n in range(9)), topic=DEAD), path, "p", 0, ["n"])
    log_table.append(letters(spark, (0, b"k", b"kept", None)), path, "p", 1, ["n"])
    gone = log_table.expire(spark, path, [DEAD], datetime.date(2024, 2, 2))
    assert [g.rpartition("=")[2] for g in gone] == ["2024-01-01", "2024-01-02"]
    assert {v for *_, v in listed(log_table.read(spark, path))} == {b"2", b"5", b"8", b"kept"}
    log_table.append(letters(spark, (9, b"k", b"9", None), topic=DEAD), path, "p", 2, ["n"])
    assert max(o for _, o, *_ in listed(log_table.read(spark, path, [DEAD]))) == 9


def test_compaction_drops_old_tombstones(spark):
    rows = lambda *r: spark.createDataFrame([(k, v, datetime.datetime(2024, 1, d), n) for k, v, d, n in r], "key string, value string, timestamp timestamp, n int")
    gone = L.tombstone(F.lit(datetime.datetime(2024, 1, 10)), "2 days")
    first = L.compact_onto(rows().limit(0), rows(("a", "1", 1, 0), ("b", "1", 1, 1), ("a", None, 2, 2), ("b", None, 9, 3), ("c", "1", 1, 4)), "key", ["n"], gone)
    assert {(r.key, r.value) for r in first.collect()} == {("b", None), ("c", "1")}  # b's tombstone is still to be seen
    second = L.compact_onto(first, rows(("b", "2", 9, 5), ("c", None, 9, 6)), "key", ["n"], gone)
    assert {(r.key, r.value) for r in second.collect()} == {("b", "2"), ("c", None)}


# Replay


@pytest.fixture
def dead(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log_table.append(letters(spark, (0, b"C-0001", b"one", RAW), (1, b"C-0002", b"two", RAW), (2, None, b"orphan", None), (3, b"C-0003", b"loop", DEAD), topic=DEAD), path, "dead", 0, ["n"])
    return path, f"file://{tmp_path}/replayed"



def now():
    return F.lit(datetime.datetime(2024, 3, 1))


def test_replay_runs(spark, dead):
    path, progress = dead
    assert replay.run(spark, path, progress, now(), dry_run=True) == replay.Replayed(4, 3, 1)
    assert log_table.read(spark, path, [RAW]).count() == 0
    assert replay.run(spark, path, progress, now()) == replay.Replayed(4, 3, 1)
    assert sorted(r.value for r in log_table.read(spark, path, [RAW]).collect()) == [b"one", b"two"]
    back = log_table.read(spark, path, [DEAD]).where("offset = 4").first()  # the letter whose origin is the dead-letter log itself
    assert back.value == b"loop" and C and [(h.key, bytes(h.value)) for h in back.headers] == [("replayed.from", f"{DEAD}:0:3".encode())]
    # It came after the bounds were taken, so it waits for the next run, and has no origin any more.
    assert replay.run(spark, path, progress, now()) == replay.Replayed(1, 0, 1)
    assert replay.run(spark, path, progress, now()) == replay.Replayed()


def test_replay_limit_counts_what_is_seen(spark, dead):
    path, progress = dead
    assert replay.run(spark, path, progress, now(), limit=3) == replay.Replayed(3, 2, 1)
    assert replay.run(spark, path, progress, now(), limit=3) == replay.Replayed(1, 1, 0)
    assert log_table.read(spark, path, [RAW]).count() == 2


@pytest.mark.parametrize("step", [1, 2])
def test_replay_after_a_crash(spark, dead, monkeypatch, step):
    """A crash before or after the records are written: the next run sends each letter once, within the first run's bounds."""
    path, progress = dead

    def enter(rows, where, f=replay._enter, seen=[]):
        seen.append(1)
        if len(seen) == 2 and step == 2:
            raise RuntimeError("crash")
        f(rows, where)

    with monkeypatch.context() as m:
        m.setattr(replay, "_enter", enter)
        if step == 1:
            m.setattr(log_table, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            replay.run(spark, path, progress, now())
    log_table.append(letters(spark, (9, b"C-0009", b"later", RAW), topic=DEAD), path, "dead", 1, ["n"])
    assert replay.run(spark, path, progress, F.lit(datetime.datetime(2024, 4, 1))) == replay.Replayed(4, 3, 1)
    assert sorted(r.value for r in log_table.read(spark, path, [RAW]).collect()) == [b"one", b"two"]
    assert {r.timestamp for r in log_table.read(spark, path, [RAW]).collect()} == {datetime.datetime(2024, 3, 1)}
    assert replay.run(spark, path, progress, now()).replayed == 1  # the later one
    assert replay.run(spark, path, progress, now()) == replay.Replayed()


def test_unreadable_ends_and_logs_without_letters(spark, dead, tmp_path):
    path, progress = dead
    for folder in log_table.subfolders(spark, f"{path}/topic={DEAD}/day=2024-01-01"):  # offsets 0 and 3 are gone, the end stays
        log_table.remove(spark, folder)
    assert replay.run(spark, path, progress, now()) == replay.Replayed(2, 1, 1)
    assert replay.run(spark, path, progress, now()) == replay.Replayed()
    assert replay.run(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/no", now()) == replay.Replayed()


# The aggregator


def test_aggregator_records(spark):
    good = TICKET | {"category": "billing", "priority": "low", "sentiment": 0.5, "summary": "s", "enriched_at": 5, "model": "m"}
    values = [framed(3, **(good | {"created_at": t})) for t in (1000, 500, 2000, 90_000)] + [b"junk!!", framed(3, **(good | {"sentiment": 2.0})), None]
    log = log_rows(spark, *values, topic="tickets.billing").withColumn("arrival", F.col("offset"))
    out = aggregate.aggregate_records(log, decode.catalog(spark), 60_000, 10_000, F.lit("now"), ["arrival"]).collect()
    dead = [r for r in out if r.out_topic == DEAD]
    assert [(bytes(r.out_key), bytes(r.out_value)) for r in dead] == [(b"k", values[4]), (b"k", values[5])]
    assert [{h.key: h.value.decode() for h in r.out_headers}["error.type"] for r in dead] == ["UndecodableMessage", "ValidationError"] and len(dead[0].out_headers) == 6
    stats = {bytes(r.out_key): r.out_value for r in out if r.out_topic == "tickets.stats"}
    assert set(stats) == {b"category=billing", b"priority=low"} and stats[b"priority=low"][:5] == b"\0\0\0\0\4"
    assert json.loads(stats[b"category=billing"][5:]) == {"dimension": "category", "value": "billing", "window_start": 0, "window_end": 60_000, "count": 3}
    latest = [json.loads(r.out_value[5:])["created_at"] for r in sorted((r for r in out if r.out_topic == "customers.latest"), key=lambda r: r.arrival)]
    assert latest == [1000, 2000, 90_000]


def test_statistics_that_break_a_rule_stop_the_job(spark):
    rows = spark.createDataFrame([("category", "urgent", 0, 1, 1)], STATS_RECORD)
    with pytest.raises(Exception, match="breaks value"):
        aggregate.stats_records(rows).collect()


# Batches of streams


def test_strict_batches_equal_the_batch_operators(spark, tmp_path):
    """Closed windows and late rows with their places, over restarts and a batch that is done twice."""
    S.configure(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "windows")
    rows = P.tickets(spark, SF).selectExpr("ticket_id", "category", "priority", "created_ms", "arrival", "event_id", "'t' as topic", "cast(part as int) as partition", "event_id div 3 as offset").orderBy("arrival", "event_id")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    hour, step = 3_600_000, 251
    for k in range(3):
        append(rows.where(f"arrival >= {k * step} and arrival < {k * step + step}" if k < 2 else f"arrival >= {2 * step}"), source)
        for checkpoint in ("cp", f"other{k}"):
            query = S.strict_window_batches(S.read_table(spark, source, rows.schema), path, str(tmp_path / checkpoint), 6 * hour, hour)
            assert query.awaitTermination(240)
    listed_ = lambda df, like: sorted(map(tuple, df.select(*like.columns).collect()))
    closed, late = windows.window_counts_strict(rows, 6 * hour, hour), windows.late_report(rows, 6 * hour, hour)
    assert listed_(S.read_closed(spark, path), closed) == sorted(map(tuple, closed.collect()))
    assert listed_(S.read_late(spark, path), late) == sorted(map(tuple, late.collect())) and late.count() > 10


def test_refused_rows_are_written_with_the_batch(spark, tmp_path):
    S.configure(spark)
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    wire = "ticket_id string, subject string, topic string, partition int, offset long, key binary, value binary, readable boolean"
    parts = [[("a", "fine", 0, True), (None, "no id", 1, True), ("b", "x" * 9, 2, True)], [(None, None, 3, False)], [("a", "newer", 4, True)]]
    rules = S.Rules(F.col("readable"), ["ticket_id"], {"subject": 8})
    for part in parts:
        append(spark.createDataFrame([(i, s, "tickets.tech", 0, o, b"k", b"raw%d" % o, r) for i, s, o, r in part], wire), source)
        for cp in (checkpoint, f"{checkpoint}-{len(part)}-{part[0][2]}"):  # the second redoes everything
            stream = S.read_table(spark, source, wire)
            assert S.upsert_batches(stream, table, cp, "ticket_id string, subject string, loaded_at long", ["ticket_id"], ["offset"], lambda k: F.lit(k).cast("long"), 2, rules).awaitTermination(120)
    assert [(r.ticket_id, r.subject, r.loaded_at) for r in S.read_upserted(spark, table, "ticket_id string, subject string, loaded_at long").collect()] == [("a", "newer", 0)]
    refused = {bytes(r.value): {h.key.rpartition(".")[2]: h.value.decode() for h in r.headers} for r in S.read_refused(spark, table).collect()}
    assert {v: (h["stage"], h["offset"], h["message"]) for v, h in refused.items()} == {b"raw1": ("TASK_PUT", "1", "null in ticket_id"), b"raw2": ("TASK_PUT", "2", "too long: subject"), b"raw3": ("VALUE_CONVERTER", "3", "value cannot be converted")}
    before = S.read_upserted(spark, table, "ticket_id string, subject string, loaded_at long").collect()
    assert len(S.vacuum_upserts(spark, table)) == 1 and S.vacuum_upserts(spark, table) == []
    assert S.read_upserted(spark, table, "ticket_id string, subject string, loaded_at long").collect() == before


def test_counters_over_restarts(spark, tmp_path):
    S.configure(spark)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "counters", "cp"))
    listener = S.Counters(spark, "run", path)
    spark.streams.addListener(listener)
    try:
        for k in range(2):
            append(spark.range(k * 10, k * 10 + 10), source)
            rows = S.counted(S.read_table(spark, source, "id long"), "run", odd=F.col("id") % 2 == 1)
            query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
            for _ in range(100):  # listeners are told a little later
                found = {r.counter: r.n for r in S.totals(spark, path).collect()}
                if found.get("seen") == 10 * (k + 1):
                    break
                query.exception()
                __import__("time").sleep(0.2)
            assert found == {"seen": 10 * (k + 1), "odd": 5 * (k + 1)}
    finally:
        spark.streams.removeListener(listener)


# What a log costs


def counted(rows, column):
    """``rows``, whose ``column`` goes through a function that counts its calls."""
    calls = rows.sparkSession.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    return rows.withColumn(column, F.udf(seen, rows.schema[column].dataType)(F.col(column))), calls


def test_aggregator_decodes_a_log_once(spark):
    good = TICKET | {"category": "billing", "priority": "low", "sentiment": 0.5, "summary": "s", "enriched_at": 5, "model": "m"}
    values = [framed(3, **(good | {"created_at": t})) for t in (1000, 500, 90_000)] + [b"junk!!", None]
    log, calls = counted(log_rows(spark, *values, topic="tickets.billing").withColumn("arrival", F.col("offset")).localCheckpoint(), "value")
    out = aggregate.aggregate_records(log, decode.catalog(spark), 60_000, 10_000, F.lit("now"), ["arrival"])
    assert sorted(r.out_topic for r in out.collect()) == ["customers.latest"] * 2 + ["tickets.dlq"] + ["tickets.stats"] * 2
    assert calls.value == len(values)


def test_late_report_reads_its_input_once(spark):
    rows = spark.createDataFrame([(f"t{i}", "billing", "low", t, i, i, "x", 0, i) for i, t in enumerate((1000, 90_000, 500))], "ticket_id string, category string, priority string, created_ms long, arrival long, event_id long, topic string, partition int, offset long")
    rows, calls = counted(rows.localCheckpoint(), "created_ms")
    assert sorted((r.ticket_id, r.dimension, r.late_by_ms) for r in windows.late_report(rows, 60_000, 10_000).collect()) == [("t2", "category", 20_000), ("t2", "priority", 20_000)]
    assert calls.value == 3


def test_rules_and_cleaning_stay_in_generated_code(spark):
    """No lambda, which is evaluated without generated code, and no lower-casing of whole texts."""
    plan = route.judged(log_rows(spark, b"junk!!"), decode.catalog(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Lower" not in plan and "lower(" not in plan


def test_writing_stays_in_generated_code_and_nothing_is_sent_twice(spark):
    """Checks before encoding and the topics need no lambda; the classifier's worker gets each ticket once."""
    plan = enriched(spark, log_rows(spark, b"junk!!"), lambda t: t)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "_ticket" not in plan


def test_tickets_reach_the_classifier_field_by_field(spark):
    seen = spark.createDataFrame([("a", 1, None, [1]), (None, None, 0.5, None), ("c", 3, 1.5, [])], "ticket_id string, n int, x double, many array<int>")
    echo = lambda t: {"category": "other", "priority": "low", "sentiment": 0, "summary": repr(t)}
    got = {r.ticket_id: r.answer and r.answer.summary for r in enrich.called(seen, lambda: echo, seen.columns, F.col("n").isNull() | (F.col("n") == 1)).collect()}
    assert got == {"a": "{'ticket_id': 'a', 'n': 1, 'x': None, 'many': [1]}", None: "{'ticket_id': None, 'n': None, 'x': 0.5, 'many': None}", "c": None}
    nobody = enrich.called(seen, lambda: pytest.fail, seen.columns, F.lit(False)).collect()
    assert [r.answer for r in nobody] == [None] * 3
