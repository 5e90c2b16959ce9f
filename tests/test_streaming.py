"""Streams of one file per batch, restarts, and equality with the batch operators."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from quaystone.operators import decode, enrich, latest, route, windows
from quaystone.schema import LOG
from quaystone.streaming import tickets as S
from tests.test_operators import STORY, WANT, story

SCHEMA = "category string, priority string, created_ms long, arrival long, event_id long"


@pytest.fixture(autouse=True)
def settings(spark):
    S.configure(spark)


def append(rows, path):
    rows.coalesce(1).write.mode("append").parquet(path)


def run(stream, tmp_path, name="q", checkpoint=None):
    out = str(tmp_path / f"out-{name}")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return out


def test_watermark_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in (STORY[:5], STORY[5:6], STORY[6:]):
        append(story(spark, part), path)
    out = run(S.window_counts(S.read_table(spark, path, SCHEMA), "60 seconds", "10 seconds"), tmp_path)
    assert {(r.dimension, r.value, r["count"]) for r in spark.read.parquet(out).collect()} == WANT


def test_strict_windows_equal_batch_and_survive_restart(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = spark.range(300).selectExpr(
        "element_at(array('billing','technical','other'), cast(id % 3 + 1 as int)) as category", "element_at(array('low','urgent'), cast(id % 2 + 1 as int)) as priority",
        "(id * 7 + (id * 37) % 101) * 1000 as created_ms", "id as arrival", "id as event_id",
    )
    for k in range(3):  # a new query on the same checkpoint each time
        append(rows.where(f"arrival >= {k * 100} and arrival < {k * 100 + 100}"), path)
        out = run(S.strict_window_counts(S.read_table(spark, path, SCHEMA), 60_000, 10_000), tmp_path, checkpoint=checkpoint)
    got = {tuple(r) for r in spark.read.parquet(out).select("dimension", "value", "window_start", "window_end", "count").collect()}
    want = {tuple(r) for r in windows.window_counts_strict(rows, 60_000, 10_000).collect()}
    assert got == want and len(want) > 50


def test_guard_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([("C-1", t, i, i) for i, t in enumerate((10, 5, 20, 10))] + [("C-2", 3, 4, 4)], S.LATEST_ROW)
    for k in range(5):
        append(rows.where(f"arrival = {k}"), path)
    out = run(S.newer_guard(S.read_table(spark, path, S.LATEST_ROW)), tmp_path)
    got = {r.event_id for r in spark.read.parquet(out).collect()}
    assert got == {r.event_id for r in latest.newer_guard(rows, ["arrival", "event_id"]).collect()} == {0, 2, 4}


def test_batches_are_written_once(spark, tmp_path):
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    for part in (STORY[:3], STORY[3:]):
        append(story(spark, part), path)
    stream = S.read_table(spark, path, SCHEMA)
    S.write_batches(stream, table, str(tmp_path / "cp1")).awaitTermination(120)
    # the progress is lost after the write: all batches are redone over the old ones
    S.write_batches(S.read_table(spark, path, SCHEMA), table, str(tmp_path / f"cp-{uuid.uuid4().hex}")).awaitTermination(120)
    assert spark.read.parquet(table).count() == len(STORY)
    assert spark.read.parquet(f"{table}_ledger").count() == 2


def raw(spark, rows):
    """Log rows of ``(offset, value)``."""
    return spark.createDataFrame([("tickets.raw", 0, n, None, b"k", value, []) for n, value in rows], LOG)


def framed(schema, **fields):
    return b"\0" + schema.to_bytes(4, "big") + json.dumps(fields).encode()


GOOD = {"ticket_id": "00000000-0000-4000-8000-000000000001", "customer_id": "C-0042", "created_at": 1, "channel": "email", "product": "p", "subject": " error here ", "body": "b"}


def test_validate_and_route_work_on_streams(spark, tmp_path):
    """The stateless operators give the same rows on a stream as on the whole table."""
    path = str(tmp_path / "in")
    rows = [framed(1, **GOOD), framed(2, **GOOD, tier="pro"), framed(2, **(GOOD | {"body": " "}), tier="pro"), b"{}", None, framed(999999, **GOOD), b"\xff\xfe"]
    whole = raw(spark, list(enumerate(rows)))
    for n in range(len(rows)):
        append(whole.where(f"offset = {n}"), path)
    schemas, at = decode.catalog(spark), F.lit("t")
    stream = S.read_table(spark, path, LOG, 2)
    key = lambda df: sorted(str(r) for r in df.collect())
    got = spark.read.parquet(run(route.validate_split(stream, schemas, at), tmp_path, "split"))
    want = route.validate_split(whole, schemas, at)
    assert key(got.select(*want.columns)) == key(want) and want.where("out_topic = 'tickets.valid'").count() == 2

    def enriched(log):
        valid = route.judged(log, schemas).where("error_type is null").select("r.*")
        answers = enrich.classify(valid.select("ticket_id", "subject", "tier"), lambda: enrich.classify_rules)
        return route.fan_out(answers).select("ticket_id", "category", "topic")

    got = spark.read.parquet(run(enriched(S.read_table(spark, path, LOG, 2)), tmp_path, "enriched"))
    assert key(got) == key(enriched(whole)) and {r.topic for r in got.collect()} == {"tickets.tech"}


def test_upserts_keep_the_first_load_over_batches(spark, tmp_path):
    """Later batches overwrite, ``loaded_at`` stays, a redone batch counts once."""
    path, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    columns, wire = "ticket_id string, priority string, loaded_at long", "ticket_id string, priority string, at long"
    parts = [[("a", "low", 1), ("b", "low", 2)], [("a", "urgent", 4), ("a", "high", 3), ("c", "low", 5)], [("b", "medium", 6)]]
    for n, part in enumerate(parts):
        append(spark.createDataFrame(part, wire), path)
        stream = S.read_table(spark, path, wire)
        assert S.upsert_batches(stream, table, checkpoint, columns, ["ticket_id"], ["at"], lambda k: F.lit(100 + k), buckets=3).awaitTermination(120)
    rows = {tuple(r) for r in S.read_upserted(spark, table, columns).select("ticket_id", "priority", "loaded_at").collect()}
    assert rows == {("a", "urgent", 100), ("b", "medium", 100), ("c", "low", 101)}
    for name in ("2", ".2.crc"):  # the last batch is done again
        os.remove(f"{checkpoint}/commits/{name}")
    assert S.upsert_batches(S.read_table(spark, path, wire), table, checkpoint, columns, ["ticket_id"], ["at"], lambda k: F.lit(900 + k), buckets=3).awaitTermination(120)
    assert {tuple(r) for r in S.read_upserted(spark, table, columns).select("ticket_id", "priority", "loaded_at").collect()} == rows


def test_repeats_within_the_horizon_are_dropped(spark, tmp_path):
    """At-least-once input: a ticket that is delivered again, in its batch or a later one, is passed on once."""
    path = str(tmp_path / "in")
    parts = [[("a", 0), ("b", 1), ("a", 2)], [("a", 30), ("c", 40)], [("b", 50)]]
    for part in parts:
        append(spark.createDataFrame([(i, s * 1000) for i, s in part], "ticket_id string, ms long"), path)
    stream = S.read_table(spark, path, "ticket_id string, ms long").withColumn("at", F.timestamp_millis("ms"))
    out = run(S.dedup(stream, "ticket_id", "at", "1 hour"), tmp_path)
    assert sorted((r.ticket_id, r.ms) for r in spark.read.parquet(out).collect())[1:] == [("b", 1000), ("c", 40_000)]
    assert spark.read.parquet(out).count() == 3
