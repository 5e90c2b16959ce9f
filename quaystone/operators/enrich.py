"""Classification of tickets: prompt, pluggable classifier with retries, answer check, and the enricher as one operator.

A row goes through the classifier with all its columns (`called`), so nothing is joined
back and a ticket that was delivered twice stays two rows. `enrich_split` is the whole
step from the log of valid tickets to the logs of enriched ones and of dead letters.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.columns import BLANK, pinned, route_topics, strip
from quaystone.operators.decode import JSON, Codec, encode
from quaystone.operators.route import dead_headers, judged
from quaystone.operators.validate import classification_errors
from quaystone.schema import CATEGORIES, DEAD, ENRICHED, ENRICHED_SCHEMA, MAX_SUMMARY, PRIORITIES, TICKET

ANSWER = T.StructType([T.StructField("category", T.StringType()), T.StructField("priority", T.StringType()), T.StructField("sentiment", T.DoubleType()), T.StructField("summary", T.StringType())])


#: What a call adds to a row: the answer, or why there is none. ``error_type`` is a fixed value of the dead letters' headers.
CALL = T.StructType([*ANSWER.fields, T.StructField("error_type", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
CALL_FAILED = "LLMError"


class ClassifierError(Exception):
    """The classifier failed; trying again may help."""


@dataclass(frozen=True)
class Retry:
    """Attempts at a call and the waits between them, doubling from ``first_wait`` seconds."""

    attempts: int = 4
    first_wait: float = 1.0

    def waits(self) -> list[float]:
        return [self.first_wait * 2**k for k in range(self.attempts - 1)]


def classify_prompt(product: Column, channel: Column, subject: Column, body: Column) -> Column:
    """The question put to a model about one ticket."""
    asked = f"Answer in JSON with category ({', '.join(CATEGORIES)}), priority ({', '.join(PRIORITIES)}), sentiment (-1.0 to 1.0) and summary (one sentence). Urgent is only for customers who are blocked or lose money."
    return F.concat(F.lit("Classify this support ticket.\nProduct: "), product, F.lit("\nChannel: "), channel, F.lit("\nSubject: "), subject, F.lit("\nBody: "), body, F.lit("\n\n" + asked))


def classify_rules(ticket: dict) -> dict:
    """A classifier without a model, for tests and as a fallback."""
    about = ticket["subject"].split(" ")[0]
    category = {"purchase": "billing", "error": "technical", "signup": "account"}.get(about, "other")
    priority = {"technical": "high", "billing": "medium"}.get(category, "low")
    return {"category": category, "priority": priority, "sentiment": -0.5 if category == "technical" else 0.25, "summary": f"Customer reports {about}"}


def usable(answer: dict | str) -> dict:
    """A classifier's answer (fields, or JSON text) with its summary stripped; `ClassifierError` if it breaks a rule."""
    if isinstance(answer, str):
        try:
            answer = json.loads(answer)
        except ValueError as e:
            raise ClassifierError("unusable answer: not JSON") from e
    if not isinstance(answer, dict):
        raise ClassifierError("unusable answer: not an object")
    category, priority, sentiment, summary = (answer.get(n) for n in ANSWER.fieldNames())
    summary = summary.strip(BLANK) if isinstance(summary, str) else ""
    number = isinstance(sentiment, int | float) and not isinstance(sentiment, bool)
    rules = {"category": category in CATEGORIES, "priority": priority in PRIORITIES, "sentiment": number and -1 <= sentiment <= 1, "summary": 1 <= len(summary) <= MAX_SUMMARY}
    if not all(rules.values()):
        raise ClassifierError("unusable answer: " + ", ".join(n for n, ok in rules.items() if not ok))
    return {"category": category, "priority": priority, "sentiment": float(sentiment), "summary": summary}


def attempt(call: Callable[[dict], dict | str], ticket: dict, retry: Retry, sleep: Callable[[float], None]) -> dict:
    """`CALL` of one ticket. Failures of the classifier and unusable answers are tried again; a ValueError is the ticket's fault and is not; anything else stops the job."""
    for n, wait in enumerate([*retry.waits(), None], 1):
        try:
            return usable(call(ticket)) | {"attempts": n}
        except ClassifierError as e:
            if wait is None:
                return {"error_type": CALL_FAILED, "error": f"gave up after {n} attempts: {e}", "attempts": n}
            sleep(wait)
        except ValueError as e:
            return {"error_type": type(e).__name__, "error": str(e), "attempts": n}
    raise AssertionError


def _values(column: pa.Array) -> list:
    """`to_pylist`, without a scalar for each text or whole number."""
    plain = pa.types.is_string(column.type) or pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def called(rows: DataFrame, make_classifier: Callable[[], Callable[[dict], dict | str]], ticket: str | list[str], ask: Column, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with struct ``answer`` (`CALL`) for their struct column ``ticket``, or for that of the columns ``ticket``; null, and no call, where ``ask`` does not hold.

    ``make_classifier`` is called once per partition, so clients need not be sent. Nothing goes
    to the worker twice, and only tickets that are asked about become Python's, field by field.
    """
    n, schema = len(rows.columns), T.StructType([*rows.schema.fields, T.StructField("answer", CALL)])
    kind = pa.struct([(f.name, {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in CALL])
    at = rows.columns.index(ticket) if isinstance(ticket, str) else None
    parts = [] if at is not None else [(c, rows.columns.index(c)) for c in ticket]

    def tickets(batch: pa.RecordBatch) -> Iterator[dict | None]:
        if at is not None and batch.column(at).null_count:
            return iter(batch.column(at).to_pylist())
        names = [f.name for f in batch.column(at).type] if at is not None else [c for c, _ in parts]
        columns = batch.column(at).flatten() if at is not None else [batch.column(k) for _, k in parts]
        return (dict(zip(names, values, strict=True)) for values in zip(*map(_values, columns), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_classifier()
        for batch in batches:
            asked = batch.column(n).to_numpy(zero_copy_only=False)
            answers = [attempt(call, t, retry, sleep) for t in tickets(batch.filter(batch.column(n)))]
            of = pa.array(np.cumsum(asked) - 1, pa.int64(), mask=~asked)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(answers, kind).take(of)], names=schema.fieldNames())

    return rows.select("*", F.coalesce(ask, F.lit(False)).alias("_ask")).mapInArrow(run, schema)


def classify(tickets: DataFrame, make_classifier: Callable[[], Callable[[dict], dict]], retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers or errors for ``tickets``, one row each; a failing call never fails the job."""
    rows = called(tickets, make_classifier, tickets.columns, F.lit(True), retry, sleep)
    return rows.select("ticket_id", *[f"answer.{n}" for n in ANSWER.fieldNames()], "answer.error", "answer.attempts")


def parse_answer(answer: Column) -> Column:
    """A model's JSON text as a struct; null fields where it cannot be read."""
    kind = T.StructType([*ANSWER.fields, T.StructField("_corrupt", T.StringType())])
    return F.from_json(answer, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def checked_answers(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """``rows`` with the answer's fields and ``error`` (null if usable)."""
    out = rows.withColumn("a", parse_answer(F.col(answer)))
    field = lambda n: strip(F.col("a.summary")) if n == "summary" else F.col(f"a.{n}")
    bad = F.when(F.col("a").isNull() | F.col("a._corrupt").isNotNull(), "unreadable").otherwise(F.nullif(F.array_join(classification_errors(field), ","), F.lit("")))
    out = out.withColumn("error", bad)
    return out.withColumns({n: F.when(F.col("error").isNull(), field(n)) for n in ANSWER.fieldNames()}).drop("a")


def enrich(tickets: DataFrame, make_classifier: Callable[[], Callable[[dict], dict | str]], enriched_at: Column, model: str, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Tickets with their answers, the time and the model's name; those without a usable answer are left out."""
    rows = called(tickets, make_classifier, tickets.columns, F.lit(True), retry, sleep).where("answer.error_type is null")
    return rows.select(*tickets.columns, *[f"answer.{n}" for n in ANSWER.fieldNames()], enriched_at.alias("enriched_at"), F.lit(model).alias("model"))


def enrich_split(
    log: DataFrame, schemas: DataFrame, make_classifier: Callable[[], Callable[[dict], dict | str]], enriched_at: Column, failed_at: Column, model: str,
    retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep, schema: int = ENRICHED_SCHEMA, codec: Codec = JSON,
) -> DataFrame:
    """The enricher: every output of every row of the log of valid tickets, batch or stream.

    ``copy, out_topic, out_key, out_value, out_headers`` beside the source's ``topic,
    partition, offset`` and ``error_type, error_message, attempts``. A classified ticket
    is written under its customer to its category's topic (``copy`` 0) and, if it is
    urgent, once more (1). A tombstone, a record that cannot be read, one that breaks
    a rule and one without a usable answer become a dead letter with key and bytes as they
    were; only readable, valid tickets reach the classifier. ``enriched_at`` is in milliseconds.
    """
    rows = judged(log, schemas, codec=codec)
    rows = rows.select("topic", "partition", "offset", "key", "value", "r", "error_type", "error_message")
    rows = called(rows, make_classifier, "r", F.col("error_type").isNull(), retry, sleep)
    rows = rows.withColumn("error_type", F.coalesce("error_type", "answer.error_type")).withColumn("error_message", F.coalesce("error_message", "answer.error"))
    good = F.col("error_type").isNull()
    record = F.struct(*[F.col(f"r.{n}") for n in TICKET.fieldNames()], *[F.col(f"answer.{n}") for n in ANSWER.fieldNames()], enriched_at.alias("enriched_at"), F.lit(model).alias("model"))
    rows = encode(pinned(rows, record=F.when(good, record)), "record", schema, ENRICHED, codec)
    value = F.when(good, F.col("encoded")).otherwise(F.col("value"))
    rows = pinned(rows, out_value=value, topics=F.when(good, route_topics(F.col("answer.category"), F.col("answer.priority"))).otherwise(F.array(F.lit(DEAD))))
    return rows.select(
        "topic", "partition", "offset", "error_type", "error_message", F.col("answer.attempts").alias("attempts"), F.posexplode("topics").alias("copy", "out_topic"),
        F.when(good, F.encode("r.customer_id", "UTF-8")).otherwise(F.col("key")).alias("out_key"), "out_value",
        F.when(good, F.array().cast("array<struct<key:string,value:binary>>")).otherwise(dead_headers(F.col("error_type"), F.col("error_message"), failed_at)).alias("out_headers"),
    )
