"""From framed bytes to records: frame check, writer-schema lookup, body decoding, evolution.

A failure is a row with an ``error``, never a failed job. How a body is read and written
is a `Codec`; the default is JSON, and with Spark's Avro package one of ``from_avro`` and
``to_avro`` takes its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.columns import failing, pinned
from quaystone.schema import CATALOG, CATALOG_TYPE, DEFAULTS, SYMBOLS, TICKET

UNDECODABLE = "UndecodableMessage"
CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Codec:
    """Bodies to structs and back.

    ``read(body, reader)`` gives the reader's fields and a string `CORRUPT`, which is
    null where the body could be read; ``write(struct)`` gives bytes, nulls included.
    """

    read: Callable[[Column, T.StructType], Column]
    write: Callable[[Column], Column]


def _read_json(content: Column, reader: T.StructType) -> Column:
    with_corrupt = T.StructType([*reader.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(F.decode(content, "UTF-8"), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


JSON = Codec(_read_json, lambda record: F.encode(F.to_json(record, {"ignoreNullFields": "false"}), "UTF-8"))


def frame_error(value: Column) -> Column:
    """Why ``value`` is no frame (magic byte 0, four bytes of id, a body); null if it is one."""
    magic = F.conv(F.hex(F.substring(value, 1, 1)), 16, 10)
    return F.when(F.length(value) <= 5, F.concat(F.length(value).cast("string"), F.lit(" bytes are too short for a frame"))).when(
        magic != "0", F.concat(F.lit("magic byte "), magic, F.lit(" instead of 0"))
    )


def schema_id(value: Column) -> Column:
    return F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")


def body(value: Column) -> Column:
    return F.substring(value, 6, 2147483647)


def frame(schema: int | Column, content: Column) -> Column:
    """Content bytes as a frame of the given schema id."""
    number = F.lpad(F.hex(schema if isinstance(schema, Column) else F.lit(schema)), 8, "0")
    return F.concat(F.unhex(F.lit("00")), F.unhex(number), content)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*CATALOG], CATALOG_TYPE)


def read_frames(log: DataFrame, schemas: DataFrame) -> DataFrame:
    """``log`` with ``schema_id``, the writer's ``version, record, fields`` and ``error``.

    The catalogue has a row per registered schema, some dozens at the most.
    """
    framed = log.withColumn("error", frame_error(F.col("value"))).withColumn("schema_id", F.when(F.col("error").isNull(), schema_id(F.col("value"))))
    known = F.broadcast(schemas.select(F.col("schema_id").alias("known_id"), "subject", "version", "record", "fields"))
    unknown = F.col("error").isNull() & F.col("value").isNotNull() & F.col("known_id").isNull()
    joined = framed.join(known, F.col("schema_id") == F.col("known_id"), "left")
    return joined.withColumn("error", F.when(unknown, F.concat(F.lit("unknown schema id "), F.col("schema_id").cast("string"))).otherwise(F.col("error"))).drop("known_id")


def decode_body(framed: DataFrame, reader: T.StructType = TICKET, record: str = "Ticket", codec: Codec = JSON) -> DataFrame:
    """Adds the reader's record as struct ``r`` and completes ``error``.

    A body fails if it is cut off, written as another record, lacks a field of its
    writer's schema or one of the reader's that has no default, or holds an unknown
    symbol in one of the reader's enum fields. A field takes its default only where the
    writer's schema has no such field.
    """
    rows = pinned(framed, raw=F.when(F.col("error").isNull() & F.col("value").isNotNull(), codec.read(body(F.col("value")), reader)))
    written = lambda name: F.array_contains("fields", name)
    value = lambda name: F.when(written(name), F.col(f"raw.{name}")).otherwise(F.lit(DEFAULTS[name])) if name in DEFAULTS else F.col(f"raw.{name}")
    whole = symbols = F.lit(True)
    for name in reader.fieldNames():
        whole = whole & value(name).isNotNull()
        if name in SYMBOLS:
            symbols = symbols & F.coalesce(value(name).isin(*SYMBOLS[name]), F.lit(False))
    problem = (
        F.when(F.col("record") != record, F.concat(F.lit("written as "), F.col("record")))
        .when(F.col(f"raw.{CORRUPT}").isNotNull() | ~whole, F.lit("body cannot be read"))
        .when(~symbols, F.lit("unknown symbol"))
    )
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("raw").isNotNull(), problem)))
    fields = F.struct(*[value(n).alias(n) for n in reader.fieldNames()])
    return rows.withColumn("r", F.when(F.col("error").isNull() & F.col("raw").isNotNull(), fields)).drop("raw")


def encode_error(record: Callable[[str], Column], writer: T.StructType) -> Column:
    """Why a record cannot be written: the fields of ``writer`` without a value, and those with an unknown symbol; null if it can."""
    missing = failing(**{n: record(n).isNotNull() for n in writer.fieldNames()})
    unknown = failing(**{n: record(n).isNull() | record(n).isin(*SYMBOLS[n]) for n in writer.fieldNames() if n in SYMBOLS})
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(F.size(unknown) > 0, F.concat(F.lit("unknown symbol in "), F.array_join(unknown, ", ")))


def encode(rows: DataFrame, record: str, schema: int, writer: T.StructType, codec: Codec = JSON) -> DataFrame:
    """``rows`` with their struct ``record`` as a frame in ``encoded``, or null and the reason in ``encode_error``.

    A null struct is written as null (a tombstone).
    """
    field = lambda n: F.col(f"{record}.{n}")
    there = F.col(record).isNotNull()
    rows = pinned(rows, encode_error=F.when(there, encode_error(field, writer)))
    return rows.withColumn("encoded", F.when(there & F.col("encode_error").isNull(), frame(schema, codec.write(F.struct(*[field(n).alias(n) for n in writer.fieldNames()])))))
