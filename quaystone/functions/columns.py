"""Column functions of the ticket pipeline; all run inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.schema import BILLING, MAX_ERROR, OTHER, TECH, URGENT

#: Unicode white space without the information separators U+001C to U+001F.
BLANKS = r"[\t\n\x0B\f\r \u0085   -     　]+"
#: The same, one by one, as `strip` takes them (a trim reads the ends only, a pattern the whole text).
BLANK = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_HYPHENATED = r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
_UUID = rf"(?i)^([0-9a-f]{{32}}|(urn:uuid:)?{_HYPHENATED}|\{{{_HYPHENATED}\}})\z"


def strip(text: Column) -> Column:
    """Without white space at both ends (any Unicode blank, not only spaces)."""
    return F.btrim(text, F.lit(BLANK))


def truncate_error(message: Column, most: int = MAX_ERROR) -> Column:
    """The first ``most`` characters (not bytes)."""
    return F.substring(message, 1, most)


def is_uuid(text: Column) -> Column:
    """Whether it is a UUID in one of its four written forms."""
    return text.rlike(_UUID)


def canonical_uuid(text: Column) -> Column:
    """A UUID in any of its four written forms as lower-case hyphenated text, else null."""
    parts = r"(?i)^(?:urn:uuid:|\{)?(.{8})-?(.{4})-?(.{4})-?(.{4})-?(.{12})\}?$"
    return F.when(is_uuid(text), F.regexp_replace(F.translate(text, "ABCDEF", "abcdef"), parts, "$1-$2-$3-$4-$5"))


def tier_for(customer_id: Column) -> Column:
    """A customer's tier from the last digit of the id."""
    last = F.substring(customer_id, -1, 1)
    return F.when(last == "0", "enterprise").when(last.isin("1", "2", "3"), "pro").otherwise("free")


def to_millis(ts: Column) -> Column:
    """A timestamp cut (floored) to whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(ts))


def event_time_ms(created_at: Column, log_timestamp: Column) -> Column:
    """Epoch milliseconds of the event; a record without a value falls back to its log time."""
    return F.coalesce(F.unix_millis(created_at), F.unix_millis(log_timestamp))


def window_start_ms(ms: Column, size_ms: int) -> Column:
    """The start of the tumbling window of ``ms`` (floor, negative times included)."""
    return ms - F.pmod(ms, F.lit(size_ms))


def stats_key(dimension: Column, value: Column) -> Column:
    return F.concat_ws("=", dimension, value)


def route_topics(category: Column, priority: Column) -> Column:
    """The topics of an enriched ticket: its category's, then the copy of an urgent one."""
    own = F.when(category == "billing", BILLING).when(category == "technical", TECH).when(category.isin("account", "other"), OTHER)
    return F.array_remove(F.array(F.coalesce(own, F.lit("")), F.when(priority == "urgent", URGENT).otherwise("")), "")


def headers(values: dict[str, Column]) -> Column:
    """Log headers of text values, by name."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v.cast("string"), "UTF-8").alias("value")) for k, v in values.items()])


def header_map(column: Column) -> Column:
    """Headers as a map of text: null values are skipped, of equal names the last wins."""
    none = F.create_map().cast("map<string,string>")
    put = lambda m, h: F.map_concat(F.map_filter(m, lambda k, v: k != h["key"]), F.create_map(h["key"], F.decode(h["value"], "UTF-8")))
    return F.coalesce(F.aggregate(column, none, lambda m, h: F.when(h["value"].isNull() | h["key"].isNull(), m).otherwise(put(m, h))), none)


def replay_target(column: Column) -> Column:
    """The topic a dead letter came from; null if unknown."""
    return F.try_element_at(header_map(column), F.lit("source.topic"))


def tenths(x: Column) -> Column:
    """``x`` (not negative) with one decimal, as text: nearest to its exact value, exact ties to the even digit.

    ``off`` is exactly ``20 x - m``: both differences are of numbers within a factor of two.
    """
    m = F.rint(x * 20)
    off = (x * 16 - m) + x * 4
    odd = m % 2 == 1
    t = F.when(odd & ((off > 0) | ((off == 0) & (m % 4 == 3))), (m + 1) / 2).when(odd, (m - 1) / 2).otherwise(m / 2).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def format_duration(seconds: Column) -> Column:
    """``250 ms``, ``12.3 s``, ``4.5 min``; a dash for null. Exact ties go to the even digit."""
    return (
        F.when(seconds.isNull(), "—")
        .when(seconds < 1, F.concat(F.rint(seconds * 1000).cast("long").cast("string"), F.lit(" ms")))
        .when(seconds < 60, F.concat(tenths(seconds), F.lit(" s")))
        .otherwise(F.concat(tenths(seconds / 60), F.lit(" min")))
    )


def failing(**rules: Column) -> Column:
    """The names of the rules that do not hold (null counts as not holding), in order.

    No higher-order function: Spark evaluates what is inside one without generated code.
    """
    return F.array_remove(F.array(*[F.when(F.coalesce(ok, F.lit(False)), "").otherwise(name) for name, ok in rules.items()]), "")


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once per row.

    Expressions that are merely projected get copied into each place that takes a
    part of them; a generator of exactly one row per row is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
