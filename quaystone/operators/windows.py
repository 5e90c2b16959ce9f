"""Event-time tumbling windows: counts, strict lateness in arrival order, late rows.

`window_counts` counts everything; its streaming form is in `quaystone.streaming`.
The strict forms judge each row by the newest event time that arrived before it. That
needs a running maximum over arrival order, which `running_max` takes in levels, so no
task ever sees more than one range of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.columns import window_start_ms
from quaystone.sources.folders import written

RANGE = 10_000


def by_dimension(enriched: DataFrame, *extra: str) -> DataFrame:
    """Two rows per ticket, ``dimension`` and ``value``: one shuffle then counts both."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("category", "priority")])
    return enriched.select("created_ms", *extra, F.explode(pairs).alias("p")).select("created_ms", *extra, "p.dimension", "p.value")


def windowed(rows: DataFrame, size_ms: int) -> DataFrame:
    start = window_start_ms(F.col("created_ms"), size_ms)
    return rows.withColumn("window_start", start).withColumn("window_end", start + size_ms)


def window_counts(enriched: DataFrame, size_ms: int = 300_000) -> DataFrame:
    """``dimension, value, window_start, window_end, count`` of all rows."""
    return windowed(by_dimension(enriched), size_ms).groupBy("dimension", "value", "window_start", "window_end").agg(F.count("*").alias("count"))


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool, range_size: int = RANGE) -> DataFrame:
    """``rows`` with the maximum of ``value`` over all rows of the same keys so far.

    ``order`` starts with a whole number. Ranges of ``range_size`` of it are reduced
    first, their maxima are carried forward, and rows only look back within their own
    range. The ranges' maxima are themselves such rows, so as many levels are taken as
    the span of the order needs: no window holds more than ``range_size`` numbers.
    The order's span is asked for when this is called, which reads ``order[0]`` of the input.
    """
    low, high = rows.agg(F.min(order[0]), F.max(order[0])).first()
    levels, span = 0, 0 if low is None else high - low + 1
    while span > range_size:
        levels, span = levels + 1, -(-span // range_size)
    return _running_max(rows, keys, order, value, name, inclusive, range_size, levels)


def _running_max(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool, range_size: int, levels: int) -> DataFrame:
    back = Window.unboundedPreceding, 0 if inclusive else -1
    if not levels:
        return rows.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*back)))
    r, v, top, before = (f"_{x}{levels}" for x in ("range", "value", "top", "before"))
    rows = rows.withColumn(r, F.floor(F.col(order[0]) / range_size)).withColumn(v, value)
    tops = _running_max(rows.groupBy(*keys, r).agg(F.max(v).alias(top)), keys, [r], F.col(top), before, False, range_size, levels - 1)
    tops = tops.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(r).alias("_r"), before)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(r) == F.col("_r")]
    inside = F.max(v).over(Window.partitionBy(*keys, r).orderBy(*order).rowsBetween(*back))
    return rows.join(tops, on, "left").withColumn(name, F.greatest(inside, F.col(before))).drop(r, v, before, "_r", *[f"_k{i}" for i in range(len(keys))])


ORDER = ("arrival", "event_id")


def judged_lateness(
    enriched: DataFrame, size_ms: int, grace_ms: int, buckets: int = 1, range_size: int = RANGE, order: Sequence[str] = ORDER, carry: Sequence[str] = (), before: DataFrame | None = None
) -> DataFrame:
    """Rows by dimension with ``newest_ms`` (in arrival order) and ``late_by_ms`` (over 0: late, 0 too).

    ``buckets`` is the number of partitions of the re-keyed log; each has its own clock.
    ``before(dimension, bucket, before_ms)``, a row per clock, is the newest time of earlier input.
    """
    rows = windowed(by_dimension(enriched, *order, *carry), size_ms)
    rows = rows.withColumn("bucket", F.pmod(F.hash("value"), F.lit(buckets)))
    rows = running_max(rows, ["dimension", "bucket"], [*order], F.col("created_ms"), "newest_ms", True, range_size)
    if before is not None:
        rows = rows.join(F.broadcast(before), ["dimension", "bucket"], "left").withColumn("newest_ms", F.greatest("newest_ms", "before_ms")).drop("before_ms")
    return rows.withColumn("late_by_ms", F.col("newest_ms") - F.col("window_end") - grace_ms)


def window_counts_strict(enriched: DataFrame, size_ms: int, grace_ms: int, buckets: int = 1, order: Sequence[str] = ORDER) -> DataFrame:
    """Counts of rows in time, for windows that are closed at the end of the input."""
    rows = judged_lateness(enriched, size_ms, grace_ms, buckets, order=order)
    last = rows.groupBy("dimension", "bucket").agg(F.max("created_ms").alias("last_ms")).select(F.col("dimension").alias("d"), F.col("bucket").alias("b"), "last_ms")
    counts = rows.where("late_by_ms < 0").groupBy("dimension", "bucket", "value", "window_start", "window_end").agg(F.count("*").alias("count"))
    closed = counts.join(last, (F.col("dimension") == F.col("d")) & (F.col("bucket") == F.col("b"))).where(F.col("window_end") + grace_ms <= F.col("last_ms"))
    return closed.select("dimension", "value", "window_start", "window_end", "count")


def late_rows(enriched: DataFrame, size_ms: int, grace_ms: int, buckets: int = 1) -> DataFrame:
    """Rows that came after their window had closed, and by how much."""
    return judged_lateness(enriched, size_ms, grace_ms, buckets).where("late_by_ms >= 0").select("event_id", "dimension", "value", "window_start", "window_end", "late_by_ms")


POSITION = ("ticket_id", "topic", "partition", "offset")


def late_report(enriched: DataFrame, size_ms: int, grace_ms: int, buckets: int = 1, order: Sequence[str] = ORDER) -> DataFrame:
    """What is told about each late row: its ticket, the window it missed and by how much, and where in the log it lies.

    The running maximum reads its input three times, so the columns it needs are written first: what ``enriched``
    is made from, such as a log to be decoded, is read once.
    """
    enriched = written(enriched.select(*dict.fromkeys(["created_ms", "category", "priority", *order, *POSITION])), "late-report")
    rows = judged_lateness(enriched, size_ms, grace_ms, buckets, order=order, carry=POSITION)
    return rows.where("late_by_ms >= 0").select(*LATE)


LATE = ("ticket_id", "dimension", "value", "window_start", "window_end", "late_by_ms", "topic", "partition", "offset")
