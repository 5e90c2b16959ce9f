"""The reporting queries over the tables of tickets and statistics (times in ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: Values of a median that are put in order together, and columns a pivot may get beyond the known ones.
BLOCK, MOST_OTHERS = 65_536, 200


def median(rows: DataFrame, value: Column) -> DataFrame:
    """``median`` (one row, null without values) of whole numbers, halfway between the middle ones.

    Equal values are counted first. Blocks of values are summed, and only the blocks
    that hold the middle are put in order, so no task holds all distinct values.
    """
    counts = rows.select(value.cast("long").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("v") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    total = F.broadcast(blocks.agg(F.sum("n").alias("total")))  # one row
    middle = [F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)]
    low, high = (m.cast("long") for m in middle)
    upto = F.sum("n").over(Window.orderBy("block"))
    held = blocks.withColumn("upto", upto).join(total, F.lit(True)).withColumn("before", F.col("upto") - F.col("n"))
    held = held.where((F.col("before") < high) & (F.col("upto") >= low)).select(F.col("block").alias("b"), "before", "total")  # two blocks at the most
    inside = counts.join(F.broadcast(held), F.col("block") == F.col("b")).withColumn("to", F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("v")))
    at = lambda m: F.min(F.when(F.col("to") >= m, F.col("v")))
    return inside.agg(((at(low) + at(high)) / 2).alias("median"))


def headline(tickets: DataFrame, now_ms: int) -> DataFrame:
    """Totals, and medians over the tickets enriched in the last hour (null without any); one row."""
    recent = tickets.where(F.col("enriched_ms") > now_ms - HOUR_MS)
    seconds = lambda name, d: F.broadcast(median(recent, d).select(F.round(F.col("median") / 1000, 6).alias(name)))
    totals = tickets.agg(F.count("*").alias("total"), F.count_if(F.col("created_ms") > now_ms - HOUR_MS).alias("last_hour"))
    # each side is one row
    return totals.join(seconds("classify_seconds", F.col("enriched_ms") - F.col("created_ms")), F.lit(True)).join(seconds("sink_seconds", F.col("loaded_ms") - F.col("enriched_ms")), F.lit(True))


def recent_windows(stats: DataFrame, dimension: str, windows: int = 24) -> DataFrame:
    """Rows of the newest ``windows`` distinct starts of a dimension."""
    own = stats.where(F.col("dimension") == dimension)
    starts = own.select("window_start").distinct().orderBy(F.desc("window_start")).limit(windows)
    oldest = starts.agg(F.min("window_start").alias("oldest"))
    return own.join(F.broadcast(oldest), F.col("window_start") >= F.col("oldest")).select("window_start", "value", "count").orderBy("window_start", "value")


def sentiment_by_category(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("category").agg(F.round(F.avg("sentiment"), 6).alias("avg_sentiment"), F.count("*").alias("n")).orderBy("category")


def latest_tickets(tickets: DataFrame, limit: int = 20) -> DataFrame:
    """The newest tickets; equal times in the order of their ids."""
    return tickets.orderBy(F.desc("created_ms"), "ticket_id").select("created_ms", "customer_id", "category", "priority", "sentiment", "summary").limit(limit)


def stats_pivot(stats: DataFrame, known: tuple[str, ...], others: int = MOST_OTHERS) -> DataFrame:
    """A row per window start and a column per value: known ones in order, others sorted behind; gaps are 0.

    Windows of several sizes with one start: the longest one's count. A table has a
    column per value, so more than ``others`` values that are not known are refused;
    `stats_long` has no such bound.
    """
    seen = sorted(r[0] for r in stats.select("value").where(~F.col("value").isin(*known)).distinct().limit(others + 1).collect())
    if len(seen) > others:
        raise ValueError(f"more than {others} values besides {', '.join(known)}")
    names = [*known, *seen]
    return stats.groupBy("window_start").pivot("value", names).agg(F.max_by("count", "window_end")).na.fill(0, names)


def stats_long(stats: DataFrame) -> DataFrame:
    """``window_start, value, count`` of the longest window at each start, for any number of values; gaps have no row."""
    return stats.groupBy("window_start", "value").agg(F.max_by("count", "window_end").alias("count"))
