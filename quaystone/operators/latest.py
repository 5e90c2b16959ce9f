"""The newest ticket of each customer, in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.operators.windows import RANGE, running_max


def newer_guard(tickets: DataFrame, order: list[str], range_size: int = RANGE) -> DataFrame:
    """Rows that were created after all earlier arrivals of their customer.

    Equal times do not pass, nor do times before the epoch (the start value is -1).
    """
    rows = running_max(tickets, ["customer_id"], order, F.col("created_ms"), "seen_ms", False, range_size)
    return rows.where(F.col("created_ms") > F.greatest(F.coalesce("seen_ms", F.lit(-1)), F.lit(-1))).drop("seen_ms")


def customers_latest(tickets: DataFrame, order: list[str]) -> DataFrame:
    """One row per customer: the newest, of equal times the first to arrive."""
    first = F.struct("created_ms", *[-F.col(c) for c in order])
    best = tickets.where("created_ms >= 0").groupBy("customer_id").agg(F.max_by(F.struct(*[c for c in tickets.columns if c != "customer_id"]), first).alias("row"))
    return best.select("customer_id", "row.*")
