"""Rules for tickets, enriched tickets and statistics: the failing fields of each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.columns import canonical_uuid, failing, is_uuid, strip
from quaystone.schema import CATEGORIES, CHANNELS, DIMENSIONS, MAX_SUBJECT, MAX_SUMMARY, PRIORITIES, TIERS

CUSTOMER = r"(?U)^C-\d{4}\z"
TEXTS = ("customer_id", "product", "subject", "body", "summary", "model")


def cleaned(name: str, value: Column) -> Column:
    """A field as it is passed on: texts without white space at their ends, a ticket's UUID in canonical form if it is one."""
    if name == "ticket_id":
        return F.coalesce(canonical_uuid(value), value)
    return strip(value) if name in TEXTS else value


def stripped(df: DataFrame) -> DataFrame:
    """``df`` with its fields `cleaned`."""
    return df.withColumns({c: cleaned(c, F.col(c)) for c in (*TEXTS, "ticket_id") if c in df.columns})


def _ticket(c: Callable[[str], Column], time: str) -> dict[str, Column]:
    filled = lambda name: F.char_length(c(name)) > 0
    return {
        "ticket_id": is_uuid(c("ticket_id")), "customer_id": c("customer_id").rlike(CUSTOMER), "created_at": c(time).isNotNull(), "channel": c("channel").isin(*CHANNELS),
        "product": filled("product"), "subject": F.char_length(c("subject")).between(1, MAX_SUBJECT), "body": filled("body"), "tier": c("tier").isin(*TIERS),
    }


def ticket_errors(c: Callable[[str], Column] = F.col, time: str = "created_at") -> Column:
    """Failing fields of a ticket whose texts are stripped; ``c`` finds a field's column."""
    return failing(**_ticket(c, time))


def enriched_errors(c: Callable[[str], Column] = F.col, time: str = "created_at", enriched: str = "enriched_at") -> Column:
    rules = _ticket(c, time) | {
        "category": c("category").isin(*CATEGORIES), "priority": c("priority").isin(*PRIORITIES), "sentiment": c("sentiment").between(-1.0, 1.0),
        "summary": F.char_length(c("summary")).between(1, MAX_SUMMARY), "enriched_at": c(enriched).isNotNull(), "model": F.char_length(c("model")) > 0,
    }
    return failing(**rules)


def classification_errors(c: Callable[[str], Column] = F.col) -> Column:
    """Failing fields of a classifier's answer; NaN is outside every range."""
    return failing(
        category=c("category").isin(*CATEGORIES), priority=c("priority").isin(*PRIORITIES), sentiment=c("sentiment").between(-1.0, 1.0), summary=F.char_length(c("summary")).between(1, MAX_SUMMARY)
    )


def stats_errors(c: Callable[[str], Column] = F.col) -> Column:
    belongs = F.when(c("dimension") == "category", c("value").isin(*CATEGORIES)).when(c("dimension") == "priority", c("value").isin(*PRIORITIES))
    return failing(dimension=c("dimension").isin(*DIMENSIONS), value=belongs, window_start=c("window_start").isNotNull(), window_end=c("window_end").isNotNull(), count=c("count") >= 1)
