"""Schemas of the ledger, events, sessions and rules, plus the filter set."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("merchant", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("category", T.StringType(), True),
    T.StructField("provider", T.StringType(), True),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("page", T.StringType(), False),
    T.StructField("component", T.StringType(), True),
    T.StructField("metadata_json", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("started_at", T.TimestampType(), True),
    T.StructField("ended_at", T.TimestampType(), True),
    T.StructField("duration_seconds", T.DoubleType(), True),
    T.StructField("event_count", T.LongType(), False),
    T.StructField("first_page", T.StringType(), True),
    T.StructField("last_page", T.StringType(), True),
    T.StructField("last_event_at", T.TimestampType(), True),
])

RULES = T.StructType([
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
])


def _clean_list(values) -> list[str]:
    out: list[str] = []
    for raw in values or []:
        text = str(raw).strip()
        if text and text not in out:
            out.append(text)
    return out


@dataclass(frozen=True)
class Filters:
    """The ledger filter set (P1-P8). Every field is optional; unset means no predicate."""

    start: date | str | None = None
    end: date | str | None = None
    category: str | None = None
    categories: tuple[str, ...] | list[str] | None = None
    exclude_category: str | None = None
    provider: str | None = None
    merchant: str | None = None
    merchant_regex: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    extra: dict = field(default_factory=dict)

    def selected_categories(self) -> list[str] | None:
        """The list wins over the scalar; trimmed, blanks dropped, order-preserving dedupe.

        A non-empty list whose entries are all blank means no category filter at all.
        """
        if self.categories:
            values = _clean_list(self.categories)
        elif self.category:
            values = _clean_list([self.category])
        else:
            values = []
        return values or None

    def with_range(self, start, end) -> "Filters":
        return replace(self, start=start, end=end)

    def without_merchant(self) -> "Filters":
        return replace(self, merchant=None)

    @staticmethod
    def dashboard(include_house: bool = False, **kwargs) -> "Filters":
        """The dashboard hides `house` unless asked for or explicitly selected."""
        f = Filters(**kwargs)
        selected = f.selected_categories() or []
        if not include_house and "house" not in selected and not f.exclude_category:
            f = replace(f, exclude_category="house")
        return f
