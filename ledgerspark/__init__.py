"""Spend-ledger and usage-event analytics as Spark DataFrame operators."""

from ledgerspark.schema import EVENTS, LEDGER, RULES, SESSIONS, Filters
from ledgerspark.session import checkpoint_dir, get_spark

__all__ = ["EVENTS", "LEDGER", "RULES", "SESSIONS", "Filters", "checkpoint_dir", "get_spark"]
