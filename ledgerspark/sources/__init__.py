"""Sources: driver-table views (ledger/events shaping), statement files (S1-S8), manual entries
(S9), recurring rules (S10), the stored ledger (S11, S13) and event batches (S12)."""

from ledgerspark.sources.tables import (
    CATEGORY_RULES, ledger_lines, ledger_orders, read_table, usage_events,
)

__all__ = ["CATEGORY_RULES", "ledger_lines", "ledger_orders", "read_table", "usage_events"]
