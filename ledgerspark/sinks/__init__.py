"""Sinks K1-K5: the partitioned ledger table, CSV extracts and the event table.

X2: sources and sinks are plain registries, ``name -> callable``, so a deployment can add a
layout or an output without touching the import job.
"""

from ledgerspark.sinks.events import write_events
from ledgerspark.sinks.ledger import write_master_csv, write_month_extract, write_upsert

SINKS = {
    "ledger": write_upsert,          # (spark, path, batch, rules)
    "csv": write_master_csv,         # (df, path)
    "months": write_month_extract,   # (df, path)
    "events": write_events,          # (spark, path, events)
}
