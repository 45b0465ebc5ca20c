"""DataFrame -> DataFrame operators over the LEDGER and EVENTS schemas."""
