"""Named plans over the driver tables: the registry behind ``__spark_entry__.queries()``
and multi-section bundles (A21, C12, C13) over one persisted ledger."""
