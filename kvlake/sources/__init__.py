"""Sources and sinks: the Parquet store, write-ahead log records, sorted-table blocks, text and random data."""
