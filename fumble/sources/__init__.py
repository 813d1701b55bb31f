"""Sources and sinks: driver tables, pair CSV files, JSON lines, record tables."""
