"""Sources and sinks: CSV, JSON records, paged web sources, in-memory rows."""
