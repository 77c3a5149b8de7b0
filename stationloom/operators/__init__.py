"""DataFrame operators: joins, deduplication, aggregates, sampling, metrics, learned transforms."""
