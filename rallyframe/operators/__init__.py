"""DataFrame operators: ordered scans, match state, player rates, filters, metrics."""
