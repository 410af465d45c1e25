"""streaming of the scholarly-graph engine."""
