"""sources of the scholarly-graph engine."""
