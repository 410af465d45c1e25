"""operators of the scholarly-graph engine."""
