"""functions of the scholarly-graph engine."""
