"""Portfolio questions."""
