"""Java sources: a declaration scanner in plain Python, and the graph built from its rows in Spark."""
