"""Feature tables, statistics and evaluation as Spark DataFrame operators."""
