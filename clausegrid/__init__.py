"""Document-review analytics as Spark DataFrame operators."""
