"""Flight-track analytics as Spark DataFrame operators."""
