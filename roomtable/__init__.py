"""Photo-corpus analytics as Spark DataFrame operators."""
