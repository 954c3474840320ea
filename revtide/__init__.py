"""revtide: collaboration analytics over revision histories, as Spark DataFrame operators."""
