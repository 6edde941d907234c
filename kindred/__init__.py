"""kindred: recommendation and catalogue analytics as plain Spark DataFrame operators."""
