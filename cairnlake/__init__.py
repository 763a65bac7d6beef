"""cairnlake: memory and retrieval analytics as plain Spark DataFrame functions."""
