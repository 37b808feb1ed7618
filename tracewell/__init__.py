"""Security analytics over source-code corpora, as plain Spark DataFrame jobs."""
