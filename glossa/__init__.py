"""Word-level language and reading-time analytics as Spark DataFrame jobs."""
