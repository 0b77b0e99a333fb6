"""Full-text search and corpus processing expressed as Spark plans."""
