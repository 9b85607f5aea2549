"""Document enrichment, vector search and synthetic twins as Spark DataFrame jobs."""
