"""The checked queries: Spark jobs and their SQL counterparts."""
