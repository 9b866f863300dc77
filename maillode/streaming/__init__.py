"""The incremental forms of ingest as Structured Streaming queries."""
