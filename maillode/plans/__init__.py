"""Whole jobs: the versioned index, ingest into it, and the views over it."""
