"""Incremental re-runs of the enrich job driven by Structured Streaming."""
