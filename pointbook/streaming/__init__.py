"""Structured Streaming: micro-batch ingest of requests and running totals."""
