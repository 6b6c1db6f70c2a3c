"""Composed pipelines and the named-query registry."""
