"""Structured Streaming forms of the change-driven operators."""
