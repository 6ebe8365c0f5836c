"""Structured Streaming views of the batch operators."""
