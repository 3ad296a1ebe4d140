"""Structured Streaming faces of the stateful operators."""
