"""Structured Streaming entry points for the stateless operators."""
