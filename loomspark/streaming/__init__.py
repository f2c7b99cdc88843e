"""Streaming and stateful operators."""
