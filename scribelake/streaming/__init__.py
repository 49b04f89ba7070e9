"""Keyed state machines for Structured Streaming."""
