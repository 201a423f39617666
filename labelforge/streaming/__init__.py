"""Structured Streaming: response parsing and running metrics on arriving data."""
