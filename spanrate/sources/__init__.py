"""Readers, sinks and durable intermediate tables."""
