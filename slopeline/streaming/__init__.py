"""Structured Streaming monitoring jobs."""
