"""Structured Streaming extras; beyond what a batch analysis needs."""
