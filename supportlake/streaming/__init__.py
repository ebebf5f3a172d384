"""Structured Streaming jobs (W1-W7); each has a batch twin in operators."""
