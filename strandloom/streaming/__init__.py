"""Structured Streaming on top of the batch operators. The batch engine is complete without it."""
