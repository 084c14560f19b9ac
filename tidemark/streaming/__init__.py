"""Structured Streaming versions of the observation operators."""
