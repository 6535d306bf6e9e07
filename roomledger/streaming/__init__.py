"""Structured Streaming jobs: thin runners around the operators."""
